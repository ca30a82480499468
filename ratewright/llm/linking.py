"""Linking records through pairwise matches: hash-to-min over pair rows.

A vertex's cluster set is never built as one value. The sets of all vertices are rows of one symmetric relation, of
which only the half ``(low, high)`` with ``low < high`` is kept, so a component holding a third of all records is as
evenly spread as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.common import attach, materialize, release, sorted_positions

MAX_ROUNDS = 60


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``edges``: rows ``(vertex, root)``, root being the component's smallest vertex.

    Each round, every vertex v sends its cluster set to its minimum member m and m to all others: of each pair (v, u) in
    the relation it leaves (m, u), or (m, v) if u is m. It ends when no vertex but a root holds anything besides itself
    and its root; the relation is then a star around each root, which is checked exactly, not by a checksum. Rounds grow
    with the logarithm of the longest chain.

    Edges with a null end or two equal ends link nothing; repeated edges and either order count once. A vertex that is
    in no real edge isn't in the result. Strings compare byte by byte. No edges give no rows. Other columns are ignored.
    """
    low, high = F.least(F.col(a), F.col(b)).alias("low"), F.greatest(F.col(a), F.col(b)).alias("high")
    named = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(low, high).distinct(), "links")
    ends = named.select(F.explode(F.array("low", "high")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    # Vertices go by their position in sorted order: the least position is the least vertex, and longs aggregate by hash.
    positions = sorted_positions(ends, "v")
    names = materialize(positions.join(ends, "v"), "names")
    release(positions)
    state = _positions(named, names)
    release(named)
    for _ in range(MAX_ROUNDS):
        total = 2 * state.count()
        if not total:
            break
        pairs = state.select(F.explode(F.array(F.struct(F.col("low").alias("v"), F.col("high").alias("u")), F.struct(F.col("high").alias("v"), F.col("low").alias("u")))).alias("p")).select("p.v", "p.u")
        least = materialize(pairs.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("v", "m")), "h2m-min")
        sent = attach(pairs, least, "v", "n", total)
        # A root's own set stays; a non-root sends u to m, and itself where u is m.
        stray = (F.col("m") != F.col("v")) & (F.col("u") != F.col("m"))
        moved = sent.select(F.col("m").alias("low"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("high"), stray.alias("stray"))
        after = materialize(moved.groupBy("low", "high").agg(F.max("stray").alias("stray")), "h2m")
        settled = after.where("stray").isEmpty()
        release(least)
        release(state)
        state = after.select("low", "high")
        state._ratewright_path = after._ratewright_path
        if settled:
            break
    else:
        raise RuntimeError(f"components not stable after {MAX_ROUNDS} rounds")
    star = state.select(F.col("high").alias("vertex"), F.col("low").alias("root")).unionByName(state.select(F.col("low").alias("vertex"), F.col("low").alias("root")).distinct())
    found = names.select("v", F.col("position").alias("vertex")).join(star, "vertex").select(F.col("v").alias("vertex"), "root")
    held = star.groupBy("root").agg(F.count("*").alias("c"))
    roots = materialize(held.join(names.select(F.col("position").alias("root"), F.col("v").alias("name")), "root"), "roots")
    out = materialize(attach(found, roots, "root", "c", names.count()).select("vertex", F.col("name").alias("root")), "components")
    for step in (names, roots, state):
        release(step)
    return out


def _positions(named: DataFrame, names: DataFrame) -> DataFrame:
    """Links by positions; a vertex with a third of all links is joined by broadcast."""
    total = 2 * named.count()
    side = lambda c: names.select(F.col("v").alias(c), F.col("position").alias(f"p_{c}"), F.col("n").alias(f"n_{c}"))
    one = attach(named, side("low"), "low", "n_low", total).select("high", "p_low")
    both = attach(one, side("high"), "high", "n_high", total)
    return materialize(both.select(F.col("p_low").alias("low"), F.col("p_high").alias("high")), "h2m")
