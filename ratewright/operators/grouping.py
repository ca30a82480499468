"""Duplicates, near-duplicates and incremental groups; connected components by propagating the least label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.common import materialize, release
from ratewright.functions.bits import best_agree, block_masks, mask_keys
from ratewright.functions.numeric import hamming64

#: Credits that name nobody (fixed values): where creators are grouped, and where clusters are made of a source list.
PLACEHOLDER = r"(?i)^\s*(unknown|not stated|no(t)? known|anonymous|n\/?a|none|-)\b"
PLACEHOLDER_OF_SOURCES = r"(?i)^\s*(unknown|not stated|no(t)? known|anonymous|n\/?a|none|-)\s*"


def hash_code(hex16: Column) -> Column:
    """Signed long of 16 hex digits of either case, null for anything else."""
    h = F.lower(F.trim(hex16))
    return F.when(h.rlike(r"^[0-9a-f]{16}\z"), F.conv(h, 16, -10).cast("bigint"))


#: Codes of two tables meet in passes of at least so many keys a code, or of so many rows of keys, if that is more.
PASS_KEYS, PASS_ROWS = 14, 8_000_000


def near_codes(one: DataFrame, other: DataFrame, radius: int = 6, agree: int | None = None) -> DataFrame:
    """Pairs ``(code_a, code_b)`` of the distinct codes (column ``code``) of two tables within ``radius`` bits, by block keys.

    ``agree`` blocks make a key; left out, it is chosen by the number of codes on each side. Codes that share a common key
    are compared by a skew-aware join. Null codes meet none. Keys are never broadcast: Spark takes a table of keys to be
    hardly larger than its codes, as it doesn't know how many keys a code has. Where keys are many, they meet in passes,
    of which only the pairs are kept: what is on disk at once is ``PASS_KEYS`` keys a code, however many a code has.
    """
    return _met(*(_codes(x) for x in (one, other)), radius, agree, F.lit(True))


def near_pairs(codes: DataFrame, radius: int = 6, agree: int | None = None) -> DataFrame:
    """Pairs ``(code_a, code_b)``, the smaller first, of distinct codes within ``radius`` bits; see ``near_codes``. Both
    sides are one table, so its keys are written once.
    """
    c = _codes(codes)
    return _met(c, c, radius, agree, F.col("code_a") < F.col("code_b"))


def _codes(rows: DataFrame) -> DataFrame:
    return materialize(rows.where("code is not null").select("code").distinct(), "codes")


def _met(a: DataFrame, b: DataFrame, radius: int, agree: int | None, wanted: Column) -> DataFrame:
    """``near_codes`` of two written tables, of the pairs those that are ``wanted``."""
    n = a.count()
    m = n if a is b else b.count()
    agree = agree or best_agree(n, m, radius)
    masks = block_masks(radius, agree)
    keyed = lambda x, name, part: x.select(F.col("code").alias(name), F.explode(mask_keys(F.col("code"), part)).alias("k")).hint("merge")
    near = wanted & (hamming64(F.col("code_a"), F.col("code_b")) <= radius)
    meet = lambda part: keyed(a, "code_a", part).join(keyed(b, "code_b", part), "k").where(near).select("code_a", "code_b").distinct()
    most = max(PASS_KEYS, PASS_ROWS // max(1, n if a is b else n + m))
    if len(masks) <= most:
        return meet(masks)
    passes = -(-len(masks) // most)
    found = [materialize(meet(masks[i::passes]), "near") for i in range(passes)]
    for x in (a, b):
        release(x)
    return reduce(DataFrame.unionByName, found).distinct().hint("merge")  # small files, but as many rows as there are pairs


def hexed(code: Column | str) -> Column:
    """The 16 hex digits of a code."""
    return F.lpad(F.lower(F.hex(code)), 16, "0")


def near_images(rows: DataFrame, radius: int = 6) -> DataFrame:
    """``(image_a, image_b, bits)``, a before b: images of ``rows (image_id, sha256, code)`` within ``radius`` bits, equal
    codes included, but not those of one sha256. A null sha256 equals none; rows without a code take no part. Images are
    as many as the rows and never broadcast.
    """
    c = rows.where("image_id is not null and code is not null").select("image_id", "sha256", "code").distinct()
    a, b = (c.select(F.col("image_id").alias(f"i{x}"), F.col("sha256").alias(f"s{x}"), F.col("code").alias(f"code_{x}")).hint("merge") for x in "ab")
    near = near_pairs(c, radius).unionByName(c.select(F.col("code").alias("code_a"), F.col("code").alias("code_b")).distinct())
    pairs = near.join(a, "code_a").join(b, "code_b").where(~F.coalesce(F.col("sa") == F.col("sb"), F.lit(False)) & (F.col("ia") != F.col("ib")))
    return pairs.select(F.least("ia", "ib").alias("image_a"), F.greatest("ia", "ib").alias("image_b"), hamming64(F.col("code_a"), F.col("code_b")).alias("bits")).distinct()


def image_groups(rows: DataFrame, radius: int = 6) -> DataFrame:
    """``(image_id, hash, keeper, first_image, images)``: single linkage of ``rows (image_id, code)`` within ``radius`` bits.

    Every image with a code is in a group, alone or not: of the group, ``keeper`` is the least code, ``first_image`` the
    least image and ``images`` how many it has. Neither images nor codes nor groups are ever broadcast.
    """
    c = rows.where("image_id is not null and code is not null").select("image_id", hexed("code").alias("hash")).distinct().hint("merge")
    labels = least_labels(near_pairs(rows, radius).select(hexed("code_a").alias("a"), hexed("code_b").alias("b")))
    kept = c.select("hash").distinct().join(labels.select(F.col("vertex").alias("hash"), "label"), "hash", "left").select("hash", F.coalesce("label", "hash").alias("keeper"))
    members = c.join(kept, "hash")
    sizes = members.groupBy("keeper").agg(F.min("image_id").alias("first_image"), F.countDistinct("image_id").alias("images"))
    return members.join(sizes.hint("merge"), "keeper").select("image_id", "hash", "keeper", "first_image", "images")


def least_labels(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of ``edges (a, b)`` as ``(vertex, label)``, label the least vertex. Each round a vertex takes the least
    label around it and then that label's own label, so rounds grow with the logarithm of a chain's length in practice. Labels
    are as many as the vertices and are never broadcast, however small their file, neither here nor by who joins them.
    """
    both = materialize(edges.where("a is not null and b is not null and a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
    own = lambda x: x.select("vertex", "label").hint("merge")
    labels = materialize(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        around = both.join(own(labels).withColumnRenamed("vertex", "b"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("label").alias("seen"))
        step = own(labels).join(around, "vertex", "left").select("vertex", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = own(labels).select(F.col("vertex").alias("label"), F.col("label").alias("far"))
        after = materialize(step.join(jump, "label", "left").select("vertex", "old", F.least("label", "far").alias("label")), "labels")
        done = after.where("old <> label").isEmpty()
        release(labels)
        labels = own(after)
        labels._ratewright_path = after._ratewright_path
        if done:
            return labels
    raise RuntimeError("components not stable")


def duplicate_of(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Adds ``duplicate_of``: the least key with the same content, null for that one itself and for null content."""
    first = rows.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(key).alias("__first"), F.count("*").alias("__n"))
    repeated = first.where("__n > 1").drop("__n")
    return rows.join(repeated, content, "left").select(*rows.columns, F.when(F.col("__first") != F.col(key), F.col("__first")).alias("duplicate_of"))


def creator_group(credit: Column) -> Column:
    """``creator:`` and the normalised credit; null for a null, blank or placeholder credit."""
    name = F.lower(F.regexp_replace(F.trim(credit), r"\s+", " "))
    return F.when((name != "") & ~credit.rlike(PLACEHOLDER), F.concat(F.lit("creator:"), name))


def source_cluster(creator: Column) -> Column:
    """The trimmed creator as it stands, null where it is blank or a placeholder."""
    name = F.trim(creator)
    return F.when((name != "") & ~name.rlike(PLACEHOLDER_OF_SOURCES), name)


def append_grouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Merges newcomers into a group table ``(key, label)``: all groups a newcomer links to become one with the least label."""
    old = groups.select(F.col("key").alias("a"), F.col("label").alias("b"))
    alone = groups.select(F.col("key").alias("vertex"), F.col("label").alias("own"))
    merged = least_labels(old.where("a <> b").unionByName(links.select("a", "b")))
    return alone.join(merged, "vertex", "full_outer").select(F.col("vertex").alias("key"), F.coalesce("label", "own").alias("label"))


def merge_labels(existing: DataFrame, incoming: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Keyed union of labels: ``(merged, conflicts)``. A repeat is a no-op; a key with two values is a conflict and not merged."""
    both = existing.select(*keys, value).unionByName(incoming.select(*keys, value)).groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("other"))
    return both.where(F.col(value) == F.col("other")).drop("other"), both.where(F.col(value) != F.col("other"))


def first_writes(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Insert-if-absent: of rows with one key the earliest stays, null keys are left out."""
    return _one(rows, keys, F.min)


def last_writes(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Upsert: of rows with one key the latest stays; null key parts are values like any other."""
    return _one(rows, keys, F.max)


def _one(rows: DataFrame, keys: list[str], pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*rest)).alias("r")).select(*keys, "r.*")
