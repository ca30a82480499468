"""Samples in target proportions: top-down allocation over a category tree, drawn at the leaves by permuted rank.

A photo stands in one leaf of each target set: the leaf of all photos that fit the same targets of the set. Leaves have
stock, targets are sets of leaves, and nothing is given twice: the report tells what is drawn.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratewright.common import norm_key

VARIANTS = ["good", "mediocre", "bad", "edge"]
FIELDS = ["queryvariant", "query", "cohort"]
#: More targets than this aren't planned on the driver; target tables are written by hand.
MOST_TARGETS = 100_000
#: Leaves are sets of targets, fewer than the combinations of values that targets name; more aren't planned on the driver.
MOST_LEAVES = 1_000_000
#: Bits of the hash buckets by which a leaf is ranked without a task that holds a whole leaf.
BUCKET_BITS = 14


def photo_pool(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """``(sha256, combos)``: photos with one of the four variants, a query and a cohort, and all combinations they have."""
    m = manifest.select(norm_key("sha256").alias("sha256"), norm_key("queryvariant").alias("queryvariant"), norm_key("query").alias("query"))
    m = m.where(F.col("queryvariant").isin(VARIANTS) & F.col("query").isNotNull() & F.col("sha256").isNotNull()).distinct()
    i = images.select(norm_key("sha256").alias("sha256"), norm_key("cohort").alias("cohort")).where("sha256 is not null and cohort is not null").distinct()
    return m.join(i, "sha256").groupBy("sha256").agg(F.collect_set(F.struct(*FIELDS)).alias("combos"))


def _targets(targets: DataFrame) -> list[dict]:
    rows = targets.select("target_id", "target_set", *[norm_key(f).alias(f) for f in FIELDS], F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("sample_rate", F.lit(1.0)).alias("sample_rate"), F.coalesce("min_rows", F.lit(0)).alias("min_rows")).distinct().orderBy("target_id").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return [r.asDict() for r in rows]


def _hits(pool: DataFrame, targets: list[dict]) -> DataFrame:
    """``(sha256, target_set, target_id)``: the targets each photo fits, by equality on the fields a target names; maybe repeated."""
    spark = pool.sparkSession
    star = "\0"
    keys = spark.createDataFrame(
        [(star.join(f"{i}={t[f]}" for i, f in enumerate(FIELDS) if t[f] is not None), t["target_id"], t["target_set"] or "") for t in targets],
        "key string, target_id long, target_set string",
    )
    shapes = sorted({tuple(i for i, f in enumerate(FIELDS) if t[f] is not None) for t in targets})
    combos = pool.select("sha256", F.explode("combos").alias("c"))
    shaped = combos.select("sha256", F.explode(F.array(*[F.concat_ws(star, *[F.concat(F.lit(f"{i}="), F.col(f"c.{FIELDS[i]}")) for i in shape]) if shape else F.lit("") for shape in shapes])).alias("key"))
    # Target rows are few (MOST_TARGETS at most), so their side is always the broadcast one.
    return shaped.join(F.broadcast(keys), "key").select("sha256", "target_set", "target_id")


def _leaves(pool: DataFrame, targets: list[dict]) -> DataFrame:
    """``(sha256, target_set, leaf)``: the targets of the set that each photo fits, as one text in order of their ids."""
    hits = _hits(pool, targets).groupBy("sha256", "target_set").agg(F.array_sort(F.collect_set("target_id")).alias("fit"))
    return hits.select("sha256", "target_set", F.concat_ws(",", "fit").alias("leaf"))


def stock_of(pool: DataFrame, targets: list[dict]) -> tuple[int, dict[str, dict[tuple[int, ...], int]]]:
    """Size of the pool, and of each target set the number of photos in each leaf."""
    # A target of its own set without fields counts the pool itself, in the same pass.
    every = {"target_id": -1, "target_set": "\0"} | dict.fromkeys(FIELDS)
    counted = _leaves(pool, [*targets, every]).groupBy("target_set", "leaf").count().limit(MOST_LEAVES + 1).collect()
    if len(counted) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    stock: dict[str, dict[tuple[int, ...], int]] = defaultdict(dict)
    for name, leaf, n in counted:
        stock[name][tuple(map(int, leaf.split(",")))] = n
    return sum(stock.pop("\0", {}).values()), dict(stock)


@dataclass
class Allocation:
    """Of one target set: what each target needs, how many photos fit it, and how many each leaf gives to it."""

    need: dict[int, float]
    wanted: dict[int, int]
    available: dict[int, int]
    given: dict[tuple[int, tuple[int, ...]], int]


def allocate(targets: list[dict], size: int, stock: dict[tuple[int, ...], int]) -> Allocation:
    """Allocation of one target set from the leaves' stock.

    First every target is given what it wants as far as stock goes, the narrowest first; what one lacks is freed by moving
    others to leaves that it can't use, so that no target goes short while stock could be moved. What still lacks passes,
    going up the tree (queryvariant, query, cohort), first to siblings with spare stock, then to cousins, in proportion to
    their spare. Remainders go to the largest fractions, ties to the smaller target_id.
    """
    ids = [t["target_id"] for t in targets]
    need = {t["target_id"]: max(t["share"] * t["sample_rate"] * size, float(t["min_rows"])) for t in targets}
    wanted = {i: math.ceil(n - 1e-9) for i, n in need.items()}
    own: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for leaf in sorted(stock):
        for i in leaf:
            own[i].append(leaf)
    available = {i: sum(stock[x] for x in own[i]) for i in ids}
    free = dict(stock)
    given: dict[tuple[int, tuple[int, ...]], int] = defaultdict(int)

    def take(i: int, leaf: tuple[int, ...], n: int) -> None:
        given[i, leaf] += n
        free[leaf] -= n

    for i in sorted(ids, key=lambda i: (available[i], i)):
        lacks = wanted[i]
        for leaf in sorted(own[i], key=lambda x: (len(x), x)):
            n = min(lacks, free[leaf])
            take(i, leaf, n)
            lacks -= n
        while lacks > 0 and (n := _reroute(i, lacks, own, free, given)):
            lacks -= n

    def spread(amount: int, among: list[int]) -> int:
        """Gives up to ``amount`` of the free stock to targets of ``among``; each leaf's to the smallest of them that it fits."""
        spare = defaultdict(list)
        for leaf, n in sorted(free.items()):
            fit = [i for i in leaf if i in among]
            if n and fit:
                spare[fit[0]].append(leaf)
        total = {i: sum(free[x] for x in leaves) for i, leaves in sorted(spare.items())}
        amount = min(amount, sum(total.values()))
        part = {i: amount * n / sum(total.values()) for i, n in total.items()}
        more = {i: min(int(x), total[i]) for i, x in part.items()}
        for i in sorted(part, key=lambda i: (-(part[i] - int(part[i])), i)):
            if sum(more.values()) >= amount:
                break
            more[i] += more[i] < total[i]
        for i, n in more.items():
            for leaf in spare[i]:
                k = min(n, free[leaf])
                take(i, leaf, k)
                n -= k
        return amount

    lacks = {i: wanted[i] - sum(given[i, x] for x in own[i]) for i in ids}
    path = {t["target_id"]: tuple(t[f] or "" for f in FIELDS) for t in targets}
    for depth in range(len(FIELDS) - 1, -1, -1):
        families: dict[tuple, list[int]] = defaultdict(list)
        for i in ids:
            families[path[i][:depth]].append(i)
        for family in [families[k] for k in sorted(families)]:
            amount = sum(lacks[i] for i in family)
            moved = spread(amount, set(family)) if amount else 0
            for i in sorted(family):
                n = min(moved, lacks[i])
                lacks[i], moved = lacks[i] - n, moved - n
    return Allocation(need, wanted, available, {k: n for k, n in given.items() if n})


def _reroute(i: int, most: int, own: dict, free: dict, given: dict) -> int:
    """Stock for target ``i`` by moving other targets to free leaves along a shortest chain; how much was gained."""
    came: dict[object, object] = {}
    queue = deque(own[i])
    came.update(dict.fromkeys(own[i], i))
    while queue:
        leaf = queue.popleft()
        if free[leaf] > 0:
            chain, at = [leaf], came[leaf]
            while at != i:
                chain += [at, came[at]]
                at = came[came[at]]
            n = min([most, free[leaf], *[given[chain[k + 1], chain[k + 2]] for k in range(0, len(chain) - 2, 2)]])
            free[leaf] -= n
            for k in range(0, len(chain) - 2, 2):
                given[chain[k + 1], chain[k]] += n
                given[chain[k + 1], chain[k + 2]] -= n
            given[i, chain[-1]] += n
            return n
        for t in leaf:
            if t != i and t not in came and given.get((t, leaf), 0) > 0:
                came[t] = leaf
                for x in own[t]:
                    if x not in came:
                        came[x] = t
                        queue.append(x)
    return 0


def _plans(pool: DataFrame, targets: list[dict]) -> dict[str, tuple[list[dict], Allocation]]:
    size, stock = stock_of(pool, targets)
    out = {}
    for name in sorted({t["target_set"] or "" for t in targets}):
        own = [t for t in targets if (t["target_set"] or "") == name]
        out[name] = own, allocate(own, size, stock.get(name, {}))
    return out


def quota_report(manifest: DataFrame, images: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: ``(target_id, target_set, need, available, wanted, allocated, possible, met)``.

    ``need`` is the larger of ``share * sample_rate *`` pool size (not rounded) and ``min_rows``, ``available`` the photos of
    the pool that fit the target, ``possible`` whether they suffice. ``allocated`` is what ``quota_sample`` draws for it: a
    photo serves one target of a set. ``met`` tells whether that reaches the need. A photo collected often counts once.
    Null fields of a target are open; null share and min_rows count as 0, a null sample_rate as 1; repeated targets count
    once. An empty pool meets only targets that want nothing. Names compare without case and white space. Extra columns
    are ignored.
    """
    out = []
    for name, (own, plan) in _plans(photo_pool(manifest, images), _targets(targets)).items():
        got = defaultdict(int)
        for (i, _), n in plan.given.items():
            got[i] += n
        for t in own:
            i = t["target_id"]
            out.append((i, name, plan.need[i], plan.available[i], plan.wanted[i], got[i], plan.available[i] >= plan.need[i], got[i] >= plan.need[i]))
    return manifest.sparkSession.createDataFrame(out, "target_id long, target_set string, need double, available long, wanted long, allocated long, possible boolean, met boolean")


def unmet_targets(manifest: DataFrame, images: DataFrame, targets: DataFrame) -> DataFrame:
    """``(target_id)`` of the targets that cannot be met: their leaves hold too few photos; see ``quota_report``."""
    return quota_report(manifest, images, targets).where(~F.col("possible")).select("target_id")


def quota_sample(manifest: DataFrame, images: DataFrame, targets: DataFrame, seed: str = "sample") -> DataFrame:
    """``(target_set, target_id, sha256)``: the drawn photos, each at most once in a target set, as many as reported.

    In each leaf the photos are ranked by a keyed hash, a random permutation that is the same on every run; the first go
    to the leaf's first target and so on. Ranks are counted over hash buckets, so that no task holds a whole leaf however
    large it is. The inputs are treated as by ``quota_report``.
    """
    spark = manifest.sparkSession
    rows = _targets(targets)
    pool = photo_pool(manifest, images)
    ranges = []
    for name, (_, plan) in (_plans(pool, rows) if rows else {}).items():
        at: dict[tuple[int, ...], int] = defaultdict(int)
        for (i, leaf), n in sorted(plan.given.items()):
            ranges.append((name, ",".join(map(str, leaf)), i, at[leaf], at[leaf] + n))
            at[leaf] += n
    if not ranges:
        return spark.createDataFrame([], "target_set string, target_id long, sha256 string")
    # As many rows as pairs of a target and a leaf: bounded by MOST_LEAVES times the targets of a leaf.
    shares = F.broadcast(spark.createDataFrame(ranges, "target_set string, leaf string, target_id long, lo long, hi long"))
    ends = F.broadcast(shares.groupBy("target_set", "leaf").agg(F.max("hi").alias("most")))
    placed = _leaves(pool, rows).withColumn("h", F.xxhash64(F.lit(seed), "target_set", "sha256")).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    per = placed.groupBy("target_set", "leaf", "bucket").agg(F.count("*").alias("n"))
    # 2 ** BUCKET_BITS rows a leaf at most: a bounded window.
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("target_set", "leaf").orderBy("bucket")) - F.col("n")).join(ends, ["target_set", "leaf"]).where("before < most").drop("n", "most")
    within = F.row_number().over(Window.partitionBy("target_set", "leaf", "bucket").orderBy("h", "sha256"))
    ranked = placed.join(before, ["target_set", "leaf", "bucket"]).withColumn("rank", F.col("before") + within - 1)
    return ranked.join(shares, ["target_set", "leaf"]).where("rank >= lo and rank < hi").select("target_set", "target_id", "sha256")
