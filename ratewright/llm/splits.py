"""Splits that keep related records together: components, largest-differencing balance, whole bins to splits."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratewright.common import attach, materialize, norm_key, release
from ratewright.llm.linking import hash_to_min

RELATIONS = ["creator_group", "source_group", "split_group"]
PROPORTIONS = {"development": 0.7, "validation": 0.15, "final_test": 0.15}
BINS = 100


def related_sets(images: DataFrame, relations: list[str] = RELATIONS) -> DataFrame:
    """``(image_id, set_id)`` of every image: images that share any of ``relations`` are in one set, also through others.

    Each key is collapsed to its least image first: every other image that holds it is linked to that one. A key shared by a
    third of all images is met by broadcast, never collected. ``set_id`` is the set's smallest image_id. Keys compare
    without case and white space, each column with itself only; blank and null keys relate nothing. Repeated rows count
    once; rows without an image_id are left out; extra columns are ignored; an empty table gives an empty result.
    """
    held = materialize(images.select(norm_key("image_id").alias("i"), *[norm_key(r).alias(r) for r in relations]), "relations")
    ids = held.where("i is not null")
    keys = ids.select("i", F.posexplode(F.array(*[F.col(r) for r in relations])).alias("p", "k")).where("k is not null")
    hubs = materialize(keys.groupBy("p", "k").agg(F.min("i").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    total = int(hubs.agg(F.sum("n")).first()[0] or 0)
    edges = attach(keys, hubs, ["p", "k"], "n", total).where("i <> hub").select(F.col("i").alias("a"), F.col("hub").alias("b"))
    roots = hash_to_min(edges)
    release(hubs)
    every = ids.select(F.col("i").alias("image_id")).distinct()
    return every.join(roots.withColumnRenamed("vertex", "image_id"), "image_id", "left").select("image_id", F.coalesce("root", "image_id").alias("set_id"))


def parted_sets(images: DataFrame, relations: list[str] = RELATIONS) -> DataFrame:
    """``(image_id, set_id)`` of each image in a related set whose images now hold more than one role.

    An image without a role, or with several, brings none, or all of them, into its set.
    """
    sets = materialize(related_sets(images, relations), "sets")
    roles = images.select(norm_key("image_id").alias("image_id"), norm_key("dataset_role").alias("role")).where("image_id is not null and role is not null").distinct()
    held = sets.join(roles, "image_id").groupBy("set_id").agg(F.min("role").alias("lo"), F.max("role").alias("hi"))
    size = sets.groupBy("set_id").agg(F.count("*").alias("n"))
    mixed = held.where("lo <> hi").join(size, "set_id").select("set_id", "n")
    out = materialize(attach(sets, mixed, "set_id", "n", sets.count()).select("image_id", "set_id"), "parted")
    release(sets)
    return out


def differencing(weights: list[tuple[int, object]], bins: int) -> list[list[object]]:
    """Multi-way largest differencing: spreads weighted items over ``bins`` lists of nearly equal weight.

    Every item starts as a tuple with itself in one bin. The two tuples whose extremes differ most are combined, the
    heaviest bin of one with the lightest of the other, until one is left.
    """
    heap = []
    for n, (w, item) in enumerate(sorted(weights, key=lambda x: (-x[0], str(x[1])))):
        heap.append((-w, n, [w], [[item]]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, w1, m1 = heapq.heappop(heap)
        _, _, w2, m2 = heapq.heappop(heap)
        # Only the loaded bins are kept, heaviest first; the rest weigh nothing.
        if len(w1) + len(w2) <= bins:
            both = [(w, m) for w, m in zip(w1 + w2, m1 + m2)]
        else:
            w1, m1 = w1 + [0] * (bins - len(w1)), m1 + [[] for _ in range(bins - len(m1))]
            w2, m2 = w2 + [0] * (bins - len(w2)), m2 + [[] for _ in range(bins - len(m2))]
            both = [(a + b, x + y) for a, b, x, y in zip(w1, reversed(w2), m1, reversed(m2))]
        both.sort(key=lambda x: -x[0])
        low = both[-1][0] if len(both) == bins else 0
        heapq.heappush(heap, (-(both[0][0] - low), n, [w for w, _ in both], [m for _, m in both]))
        n += 1
    out = heap[0][3] if heap else []
    return out + [[] for _ in range(bins - len(out))]


def bins_to_splits(loads: list[int], proportions: dict[str, float]) -> list[str]:
    """Whole bins to splits, the heaviest first, each to the split that lacks most of its target (ties: as listed)."""
    total, held = sum(loads), dict.fromkeys(proportions, 0)
    out = [""] * len(loads)
    for b in sorted(range(len(loads)), key=lambda b: (-loads[b], b)):
        name = max(proportions, key=lambda s: proportions[s] * total - held[s])
        out[b] = name
        held[name] += loads[b]
    return out


def assign_splits(images: DataFrame, proportions: dict[str, float] = PROPORTIONS, relations: list[str] = RELATIONS, bins: int = BINS, seed: str = "split") -> DataFrame:
    """``(image_id, set_id, dataset_role)``: a role for every image, in ``proportions``, that never parts a related set.

    Sets of one size are alike, so only the histogram of set sizes reaches the driver: N images have fewer than
    ``sqrt(2 N)`` different sizes. Of each size as many sets as fill all ``bins`` evenly are dealt out in turn; the rest,
    fewer than ``bins`` a size, are balanced by largest differencing. Bins then go to splits whole. Sets are numbered
    within their size by a hash, counted over buckets, so no task holds all sets of a size. The outcome depends on the
    images and ``seed`` alone. Proportions must be positive and are scaled to 1.
    """
    if not proportions or min(proportions.values()) <= 0:
        raise ValueError("proportions must be positive")
    spark = images.sparkSession
    proportions = {k: v / sum(proportions.values()) for k, v in proportions.items()}
    sets = materialize(related_sets(images, relations), "sets")
    sized = materialize(sets.groupBy("set_id").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(F.lit(seed), "set_id")).withColumn("bucket", F.shiftrightunsigned("h", 50)), "set-sizes")
    histogram = sorted((r[0], r[1]) for r in sized.groupBy("n").count().collect())
    items = [(n, (n, k)) for n, count in histogram for k in range(count % bins)]
    loads = np.full(bins, sum(n * (count // bins) for n, count in histogram), dtype=np.int64)
    place = {}
    for b, members in enumerate(differencing(items, bins)):
        for n, k in members:
            place[n, k] = b
            loads[b] += n
    split_of = bins_to_splits(loads.tolist(), proportions)
    rest = spark.createDataFrame([(n, k, split_of[b]) for (n, k), b in place.items()], "n long, rest long, rest_role string")
    full = spark.createDataFrame([(n, (count // bins) * bins) for n, count in histogram], "n long, full long")
    per = sized.groupBy("n", "bucket").agg(F.count("*").alias("c"))
    before = per.withColumn("before", F.sum("c").over(Window.partitionBy("n").orderBy("bucket")) - F.col("c")).drop("c")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("n", "bucket").orderBy("h", "set_id")) - 1
    names = F.array(*[F.lit(s) for s in split_of])
    placed = (
        sized.join(before, ["n", "bucket"])
        .withColumn("rank", rank)
        .join(F.broadcast(full), "n")
        .withColumn("rest", F.when(F.col("rank") >= F.col("full"), F.col("rank") - F.col("full")))
        .join(F.broadcast(rest) if len(place) <= 500_000 else rest, ["n", "rest"], "left")
        .select("set_id", "n", F.coalesce("rest_role", F.element_at(names, (F.col("rank") % bins + 1).cast("int"))).alias("dataset_role"))
    )
    placed = materialize(placed, "placed")
    out = materialize(attach(sets, placed, "set_id", "n", sets.count()).select("image_id", "set_id", "dataset_role"), "split")
    for step in (sets, sized, placed):
        release(step)
    return out


def split_report(assigned: DataFrame, proportions: dict[str, float] = PROPORTIONS) -> DataFrame:
    """Images and sets of each role, and its share against the target."""
    spark = assigned.sparkSession
    total = sum(proportions.values())
    targets = F.broadcast(spark.createDataFrame([(k, v / total) for k, v in proportions.items()], "dataset_role string, target double"))
    per = assigned.groupBy("dataset_role", "set_id").agg(F.count("*").alias("n")).groupBy("dataset_role").agg(F.sum("n").alias("images"), F.count("*").alias("sets"))
    return targets.join(per, "dataset_role", "left").withColumn("images", F.coalesce("images", F.lit(0))).withColumn("sets", F.coalesce("sets", F.lit(0))).withColumn("share", F.try_divide(F.col("images"), F.sum("images").over(Window.partitionBy(F.lit(1)))))
