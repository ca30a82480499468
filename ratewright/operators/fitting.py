"""Monotone fits, fold assignment and cluster splits.

Fits run per group on distinct values of the measurement, pre-aggregated; fold and split assignment run over cluster sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratewright.common import sorted_positions
from ratewright.operators.summary import order_bucket


def pool_adjacent(points: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Isotonic blocks ``(x, mean, weight)`` of points ``(x, mean y, count)`` with distinct, ascending x.

    A block joins the one before it while that one's mean is larger; equal means stay apart, and a pooled block keeps its
    largest x.
    """
    out: list[list[float]] = []
    for x, y, w in points:
        out.append([x, y, w])
        while len(out) > 1 and out[-2][1] > out[-1][1]:
            x1, y1, w1 = out.pop()
            _, y0, w0 = out.pop()
            out.append([x1, (y0 * w0 + y1 * w1) / (w0 + w1), w0 + w1])
    return [tuple(b) for b in out]


def knots_from_blocks(blocks: list[tuple[float, float, float]], levels: list[int]) -> tuple[list[tuple[float, float]], list[int]]:
    """First x that reaches each level, and the levels never reached. Of equal x the higher level stays."""
    knots: dict[float, float] = {}
    lost = []
    for v in levels:
        hit = blocks[0] if blocks and v <= blocks[0][1] else next((b for b in blocks if b[1] >= v), None)
        if hit is None:
            lost.append(v)
        else:
            knots[hit[0]] = max(knots.get(hit[0], v), v)
    return sorted(knots.items()), lost


def isotonic(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Blocks ``(…, x, fitted, weight)`` of the isotonic fit of ``y`` on ``x`` per group.

    Equal x are averaged first, in Spark, so a group is as large as its number of different x. Null or non-finite values
    are left out. Runs of x are pooled in two steps: within slices of the x range, then over the slices' blocks, which
    gives the same blocks, as pooling may begin anywhere.
    """
    bad = F.col(x).isNull() | F.col(y).isNull() | F.isnan(F.col(x).cast("double"))
    points = rows.where(~bad).groupBy(*by, F.col(x).cast("double").alias("x")).agg(F.avg(F.col(y).cast("double")).alias("fitted"), F.count("*").cast("double").alias("weight"))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)
    shape = f"{kinds}, x double, fitted double, weight double"
    edges = rows.where(~bad).groupBy(*by).agg(F.percentile_approx(F.col(x).cast("double"), [i / 16 for i in range(1, 16)], 1000).alias("edges"))
    sliced = points.join(edges, by).withColumn("slice", F.size(F.filter("edges", lambda e: e < F.col("x")))).drop("edges")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("x")
        blocks = pool_adjacent(list(zip(p["x"], p["fitted"], p["weight"])))
        out = pd.DataFrame(blocks, columns=["x", "fitted", "weight"])
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out[[*by, "x", "fitted", "weight"]]

    first = sliced.groupBy(*by, "slice").applyInPandas(fit, shape)
    return first.groupBy(*by).applyInPandas(fit, shape)


def fitted_knots(rows: DataFrame, by: list[str], x: str, y: str, levels: list[int] = [1, 2, 3, 4, 5]) -> DataFrame:  # noqa: B006
    """Knots per group: ``(…, knots array<struct<x,y>>, unreachable array<int>)``."""
    blocks = isotonic(rows, by, x, y).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "fitted", "weight"))).alias("b"))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [knots_from_blocks([(r["x"], r["fitted"], r["weight"]) for r in b], levels) for b in pdf["b"]]
            out = pdf[by].copy()
            out["knots"] = [[{"x": a, "y": float(c)} for a, c in k] for k, _ in got]
            out["unreachable"] = [u for _, u in got]
            yield out

    return blocks.mapInPandas(run, f"{kinds}, knots array<struct<x:double,y:double>>, unreachable array<int>")


def supported_knots(rows: DataFrame, by: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """``(…, knots)`` of the isotonic fit with knots for those levels only that have ``least`` examples; none if under two have."""
    levels = [1, 2, 3, 4, 5]
    counts = rows.where(F.col(x).isNotNull()).groupBy(*by).agg(F.filter(F.array(*[F.when(F.count_if(F.col(y) == v) >= least, F.lit(v)) for v in levels]), lambda v: v.isNotNull()).alias("__enough"))
    blocks = isotonic(rows, by, x, y).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "fitted", "weight"))).alias("b")).join(counts, by)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[by].copy()
            got = [knots_from_blocks([(r["x"], r["fitted"], r["weight"]) for r in b], list(enough))[0] if len(enough) > 1 else [] for b, enough in zip(pdf["b"], pdf["__enough"])]
            out["knots"] = [[{"x": a, "y": float(c)} for a, c in k] for k in got]
            yield out

    return blocks.mapInPandas(run, f"{kinds}, knots array<struct<x:double,y:double>>")


def calibration_warnings(n: int, mode_share: float, mode_value: float, counts: dict[int, int], knots: list[tuple[float, float]], unreachable: list[int], held_out: float | None, unit: str) -> list[str]:
    """What speaks against a fitted map; a text that begins with STOP forbids its use."""
    out = []
    if mode_share > 0.1:
        out.append(f"{mode_share * 100:.1f}% of images sit on the single value {mode_value:.4f}. A monotone fit cannot separate points that share an x, so that share of the data carries no information however it is labelled.")
    if n < 30:
        out.append(f"only {n} images use this map; the knots are weakly anchored")
    for level in (1, 2, 3, 4, 5):
        k = counts.get(level, 0)
        if k < 5:
            out.append(f"NO example scored {level}, so this map can never output {level}" if k == 0 else f"only {k} example(s) scored {level}, below the 5 needed to anchor a knot")
    out += [f"the fit never reaches {level}; no knot was invented for it" for level in unreachable]
    top = knots[-1] if knots else (0.0, 0.0)
    if top[1] < 4:
        out.append(f"STOP: top knot is {top[0]:.4f} {unit} scoring {top[1]:.2f}, below the floor of 4. Isotonic maps clamp above the top knot, so every larger input would be capped there no matter how good the photograph is.")
    if len(knots) < 2:
        out.append("STOP: the fit collapsed to a single knot, so this map returns one constant for every input. The measurement has no monotone relationship with the labels on this set.")
    if held_out is not None and held_out < 0.3:
        out.append(f"STOP: cross-validated Spearman is {held_out:.3f}. The map does not predict the labels on photographs it has not seen, so shipping it would be shipping noise.")
    if knots and knots[0][1] > 1.5:
        out.append(f"bottom knot is {knots[0][0]:.3f} {unit} scoring {knots[0][1]:.2f}; anything smaller clamps to that rather than scoring 1")
    return out


def folds_by_rank(clusters: DataFrame, cluster: str, folds: int = 5) -> DataFrame:
    """Fold of each cluster: its position in sorted order, modulo ``folds``."""
    return sorted_positions(clusters, cluster).select(cluster, (F.col("position") % folds).cast("int").alias("fold"))


def greedy_bins(sizes: list[tuple[int, str]], bins: int) -> dict[str, int]:
    """Clusters from the largest (ties by id), each to the bin that holds least (ties to the first)."""
    loads = [0] * bins
    out = {}
    for n, c in sorted(sizes, key=lambda s: (-s[0], s[1])):
        b = loads.index(min(loads))
        out[c] = b
        loads[b] += n
    return out


def split_two(sizes: list[tuple[int, str]], ratio: float) -> tuple[dict[str, str] | None, str | None]:
    """Clusters to 'train' or 'test' by which side is further from its target; ``(assignment, reason)``, one of them null."""
    if not 0 < ratio < 1:
        return None, "ratio must be strictly between 0 and 1"
    if len(sizes) < 2:
        return None, f"need at least two clusters to split, found {len(sizes)}"
    total = sum(n for n, _ in sizes)
    want = {"train": total * ratio, "test": total * (1 - ratio)}
    held = {"train": 0, "test": 0}
    out = {}
    for n, c in sorted(sizes, key=lambda s: (-s[0], s[1])):
        short = {s: (want[s] - held[s]) / want[s] for s in want}
        side = "train" if short["train"] >= short["test"] else "test"
        out[c] = side
        held[side] += n
    if not held["train"] or not held["test"]:
        return None, "one side of the split is empty; the clusters are too unbalanced"
    return out, None


def cluster_sizes(rows: DataFrame, cluster: str, most: int = 2_000_000) -> list[tuple[int, str]]:
    """Sizes of all clusters for a greedy assignment on the driver; refuses more than ``most`` (then balance by size
    histogram, as the split operator for related records does)."""
    got = rows.groupBy(cluster).agg(F.count("*").alias("n")).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} clusters")
    return [(r["n"], r[cluster]) for r in got]


def boundary(rows: DataFrame, by: list[str], value: str, label: str, k: int) -> DataFrame:
    """Threshold between labels up to ``k`` and above with the best balanced accuracy: midpoints of neighbouring values,
    ties to the lowest. Null if one side is empty. Counts of distinct values are summed over order buckets and within each,
    so no task holds all values of a group.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count_if(F.col(label) <= k).alias("lo"), F.count_if(F.col(label) > k).alias("hi")).withColumn("bucket", order_bucket(F.col("v")))
    per = c.groupBy(*by, "bucket").agg(F.sum("lo").alias("blo"), F.sum("hi").alias("bhi"), F.min("v").alias("first"))
    over, all_ = Window.partitionBy(*by).orderBy("bucket"), Window.partitionBy(*by)
    per = per.withColumns({"after": F.lead("first").over(over), "slo": F.sum("blo").over(over) - F.col("blo"), "shi": F.sum("bhi").over(over) - F.col("bhi"), "los": F.sum("blo").over(all_), "his": F.sum("bhi").over(all_)})
    w = Window.partitionBy(*by, "bucket").orderBy("v")
    c = c.join(per.drop("blo", "bhi", "first"), [*by, "bucket"])
    c = c.withColumns({"next": F.coalesce(F.lead("v").over(w), "after"), "below": F.col("slo") + F.sum("lo").over(w), "over": F.col("shi") + F.sum("hi").over(w)})
    score = (F.col("below") / F.col("los") + (F.col("his") - F.col("over")) / F.col("his")) / 2
    ok = c.where("next is not null and los > 0 and his > 0").withColumn("t", (F.col("v") + F.col("next")) / 2).withColumn("s", F.round(score, 12))
    return ok.groupBy(*by).agg(F.max(F.struct("s", (-F.col("t")).alias("neg"))).alias("m")).select(*by, (-F.col("m.neg")).alias("threshold"), F.col("m.s").alias("score"))


def apply_thresholds(value: Column, thresholds: list[float]) -> Column:
    """Level 1 plus the number of thresholds below the value, 5 at most."""
    return F.least(F.lit(5), F.lit(1) + sum((F.when(value > t, 1).otherwise(0) for t in thresholds), F.lit(0)))


def enforce_order(values: list[float], step: float = 1e-6) -> list[float]:
    """Strictly rising values: each at least ``step`` over the one before."""
    out: list[float] = []
    for v in values:
        out.append(v if not out or v > out[-1] else out[-1] + step)
    return out
