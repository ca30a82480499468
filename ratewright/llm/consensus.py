"""Consensus of several raters' labels by confidence-aware truth discovery, with each rater's way of scoring learnt.

A score is coded by the steps it takes (over 1, over 2, ...), and a rater's response to a level on an axis is the mean code
of its scores at that level. The distance of a label from a level is the squared distance of its code from the rater's
response, so a rater that shifts, reverses or squeezes the scale informs as much as an exact one, and one that scores at
random informs nothing. Two steps alternate. Given the levels, each rater and axis has an error variance, its mean distance;
the upper bound of its chi-squared interval gives the weight, so that a contributor with few labels weighs little however
well they fit. Given the weights, an item's level is the one with the least weighted distance to all its labels.

Labels are laid out once in blocks of whole items; a round is one pass over them and one sum per rater. The raters' table is
broadcast while it has at most ``MOST_RATERS`` rows, beyond that it is joined by shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratewright.common import attach, heavy_bound, materialize, norm_key, release

LEVELS = 5
MIDDLE = (LEVELS - 1) / 2
ALPHA = 0.05
#: Pseudo-labels around a rater's line that fill up its response at each level.
KAPPA = 2.5
#: Pseudo-labels that pull a rater's line on an axis to its line on all axes, and that to the identity.
RIDGE = 4.0
#: Probabilities of levels are the exponentials of so many times the negative weighted distance.
SHARPNESS = 2.0
#: Rounds with probabilities of levels; after them levels are whole, until none changes, in ``ROUNDS`` rounds at most.
SOFT_ROUNDS = 8
ROUNDS = 60
#: Most raters' rows (rater and axis) that are broadcast.
MOST_RATERS = 200_000
#: Labels of a block.
BLOCK = 50_000

CELLS = [f"c{k}{s}" for k in range(LEVELS) for s in range(LEVELS)]
WIDE = LEVELS * LEVELS


def chi_squared_quantile(q: float, degrees: np.ndarray) -> np.ndarray:
    """Wilson and Hilferty's approximation."""
    z = NormalDist().inv_cdf(q)
    return degrees * np.maximum(1 - 2 / (9 * degrees) + z * np.sqrt(2 / (9 * degrees)), 0.1) ** 3


def clean_labels(labels: DataFrame) -> DataFrame:
    """``(image_id, axis, rater, score, labelled_at)``: usable labels, each as often as it was delivered, in the shared folder."""
    keys = [norm_key(c).alias(c) for c in ("image_id", "axis", "rater")]
    # Keys are filtered once they are written: a filter before would be evaluated with the keys a second time.
    usable = labels.select("image_id", "axis", "rater", F.col("score").cast("int").alias("score"), "labelled_at").where(F.col("score").between(1, LEVELS))
    return materialize(usable.select(*keys, "score", "labelled_at"), "labels")


def _line(n: np.ndarray, s: np.ndarray, a0: np.ndarray, b0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ridge line of scores on levels (both centred at the middle level) from counts ``n`` and score sums ``s`` by level."""
    x = np.arange(LEVELS) - MIDDLE
    sw, sx, sxx = n.sum(1) + RIDGE, n @ x, n @ x**2 + RIDGE * 1.2
    sy, sxy = s.sum(1) + RIDGE * a0, s @ x + RIDGE * 1.2 * b0
    det = sw * sxx - sx * sx
    return (sy * sxx - sxy * sx) / det, (sw * sxy - sx * sy) / det


def rater_parameters(cells: np.ndarray, n_all: np.ndarray, s_all: np.ndarray, bounded: bool = True) -> dict[str, np.ndarray]:
    """What follows from soft counts of (level, score) of each rater and axis, ``cells`` (rows, 25).

    ``n_all`` and ``s_all`` (rows, 5) are the counts and score sums by level of the same rater on all axes. ``costs`` are
    the weighted distances of each score from each level. ``bounded`` false takes the error variance itself, not its bound.
    """
    lv = np.arange(LEVELS, dtype=float)
    c = cells.reshape(-1, LEVELS, LEVELS)
    n, s, q = c.sum(2), c @ lv, c @ lv**2
    a0, b0 = _line(n_all, s_all, np.full(len(c), MIDDLE), np.ones(len(c)))
    a, slope = _line(n, s, a0, b0)
    line = np.clip(a[:, None] + slope[:, None] * (lv - MIDDLE), 0, LEVELS - 1)
    mu = (s + KAPPA * line) / (n + KAPPA)
    nu = np.maximum(n.sum(1), 1.0)
    lower = chi_squared_quantile(ALPHA / 2, nu) if bounded else nu
    spread = (np.maximum((q - 2 * mu * s + mu**2 * n).sum(1), 0) + 0.05) / lower
    around = np.exp(-((lv[None, None, :] - mu[:, :, None]) ** 2) / spread[:, None, None] / 2) + 1e-3
    around /= around.sum(2, keepdims=True)
    response = (c + KAPPA * around) / (n[:, :, None] + KAPPA)
    steps = np.cumsum(response, 2)[:, :, None, :-1]
    code = (lv[None, :-1] >= lv[:, None])[None, None]
    distance = ((code - steps) ** 2).sum(3)
    variance = ((c * distance).sum((1, 2)) + 0.05) / lower
    weight = np.log1p(1 / variance)
    share = n / n.sum(1, keepdims=True).clip(1e-9)
    explained = np.maximum((share * mu**2).sum(1) - (share * mu).sum(1) ** 2, 0)
    return {
        "costs": (weight[:, None, None] * distance).reshape(-1, WIDE), "n": n.sum(1), "weight": weight, "error_variance": variance,
        "shift": (share * (mu - lv)).sum(1), "slope": slope, "reliability": explained / (explained + spread),
    }


def probabilities(costs: np.ndarray, prior: np.ndarray) -> np.ndarray:
    like = np.log(np.maximum(prior, 1e-9)) - SHARPNESS * costs
    p = np.exp(like - like.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@dataclass
class State:
    """What decides the levels: at first each rater's mean score, then the raters' costs."""

    own: np.ndarray
    scale: float = 1.0
    mean: float = MIDDLE
    costs: np.ndarray | None = None
    prior: np.ndarray | None = None
    whole: bool = False
    #: Summed costs of items too large for one block, or their summed deviations and counts at first.
    large: np.ndarray | None = None

    def sums(self, item: np.ndarray, rk: np.ndarray, s: np.ndarray, items: int) -> np.ndarray:
        """By item, what ``levels`` needs; additive over an item's labels."""
        if self.costs is None:
            return np.column_stack([np.bincount(item, s - self.own[rk], items), np.bincount(item, minlength=items)])
        return np.column_stack([np.bincount(item, self.costs[rk, k * LEVELS + s], items) for k in range(LEVELS)])

    def levels(self, sums: np.ndarray) -> np.ndarray:
        if self.costs is None:
            z = sums[:, 0] / np.maximum(sums[:, 1], 1) * self.scale + self.mean
            return probabilities((z[:, None] - np.arange(LEVELS)) ** 2 / SHARPNESS, np.full(LEVELS, 1 / LEVELS))
        return probabilities(sums, self.prior)

    def used(self, p: np.ndarray) -> np.ndarray:
        return np.eye(LEVELS)[p.argmax(1)] if self.whole else p


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of labels of whole items from rows sorted by item ``(large, image_id, axis, rk, score)``."""
    fields = ["large", "counts", "rk", "s", "image_id", "axis"]

    def emit(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        names = t.take(pa.array(starts))
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        counts = np.diff(np.r_[starts, t.num_rows]).astype(np.int32)
        s = (np.asarray(t.column("score")) - 1).astype(np.int8)
        lists = [pa.array(counts), t.column("rk").combine_chunks(), pa.array(s), names.column("image_id").combine_chunks(), names.column("axis").combine_chunks()]
        return pa.RecordBatch.from_arrays([t.column("large")[:1].combine_chunks(), *map(whole, lists)], names=fields)

    held: pa.Table | None = None
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held.num_rows < BLOCK:
            continue
        starts = _starts(held)
        if held.column("large")[0].as_py() >= 0:
            cut = held.num_rows
        elif len(starts) > 1:
            cut = int(starts[-1])
        else:
            continue
        for lo, hi in _of_one_kind(held.slice(0, cut)):
            part = held.slice(lo, hi - lo)
            yield emit(part, _starts(part))
        held = held.slice(cut)
    if held is not None and held.num_rows:
        for lo, hi in _of_one_kind(held):
            part = held.slice(lo, hi - lo)
            yield emit(part, _starts(part))


def _starts(t: pa.Table) -> np.ndarray:
    """Row numbers at which an item begins."""
    i, a = (np.asarray(t.column(c).combine_chunks().dictionary_encode().indices) for c in ("image_id", "axis"))
    return np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (a[1:] != a[:-1])])


def _of_one_kind(t: pa.Table) -> list[tuple[int, int]]:
    """Spans of rows of one large item each, or of small items."""
    k = np.asarray(t.column("large"))
    cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
    return list(zip(cuts, cuts[1:]))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """``(large, item, rk, s, items)`` of each block."""
    for b in batches:
        for r in range(b.num_rows):
            counts, rk, s = (np.asarray(b.column(c)[r].values) for c in ("counts", "rk", "s"))
            yield b.column("large")[r].as_py(), np.repeat(np.arange(len(counts)), counts), rk, s, len(counts)


class Blocks:
    """The labels in blocks, with what is known of the raters; runs the rounds."""

    def __init__(self, clean: DataFrame, raters: pd.DataFrame, large: pd.DataFrame):
        spark = clean.sparkSession
        self.raters, self.large = raters, large
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        keyed = F.broadcast(spark.createDataFrame(raters[["rater", "axis", "rk"]], "rater string, axis string, rk int"))  # MOST_RATERS at most
        names = F.broadcast(spark.createDataFrame(large[["image_id", "axis", "large"]], "image_id string, axis string, large int"))  # 5000 at most
        rows = clean.join(names, ["image_id", "axis"], "left")
        # Small items: one shuffle by item serves both the distinct labels and the blocks.
        small = rows.where("large is null").drop("large").repartition(parts, "image_id", "axis").distinct().withColumn("large", F.lit(-1))
        big = rows.where("large is not null").select("image_id", "axis", "rater", "score", "labelled_at", "large").distinct()
        columns = ["large", "image_id", "axis", "rk", "score"]
        shape = "large int, counts array<int>, rk array<int>, s array<tinyint>, image_id array<string>, axis array<string>"
        packed = small.join(keyed, ["rater", "axis"]).select(columns).sortWithinPartitions("image_id", "axis").mapInArrow(_pack, shape)
        if len(large):
            packed = packed.unionByName(big.join(keyed, ["rater", "axis"]).select(columns).repartition(parts).sortWithinPartitions("large").mapInArrow(_pack, shape))
        self.table = materialize(packed, "blocks")
        self.rounds = self.table.select("large", "counts", "rk", "s")

    def means(self) -> tuple[np.ndarray, float]:
        """Each rater's mean score, pulled to the middle, and the mean of all scores, both from 0."""
        raters = len(self.raters)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, t = np.zeros(raters), np.zeros(raters)
            for _, _, rk, s, _ in _each(batches):
                n += np.bincount(rk, minlength=raters)
                t += np.bincount(rk, s, raters)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(t[some])], names=["rk", "n", "t"])

        got = self.rounds.mapInArrow(sums, "rk int, n double, t double").groupBy("rk").agg(F.sum("n"), F.sum("t")).toPandas().to_numpy()
        n, t = np.zeros(raters), np.zeros(raters)
        at = got[:, 0].astype(int)
        n[at], t[at] = got[:, 1], got[:, 2]
        return (t + 3 * MIDDLE) / (n + 3), float(t.sum() / n.sum()) if n.sum() else MIDDLE

    def _large(self, state: State) -> State:
        """The state with the sums of items that are spread over blocks: one row each."""
        if not len(self.large):
            return state
        width = 2 if state.costs is None else LEVELS

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for large, item, rk, s, items in _each(batches):
                yield pa.RecordBatch.from_arrays([pa.array([large], pa.int32()), pa.array(state.sums(item, rk, s, items).tolist())], names=["large", "v"])

        got = self.rounds.where("large >= 0").mapInArrow(sums, "large int, v array<double>").groupBy("large").agg(*[F.sum(F.element_at("v", i + 1)).alias(f"v{i}") for i in range(width)]).toPandas().sort_values("large")
        return replace(state, large=got[[f"v{i}" for i in range(width)]].to_numpy(float))

    def spread(self, state: State) -> State:
        """The first state, its scale set by the spread of items' deviations."""
        state = self._large(state)

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = np.zeros(3)
            for large, item, rk, s, items in _each(batches):
                if large < 0:
                    x = state.sums(item, rk, s, items)
                    d = x[:, 0] / np.maximum(x[:, 1], 1)
                    t += [len(d), d.sum(), (d**2).sum()]
            yield pa.RecordBatch.from_arrays([pa.array([t.tolist()])], names=["v"])

        t = np.array(self.rounds.mapInArrow(moments, "v array<double>").agg(*[F.sum(F.element_at("v", i + 1)) for i in range(3)]).first(), float)
        if state.large is not None:
            d = state.large[:, 0] / np.maximum(state.large[:, 1], 1)
            t += [len(d), d.sum(), (d**2).sum()]
        sd = np.sqrt(max(t[2] / t[0] - (t[1] / t[0]) ** 2, 0)) if t[0] else 0.0
        return replace(state, scale=1.1 / max(sd, 1e-3))

    def count(self, state: State, before: State | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Soft counts of (level, score) by rater, mean level probabilities, and how many items' levels differ from ``before``."""
        raters = len(self.raters)

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, own = np.zeros((raters, WIDE)), np.zeros(WIDE)
            for large, item, rk, s, items in _each(batches):
                if large >= 0:
                    p = state.levels(state.large[large : large + 1])
                else:
                    p = state.levels(state.sums(item, rk, s, items))
                    moved = 0 if before is None else (before.levels(before.sums(item, rk, s, items)).argmax(1) != p.argmax(1)).sum()
                    own[: LEVELS + 2] += [*state.used(p).sum(0), items, moved]
                p = state.used(p)
                for k in range(LEVELS):
                    c[:, k * LEVELS : (k + 1) * LEVELS] += np.bincount(rk * LEVELS + s, p[item, k], raters * LEVELS).reshape(raters, LEVELS)
            some = np.flatnonzero(c.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1].astype(np.int32)), pa.array([*c[some].tolist(), own.tolist()], pa.list_(pa.float64()))], names=["rk", "v"])

        summed = self.rounds.mapInArrow(counts, "rk int, v array<double>").groupBy("rk").agg(*[F.sum(F.element_at("v", i + 1)).alias(f"v{i}") for i in range(WIDE)]).toPandas()
        cells = np.zeros((raters + 1, WIDE))
        cells[summed["rk"].to_numpy()] = summed.drop(columns="rk").to_numpy()
        own = cells[-1]
        if state.large is not None:
            p = state.levels(state.large)
            moved = 0 if before is None else (before.levels(before.large).argmax(1) != p.argmax(1)).sum()
            own[: LEVELS + 2] += [*state.used(p).sum(0), len(p), moved]
        return cells[:-1], own[:LEVELS] / max(own[LEVELS], 1), int(own[LEVELS + 1])

    def discover(self, rounds: int, bounded: bool) -> tuple[DataFrame, pd.DataFrame]:
        r = self.raters
        rh = pd.factorize(r["rater"])[0]
        lv = np.arange(LEVELS, dtype=float)
        own, mean = self.means()
        state, before = self.spread(State(own, mean=mean)), None
        got: dict[str, np.ndarray] = {}
        for n in range(rounds + 1):
            cells, shares, moved = self.count(state, before)
            if n > SOFT_ROUNDS and not moved or n == rounds:
                break
            c = cells.reshape(-1, LEVELS, LEVELS)
            n_all, s_all = (np.zeros((int(rh.max(initial=-1)) + 1, LEVELS)) for _ in range(2))
            np.add.at(n_all, rh, c.sum(2))
            np.add.at(s_all, rh, c @ lv)
            got = rater_parameters(cells, n_all[rh], s_all[rh], bounded)
            before, state = state, self._large(replace(state, costs=got["costs"], prior=shares, whole=n + 1 >= SOFT_ROUNDS))
        if moved:
            warnings.warn(f"{moved} items changed their level in the last of {rounds} rounds", stacklevel=3)
        fields = ["n", "weight", "error_variance", "shift", "slope", "reliability"]
        described = pd.DataFrame({"rater": r["rater"], "axis": r["axis"]} | {f: got.get(f, np.zeros(len(r))) for f in fields})
        return self._items(state, before), described

    def _items(self, state: State, before: State | None) -> DataFrame:
        """``(image_id, axis, p, stable, raters, labels, same)`` of every item."""
        shape = "image_id string, axis string, p array<double>, stable boolean, raters long, labels long, same long"
        names = [f.split()[0] for f in shape.split(", ")]

        def same_levels(p: np.ndarray, old: np.ndarray | None) -> np.ndarray:
            return np.ones(len(p), bool) if old is None else old.argmax(1) == p.argmax(1)

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r, (large, item, rk, s, items) in enumerate(_each([b])):
                    if large >= 0:
                        continue
                    p = state.levels(state.sums(item, rk, s, items))
                    old = None if before is None else before.levels(before.sums(item, rk, s, items))
                    pairs = np.unique(item * np.int64(1 << 32) + rk)
                    cells = np.bincount(item * LEVELS + s, minlength=items * LEVELS).reshape(items, LEVELS)
                    columns = [b.column(c)[r].values for c in ("image_id", "axis")]
                    yield pa.RecordBatch.from_arrays([
                        *columns, pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(same_levels(p, old)),
                        pa.array(np.bincount(pairs >> 32, minlength=items)), pa.array(cells.sum(1)), pa.array((cells * (cells - 1)).sum(1)),
                    ], names=names)

        small = self.table.mapInArrow(finish, shape)
        if state.large is None:
            return small
        p = state.levels(state.large)
        stable = same_levels(p, None if before is None else before.levels(before.large))
        rows = [(i, a, x.tolist(), bool(st), int(n), int(m), int(e)) for i, a, n, m, e, x, st in zip(*(self.large[c] for c in ("image_id", "axis", "raters", "labels", "same")), p, stable)]
        return small.unionByName(self.table.sparkSession.createDataFrame(rows, shape))


def _summaries(clean: DataFrame) -> DataFrame:
    """``(image_id, axis, raters, labels, same)`` from distinct labels."""
    per = clean.groupBy("image_id", "axis", "score").agg(F.count("*").alias("c")).groupBy("image_id", "axis").agg(F.sum("c").alias("labels"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    raters = clean.select("image_id", "axis", "rater").distinct().groupBy("image_id", "axis").agg(F.count("*").alias("raters"))
    return per.join(raters, ["image_id", "axis"])


def discover(labels: DataFrame, rounds: int = ROUNDS, most_raters: int = MOST_RATERS, bounded: bool = True, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(items, raters)``: level probabilities and label counts per item, parameters per rater and axis.

    Starts from scores freed of each rater's mean. Ends when no item's level changes any more; if some still do after
    ``rounds`` rounds, warns with their number, and their ``stable`` is false. Items with over ``hot`` labels, of which
    there are at most 5000 (see ``heavy_bound``), are spread over blocks. With more than ``most_raters`` rows of raters the
    same rounds run by shuffle joins.
    """
    spark = labels.sparkSession
    held = clean_labels(labels)
    clean = held.where("image_id is not null and axis is not null and rater is not null")
    raters = clean.select("rater", "axis").distinct().limit(most_raters + 1).toPandas()
    if len(raters) > most_raters:
        return _discover_shuffled(clean.distinct(), rounds, bounded)
    raters = raters.sort_values(["rater", "axis"]).reset_index(drop=True)
    raters["rk"] = np.arange(len(raters), dtype=np.int32)
    counted = clean.groupBy("image_id", "axis").agg(F.count("*").alias("n"))
    if hot is None:
        hot = heavy_bound(int(counted.agg(F.sum("n")).first()[0] or 0), least=2_000_000)
    hottest = counted.where(F.col("n") > hot).select("image_id", "axis")
    large = _summaries(clean.distinct().join(F.broadcast(hottest), ["image_id", "axis"], "left_semi")).toPandas().sort_values(["image_id", "axis"]).reset_index(drop=True)
    large["large"] = np.arange(len(large), dtype=np.int32)
    items, described = Blocks(clean, raters, large).discover(rounds, bounded)
    release(held)
    described = described.astype({"n": "int64"})
    return items, spark.createDataFrame(described, "rater string, axis string, n long, weight double, error_variance double, shift double, slope double, reliability double")


PARAMETERS = "rk long, n long, costs array<double>, weight double, error_variance double, shift double, slope double, reliability double"


def _normal(values: str) -> Column:
    """Log-likelihoods as probabilities."""
    e = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def _keyed(clean: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels by long keys ``(ik, rk, rh, score)``, and the names behind item and rater keys.

    Keys are hashes; that no two names share one is checked, and another seed taken if they do.
    """
    for seed in range(20):
        s = F.lit(seed)
        keys = [F.xxhash64(s, "image_id", "axis").alias("ik"), F.xxhash64(s, "rater", "axis").alias("rk"), F.xxhash64(s, "rater").alias("rh")]
        full = materialize(clean.select("*", *keys), "keyed")
        items = materialize(full.select("ik", "image_id", "axis").distinct(), "item-names")
        raters = materialize(full.select("rk", "rh", "rater", "axis").distinct(), "rater-names")
        if items.count() == items.select("ik").distinct().count() and raters.count() == raters.select("rk").distinct().count() and raters.select("rater").distinct().count() == raters.select("rh").distinct().count():
            return full, items, raters
        for x in (full, items, raters):
            release(x)
    raise RuntimeError("no seed keeps all keys apart")


def _start(rows: DataFrame, total: int) -> DataFrame:
    """First level probabilities: each item's mean score after taking off every rater's own mean on the axis."""
    means = rows.groupBy("rk").agg(F.count("*").alias("n"), ((F.sum(F.col("score") - 1) + 3 * MIDDLE) / (F.count("*") + 3)).alias("own"))
    off = attach(rows, means, "rk", "n", total).select("ik", (F.col("score") - 1 - F.col("own")).alias("d"))
    centred = materialize(off.groupBy("ik").agg(F.count("*").alias("items_n"), F.avg("d").alias("d")), "centred")
    sd = centred.agg(F.stddev_pop("d")).first()[0]
    mean = rows.agg(F.avg(F.col("score") - 1)).first()[0]
    z = F.col("d") * (1.1 / max(sd or 0.0, 1e-3)) + F.lit(float(MIDDLE if mean is None else mean))
    like = F.array(*[-((z - k) * (z - k)) for k in range(LEVELS)])
    out = materialize(centred.withColumn("l", like).select("ik", "items_n", _normal("l").alias("p"), F.lit(0).alias("moved")), "items")
    release(centred)
    return out


def _discover_shuffled(clean: DataFrame, rounds: int, bounded: bool) -> tuple[DataFrame, DataFrame]:
    """The same rounds with the raters' table joined to the labels, hot raters and items by broadcast (see ``attach``)."""
    full, item_names, rater_names = _keyed(clean)
    rows = full.select("ik", "rk", "rh", "score")
    total = rows.count()
    items, raters = _start(rows, total), None

    def parameters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sides = (b[[f"{x}{k}" for k in range(LEVELS)]].to_numpy(float) for x in "ns")
            got = rater_parameters(b[CELLS].to_numpy(float), *sides, bounded)
            yield pd.DataFrame({"rk": b["rk"], "n": b["n"]} | {k: list(v) if k == "costs" else v for k, v in got.items() if k != "n"})

    level = F.array_position("p", F.array_max("p")).cast("int")
    for n in range(rounds):
        whole = n >= SOFT_ROUNDS
        share = (lambda k: (level == k + 1).cast("double")) if whole else (lambda k: F.element_at("p", k + 1))
        soft = attach(rows, items, "ik", "items_n", total)
        by_score = soft.groupBy("rk", "rh", "score").agg(F.count("*").alias("n"), *[F.sum(share(k)).alias(f"p{k}") for k in range(LEVELS)])
        cells = [F.coalesce(F.sum(F.when(F.col("score") == s + 1, F.col(f"p{k}"))), F.lit(0.0)).alias(f"c{k}{s}") for k in range(LEVELS) for s in range(LEVELS)]
        wide = by_score.groupBy("rk", "rh").agg(F.sum("n").alias("n"), *cells)
        over = Window.partitionBy("rh")  # as many rows as there are axes
        sums = [F.sum(sum(F.col(f"c{k}{s}") for s in range(LEVELS))).over(over).alias(f"n{k}") for k in range(LEVELS)]
        sums += [F.sum(sum(F.col(f"c{k}{s}") * s for s in range(LEVELS))).over(over).alias(f"s{k}") for k in range(LEVELS)]
        release(raters)
        raters = materialize(wide.select("*", *sums).mapInPandas(parameters, PARAMETERS), "raters")
        prior = [x or 1 / LEVELS for x in items.select(*[F.avg(share(k)) for k in range(LEVELS)]).first()]
        rated = attach(rows.select("ik", "rk", "score"), raters.select("rk", "n", "costs"), "rk", "n", total)
        scored = rated.select("ik", *[F.element_at("costs", F.col("score") + k * LEVELS).alias(f"l{k}") for k in range(LEVELS)])
        like = F.array(*[F.lit(float(np.log(max(prior[k], 1e-9)))) - SHARPNESS * F.sum(f"l{k}") for k in range(LEVELS)])
        after = scored.groupBy("ik").agg(F.count("*").alias("items_n"), like.alias("l")).select("ik", "items_n", _normal("l").alias("p"))
        was = items.select("ik", level.alias("was"))
        after = materialize(after.join(was, "ik").withColumn("moved", (level != F.col("was")).cast("int")).drop("was"), "items")
        release(items)
        items = after
        moved = items.agg(F.sum("moved")).first()[0] or 0
        if n >= SOFT_ROUNDS and not moved:
            break
    else:
        if moved:
            warnings.warn(f"{moved} items changed their level in the last of {rounds} rounds", stacklevel=3)
    out = items.join(item_names, "ik").select("image_id", "axis", "p", (F.col("moved") == 0).alias("stable")).join(_summaries(full), ["image_id", "axis"])
    return out, raters.join(rater_names, "rk").drop("rk", "rh", "costs")


def consensus(labels: DataFrame, rounds: int = ROUNDS, least_raters: int = 3, **how: object) -> DataFrame:
    """``(image_id, axis, score, confidence, stable, raters, labels, agreement)`` of each item with ``least_raters`` or more.

    ``score`` is the level of least weighted distance to all the item's labels (a tie goes to the lower level),
    ``confidence`` its probability, ``stable`` whether it was settled when the rounds ended, ``agreement`` the share of its
    pairs of labels that agree exactly (null for a single label). Items with fewer raters still help to learn the raters.

    A label delivered again (same image, axis, rater, score and time) counts once; one given again at another time is
    another label. Missing or impossible scores and missing keys are left out. Axis, rater and image keys compare without
    case and white space. An empty table gives an empty result, extra columns are ignored.
    """
    items, _ = discover(labels, rounds, **how)
    best = F.array_max("p")
    return items.where(F.col("raters") >= least_raters).select("image_id", "axis", F.array_position("p", best).cast("int").alias("score"), best.alias("confidence"), "stable", "raters", "labels", F.try_divide(F.col("same"), F.col("labels") * (F.col("labels") - 1)).alias("agreement"))


def rater_reliability(labels: DataFrame, rounds: int = ROUNDS, **how: object) -> DataFrame:
    """``(rater, axis, n, weight, error_variance, shift, slope, reliability)``.

    ``error_variance`` is the upper chi-squared bound of the mean squared distance of the rater's scores from its response
    at the consensus, ``weight`` the logarithm of one plus its inverse, ``shift`` and ``slope`` how it scores against the
    consensus, ``reliability`` from 0 to 1 the share of its variance that the items' levels explain.
    """
    return discover(labels, rounds, **how)[1].select("rater", "axis", "n", "weight", "error_variance", "shift", "slope", "reliability")
