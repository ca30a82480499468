"""Filling containers of fixed capacity: repeat counts by non-negative least squares, then greedy packing of the rest.

The histogram of sizes, never the items, reaches the driver. Shallow combinations of size classes that fill a container up
to a narrow window are enumerated; non-negative least squares finds how often to repeat each, so that together they use up
the histogram. Items are dealt to the repeats by their rank within their class. What rounding leaves over, and the
smallest items, held back on purpose, are packed best fit first into the gaps of the planned containers and into new ones,
in cells of bounded size.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratewright.common import materialize
from ratewright.llm.tokens import FOLDER, encode_texts

CLASSES = 96
#: Share of a container that a combination may leave empty.
WINDOW = 0.02
#: Share of all tokens, in the smallest items, kept for filling gaps.
SAND = 0.04
#: Items and containers of a cell of the greedy step.
CELL = 40_000
#: Largest capacity, hence longest histogram, that is planned on the driver.
MOST_CAPACITY = 1 << 20
MOST_SPECS = 1000


@dataclass
class Plan:
    """Class of each size (-1: not planned), and of each class the ranges of ranks that go to a combination."""

    of_size: np.ndarray
    ranges: list[tuple[int, int, int, int, int]] = field(default_factory=list)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """Least squares ``a x = b`` with ``x`` not negative, by active sets."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    scale = max(float(b.max(initial=0)), 1e-9)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        best = int(np.argmax(w))
        if not len(w) or w[best] <= 1e-9 * scale:
            break
        active.append(best)
        while True:
            z = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if z.min() > 0:
                break
            now = x[active]
            low = z <= 0
            step = np.min(now[low] / np.maximum(now[low] - z[low], 1e-30))
            x[active] = now + step * (z - now)
            keep = [i for i in active if x[i] > 1e-12 * scale]
            for i in set(active) - set(keep):
                x[i] = 0
            if best not in keep and len(keep) == len(active) - 1 and step == 0:
                active = keep
                z = x[active]
                break
            active = keep
            if not active:
                z = np.zeros(0)
                break
        x[:] = 0
        x[active] = z
    return x


def combinations(upper: np.ndarray, capacity: int, window: float = WINDOW) -> list[dict[int, int]]:
    """Combinations ``{class: times}`` of at most three classes that leave at most ``window`` of a container empty."""
    slack = math.floor(capacity * window)
    out: dict[tuple, dict[int, int]] = {}

    def offer(parts: list[tuple[int, int]], rest: int) -> None:
        if 0 <= rest <= slack:
            c: dict[int, int] = {}
            for k, n in parts:
                c[k] = c.get(k, 0) + n
            out.setdefault(tuple(sorted(c.items())), c)

    for i in range(len(upper) - 1, -1, -1):
        top = capacity // int(upper[i])
        for a in {1, (top + 1) // 2, top} - {0}:
            r1 = capacity - a * int(upper[i])
            offer([(i, a)], r1)
            for j in range(min(i, int(np.searchsorted(upper, r1, side="right")) - 1), -1, -1):
                most = r1 // int(upper[j])
                for b in {1, (most + 1) // 2, most} - {0}:
                    r2 = r1 - b * int(upper[j])
                    offer([(i, a), (j, b)], r2)
                    k = int(np.searchsorted(upper, r2, side="right")) - 1
                    if k >= 0:
                        offer([(i, a), (j, b), (k, 1)], r2 - int(upper[k]))
    return list(out.values())


def plan_packing(histogram: dict[int, int], capacity: int, classes: int = CLASSES) -> Plan:
    """How to combine sizes (each below ``capacity``) with these counts."""
    plan = Plan(np.full(capacity + 1, -1, np.int64))
    sizes = sorted(s for s in histogram if s > 0)
    if not sizes:
        return plan
    mass = np.cumsum([s * histogram[s] for s in sizes])
    planned = [s for s, m in zip(sizes, mass) if m > SAND * mass[-1]]
    lo, hi = planned[0], planned[-1]
    marks = np.unique(np.ceil(np.geomspace(lo, hi, classes)).astype(int)) if hi > lo else np.array([hi])
    upper, count = [], []
    start = 0
    for m in marks:
        own = [s for s in planned[start:] if s <= m]
        if own:
            plan.of_size[own] = len(upper)
            upper.append(own[-1])
            count.append(sum(histogram[s] for s in own))
            start += len(own)
    upper, count = np.array(upper), np.array(count)
    columns = combinations(upper, capacity)
    if not columns:
        return plan
    a = np.zeros((len(upper), len(columns)))
    for n, c in enumerate(columns):
        for k, times in c.items():
            a[k, n] = times
    x = nnls(a, count.astype(float), 4 * len(upper))
    repeats = np.floor(x + 1e-9).astype(np.int64)
    for k in range(len(upper)):  # no more of a class than there is
        over = int(a[k] @ repeats) - int(count[k])
        for n in np.argsort(-a[k] * (repeats > 0), kind="stable"):
            if over <= 0 or a[k, n] == 0 or repeats[n] == 0:
                break
            less = min(int(repeats[n]), math.ceil(over / a[k, n]))
            repeats[n] -= less
            over -= int(less * a[k, n])
    at = np.zeros(len(upper), np.int64)
    for n in np.flatnonzero(repeats):
        for k, times in columns[n].items():
            size = int(repeats[n]) * times
            plan.ranges.append((k, int(at[k]), int(at[k]) + size, int(n), times))
            at[k] += size
    return plan


def best_fit(cell: pd.DataFrame) -> pd.DataFrame:
    """Packs the items of a cell, the largest first, each into the fullest container with room, else into a new one."""
    cell = cell.sort_values(["size", "item", "part"], ascending=[False, True, True], kind="stable")
    boxes, items = cell[cell["is_box"]], cell[~cell["is_box"]]
    capacity = int(cell["capacity"].iloc[0])
    room: dict[int, list[str]] = {}
    for name, size in zip(boxes["container"], boxes["size"]):
        room.setdefault(int(size), []).append(name)
    free = sorted(room)
    label, fresh, out = f"rest/{cell['cell'].iloc[0]}/", 0, []
    for size in items["size"].tolist():
        i = bisect_left(free, size)
        if i < len(free):
            left = free[i]
            name = room[left].pop()
            if not room[left]:
                del room[left], free[i]
        else:
            left, name = capacity, f"{label}{fresh}"
            fresh += 1
        out.append(name)
        left -= size
        if left:
            if left not in room:
                room[left] = []
                insort(free, left)
            room[left].append(name)
    return pd.DataFrame({"container": out, "item": items["item"].to_numpy(), "part": items["part"].to_numpy(), "size": items["size"].to_numpy()})


def pack_items(items: DataFrame, capacity: int, item: str = "item", size: str = "size") -> DataFrame:
    """``(container, item, part, size, item_start, start)``: each item's place, none split unless longer than a container.

    ``item`` is a long that names the item; ``part`` counts the pieces of an item longer than ``capacity``, which fills
    whole containers first, its remainder being packed like an item. ``item_start`` and ``start`` are offsets in the item
    and in the container. Items of null or no size need no room and aren't listed; rows that repeat an item and size count
    once; a null item is left out. Any number of items may have one size. An empty table gives an empty result.
    """
    if not 1 <= capacity <= MOST_CAPACITY:
        raise ValueError(f"capacity must be from 1 to {MOST_CAPACITY}")
    spark = items.sparkSession
    rows = items.select(F.col(item).cast("long").alias("item"), F.col(size).cast("long").alias("n")).where("item is not null and n > 0").distinct()
    whole = rows.where(F.col("n") >= capacity).select("item", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / capacity).cast("int") - 1)).alias("part"))
    full = whole.select(F.concat_ws("/", F.lit("full"), "item", "part").alias("container"), "item", "part", F.lit(capacity).cast("long").alias("size"))
    rest = materialize(rows.select("item", F.floor(F.col("n") / capacity).cast("int").alias("part"), (F.col("n") % capacity).alias("size")).where("size > 0"), "rest")
    histogram = dict(map(tuple, rest.groupBy("size").count().collect()))
    plan = plan_packing(histogram, capacity)
    # As many rows as there are sizes, or ranges of combinations: bounded by the capacity and by CLASSES.
    of_size = F.broadcast(spark.createDataFrame([(s, int(plan.of_size[s])) for s in histogram], "size long, class int"))
    ranges = F.broadcast(spark.createDataFrame(plan.ranges, "class int, lo long, hi long, combination int, times int"))
    classed = rest.join(of_size, "size").withColumn("h", F.xxhash64("item", "part")).withColumn("bucket", F.shiftrightunsigned("h", 54))
    dealt = classed.where("class >= 0")
    per = dealt.groupBy("class", "bucket").agg(F.count("*").alias("c"))
    before = per.withColumn("before", F.sum("c").over(Window.partitionBy("class").orderBy("bucket")) - F.col("c")).drop("c")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("class", "bucket").orderBy("h", "item", "part")) - 1
    ranked = dealt.join(before, ["class", "bucket"]).withColumn("rank", rank).alias("d")
    r = ranges.alias("r")
    name = F.concat_ws("/", F.lit("plan"), "combination", F.floor((F.col("rank") - F.col("lo")) / F.col("times")))
    hit = (F.col("d.class") == F.col("r.class")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    slots = ranked.join(r, hit, "left").select("item", "part", "size", F.when(F.col("lo").isNotNull(), name).alias("container"))
    slots = materialize(slots.unionByName(classed.where("class < 0").select("item", "part", "size", F.lit(None).cast("string").alias("container"))), "slots")
    planned = slots.where("container is not null")
    left = slots.where("container is null")
    gaps = planned.groupBy("container").agg((capacity - F.sum("size")).alias("size")).where("size > 0")
    count = sum(histogram.values())
    cells = max(1, math.ceil(count / CELL))
    cell_of = lambda *c: F.pmod(F.xxhash64(*c), F.lit(cells)).cast("int").alias("cell")
    boxes = gaps.select(cell_of("container"), F.lit(True).alias("is_box"), "container", F.lit(0).cast("long").alias("item"), F.lit(0).alias("part"), "size")
    loose = left.select(cell_of("item", "part"), F.lit(False).alias("is_box"), F.lit("").alias("container"), "item", "part", "size")
    filled = boxes.unionByName(loose).withColumn("capacity", F.lit(capacity)).groupBy("cell").applyInPandas(best_fit, "container string, item long, part int, size long")
    everything = full.unionByName(planned.select(*full.columns)).unionByName(filled)
    order = Window.partitionBy("container").orderBy(F.desc("size"), "item", "part")
    start = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    return everything.withColumn("item_start", F.col("part").cast("long") * capacity).withColumn("start", start)


def pack_documents(docs: DataFrame, specs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Documents into the containers of each spec ``(spec_id, capacity_tokens, tokenizer)``; sizes are tokens of its tokenizer."""
    wanted = specs.select("spec_id", "capacity_tokens", "tokenizer").distinct().orderBy("spec_id").limit(MOST_SPECS + 1).collect()
    if len(wanted) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container specs")
    sizes: dict[str, DataFrame] = {}
    out = None
    for s in wanted:
        if s.tokenizer not in sizes:
            sizes[s.tokenizer] = materialize(encode_texts(docs, tokenizer=s.tokenizer, folder=folder, counts_only=True), "sizes")
        packed = pack_items(sizes[s.tokenizer], s.capacity_tokens, "doc_id", "tokens")
        packed = packed.select(F.lit(s.spec_id).alias("spec_id"), "container", F.col("item").alias("doc_id"), "part", "size", "item_start", "start")
        out = packed if out is None else out.unionByName(packed)
    if out is None:
        return docs.sparkSession.createDataFrame([], "spec_id long, container string, doc_id long, part int, size long, item_start long, start long")
    return out


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, the fewest that could hold all tokens, tokens, and the share of room used."""
    per = packed.groupBy("spec_id", "container").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
    done = per.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("items").alias("items"))
    room = F.col("containers") * F.col("capacity_tokens")
    fewest = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return specs.select("spec_id", "purpose", "capacity_tokens").join(done, "spec_id", "left").withColumn("fewest", fewest).withColumn("fill", F.try_divide(F.col("tokens"), room))
