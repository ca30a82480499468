"""Measures of pixel planes held as flat arrays: sharpness, light, block artefacts, perceptual hash, face boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def laplacian_variance(p: np.ndarray) -> np.ndarray:
    """Variance of the four-neighbour Laplacian inside the border, of planes ``(n, height, width)``; 0 below three pixels."""
    if min(p.shape[1:]) < 3:
        return np.zeros(len(p))
    r = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * p[:, 1:-1, 1:-1]
    r = r.reshape(len(p), -1)
    return np.maximum(0, (r**2).mean(1) - r.mean(1) ** 2)


def light(p: np.ndarray) -> dict[str, np.ndarray]:
    """Mean, span from the 1st to the 99th percentile of the histogram, and shares clipped at either end."""
    flat = np.sort(p.reshape(len(p), -1), axis=1)
    n = flat.shape[1]
    low, high = flat[:, max(0, int(np.ceil(n * 0.01)) - 1)], flat[:, max(0, int(np.ceil(n * 0.99)) - 1)]
    return {"mean": flat.mean(1), "range": high - low, "highlights": (flat >= 250).mean(1), "shadows": (flat <= 5).mean(1)}


def block_quality(p: np.ndarray, block: int = 8) -> np.ndarray:
    """100 less for every excess of horizontal steps on the block grid over steps inside blocks; 100 below two blocks either way."""
    if min(p.shape[1:]) < 2 * block:
        return np.full(len(p), 100.0)
    steps = np.abs(np.diff(p, axis=2))
    edge = np.arange(1, p.shape[2]) % block == 0
    b, i = steps[:, :, edge].mean((1, 2)), steps[:, :, ~edge].mean((1, 2))
    ratio = np.divide(b, i, out=np.ones_like(b), where=i > 0)
    return np.where(i > 0, np.clip(100 - np.maximum(0, ratio - 1) * 26, 0, 100), np.where(b > 0, 0.0, 100.0))


def plane_measures(rows: DataFrame, key: str, plane: str, width: int, height: int) -> DataFrame:
    """All measures of each plane (array of ``width * height`` numbers, by rows); planes of another size are left out."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten(), dtype=float).reshape(len(b), height, width)
            li = light(x)
            columns = [b.column(0), pa.array(laplacian_variance(x)), *[pa.array(li[k]) for k in ("mean", "range", "highlights", "shadows")], pa.array(block_quality(x))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "sharpness", "mean", "range", "highlights", "shadows", "quality"])

    ok = rows.where((F.size(plane) == width * height) & (F.size(F.array_compact(plane)) == width * height)).select(F.col(key).alias("key"), F.col(plane).cast("array<double>"))
    return ok.mapInArrow(run, f"key {kind}, sharpness double, mean double, range double, highlights double, shadows double, quality double").withColumnRenamed("key", key)


def neighbour_hash(plane: Column, width: int = 9, height: int = 8) -> Column:
    """Difference hash of a plane of ``height`` rows: a bit tells whether a value exceeds the next one in its row; the first
    is the highest. Null for a plane of another size.
    """
    at = lambda i: (i / (width - 1)).cast("int") * width + i % (width - 1) + 1
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit((width - 1) * height - 1)),
        F.lit(0).cast("bigint"),
        lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(F.when(F.try_element_at(plane, at(i)) > F.try_element_at(plane, at(i) + 1), 1).otherwise(0).cast("bigint")),
    )
    return F.when(F.size(plane) == width * height, bits)


def crop(p: np.ndarray, x: float, y: float, w: float, h: float) -> np.ndarray | None:
    """The part of planes ``(n, height, width)`` under a box in pixels, to whole pixels outwards; null if it meets none."""
    height, width = p.shape[1:]
    x0, y0, x1, y1 = max(0, int(np.floor(x))), max(0, int(np.floor(y))), min(width, int(np.ceil(x + w))), min(height, int(np.ceil(y + h)))
    return p[:, y0:y1, x0:x1] if x1 > x0 and y1 > y0 else None


def face_light(p: np.ndarray, box: tuple[float, float, float, float] | None) -> tuple[dict[str, np.ndarray], bool]:
    """Light on the face, or on the frame's central third if there is no box, and whether a face was measured.

    A box that meets no pixel of the plane falls back to the whole plane.
    """
    height, width = p.shape[1:]
    part = crop(p, *(box or (width / 3, height / 3, width / 3, height / 3)))
    return light(p if part is None else part), box is not None


def eye_sharpness(p: np.ndarray, region: tuple[float, float, float, float] | None) -> np.ndarray | None:
    """Sharpness of the eye region; null without a face or where fewer than three pixels are left either way."""
    part = None if region is None else crop(p, *region)
    return None if part is None or min(part.shape[1:]) < 3 else laplacian_variance(part)


def primary_box(boxes: DataFrame, image: str, tie: float = 0.05) -> DataFrame:
    """The subject's box of each image: the largest, among those within ``tie`` of it the nearest to the centre; and the ratio
    of the second largest area to the largest. Boxes are ``(x, y, w, h, ordinal)`` in shares of the frame."""
    area = F.col("w") * F.col("h")
    off = F.sqrt((F.col("x") + F.col("w") / 2 - 0.5) ** 2 + (F.col("y") + F.col("h") / 2 - 0.5) ** 2)
    b = boxes.withColumns({"area": area, "off": off})
    big = b.withColumn("most", F.max("area").over(Window.partitionBy(image)))
    pick = big.where(F.col("area") >= F.col("most") * (1 - tie)).groupBy(image).agg(F.min(F.struct("off", "ordinal")).alias("p"))
    two = b.groupBy(image).agg(F.slice(F.sort_array(F.collect_list("area"), False), 1, 2).alias("a"))
    ratio = F.when(F.size("a") > 1, F.least(F.lit(1.0), F.get("a", F.lit(1)) / F.get("a", F.lit(0))))
    return pick.join(two, image).select(image, F.col("p.ordinal").alias("ordinal"), ratio.alias("second_ratio"))


#: Boxes that are judged at a time, besides those of one image.
BOXES = 65_536


def suppress_overlaps(boxes: DataFrame, image: str, threshold: float) -> DataFrame:
    """Greedy non-maximum suppression by score within each image; an image's boxes are few.

    Rows arrive sorted by image, best box first. Images with equally many boxes are judged together, rank by rank. A score
    that is missing or not a number comes last.
    """
    kind = boxes.schema[image].dataType.simpleString()

    def starts(t: pa.Table) -> np.ndarray:
        """Where an image's rows begin; null is an image."""
        key = t.column(0).combine_chunks()
        other = pc.not_equal(key[1:], key[:-1])
        null = pc.xor(pc.is_null(key[1:]), pc.is_null(key[:-1]))
        return np.concatenate([[0], np.flatnonzero(pc.fill_null(other, False).to_numpy(zero_copy_only=False) | null.to_numpy(zero_copy_only=False)) + 1])

    def judge(t: pa.Table, first: np.ndarray) -> pa.Table:
        x, y, w, h = (t.column(c).to_numpy().astype(float) for c in "xywh")
        size = np.diff(np.concatenate([first, [t.num_rows]]))
        kept = np.ones(t.num_rows, bool)
        for n in np.unique(size[size > 1]):
            at = first[size == n][:, None] + np.arange(n)
            for r in range(1, n):
                i, k = at[:, r : r + 1], at[:, :r]
                iw = np.maximum(0, np.minimum(x[i] + w[i], x[k] + w[k]) - np.maximum(x[i], x[k]))
                ih = np.maximum(0, np.minimum(y[i] + h[i], y[k] + h[k]) - np.maximum(y[i], y[k]))
                union = w[i] * h[i] + w[k] * h[k] - iw * ih
                over = ~(np.divide(iw * ih, union, out=np.zeros_like(union), where=union > 0) <= threshold)
                kept[at[:, r]] = ~(over & kept[k]).any(1)
        return t.select([image, "ordinal", "score"]).filter(pa.array(kept)).combine_chunks()

    def run(batches):
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count < BOXES:
                continue
            t = pa.Table.from_batches(held)
            first = starts(t)
            if len(first) > 1:  # the last image may go on
                yield from judge(t.slice(0, first[-1]), first[:-1]).to_batches()
                held, count = t.slice(first[-1]).to_batches(), t.num_rows - int(first[-1])
        if count:
            t = pa.Table.from_batches(held)
            yield from judge(t, starts(t)).to_batches()

    cast = {c: F.col(c).cast("double") for c in ("x", "y", "w", "h", "score")} | {"ordinal": F.col("ordinal").cast("int")}
    rows = boxes.select(image, *[e.alias(c) for c, e in cast.items()])
    order = [F.desc_nulls_last(F.nanvl("score", F.lit(None).cast("double"))), *[F.asc_nulls_last(c) for c in ("ordinal", "x", "y", "w", "h")]]
    return rows.repartition(image).sortWithinPartitions(image, *order).mapInArrow(run, f"{image} {kind}, ordinal int, score double")
