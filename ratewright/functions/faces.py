"""Geometry of faces as columns: pose from eye and nose points, regions, framing, detections of a flat array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least confidence of a subject's detection and least share of the frame it fills (fixed values).
LEAST_CONFIDENCE, LEAST_AREA = 0.5, 0.0025


def eye_distance(lx: Column, ly: Column, rx: Column, ry: Column) -> Column:
    return F.greatest(F.lit(1.0), F.hypot(rx - lx, ry - ly))


def roll(lx: Column, ly: Column, rx: Column, ry: Column) -> Column:
    """Tilt of the line between the eyes in degrees, clockwise positive."""
    return F.atan2(ry - ly, rx - lx) * 180 / F.pi()


def yaw(lx: Column, ly: Column, rx: Column, ry: Column, nx: Column, ny: Column) -> Column:
    """Turn of the head in degrees, from -90 to 90: how far the nose lies along the eye line from the eyes' middle."""
    d = eye_distance(lx, ly, rx, ry)
    along = (nx - (lx + rx) / 2) * ((rx - lx) / d) + (ny - (ly + ry) / 2) * ((ry - ly) / d)
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), along / d * 70))


def eye_region(x: Column, y: Column, w: Column, h: Column, lx: Column, ly: Column, rx: Column, ry: Column) -> Column:
    """``struct<x, y, w, h>`` around the eyes, 0.45 of their distance wide on all sides; of a box alone, a band of it."""
    m = eye_distance(lx, ly, rx, ry) * 0.45
    left = F.least(lx, rx) - m
    points = F.struct(left.alias("x"), ((ly + ry) / 2 - m).alias("y"), (F.greatest(lx, rx) + m - left).alias("w"), (m * 2).alias("h"))
    box = F.struct(x.alias("x"), (y + h * 0.22).alias("y"), w.alias("w"), (h * 0.3).alias("h"))
    return F.when(lx.isNull() | ly.isNull() | rx.isNull() | ry.isNull(), box).otherwise(points)


def central_third(width: Column, height: Column) -> Column:
    """Where a face is looked for when none was found: ``struct<x, y, w, h>``."""
    return F.struct((width / 3).alias("x"), (height / 3).alias("y"), (width / 3).alias("w"), (height / 3).alias("h"))


def framing(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """``struct<ratio, dx, dy>``: the box's share of the frame, 1 at most, and its centre's signed offset; zeros without a box."""
    none = x.isNull()
    zero = lambda c: F.when(none, 0.0).otherwise(c)
    return F.struct(
        zero(F.least(F.lit(1.0), w * h / (width * height))).alias("ratio"),
        zero((x + w / 2 - width / 2) / width).alias("dx"),
        zero((y + h / 2 - height / 2) / height).alias("dy"),
    )


def qualifies(w: Column, h: Column, confidence: Column, width: Column, height: Column) -> Column:
    """Whether a detection is sure and large enough to be the subject."""
    area = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    return (confidence >= LEAST_CONFIDENCE) & (area / F.greatest(F.lit(1.0), width * height) >= LEAST_AREA)


def decoded_boxes(flat: Column, x_scale: float, y_scale: float, least: float) -> Column:
    """Detections of a flat array ``x, y, w, h, confidence, ...``: ``array<struct<x, y, w, h, confidence>>`` in pixels.

    Those under ``least`` and those without area are left out, corners are moved into the frame, an incomplete tail is
    ignored.
    """
    at = lambda i, k: F.get(flat, i * 5 + k).cast("double")
    one = lambda i: F.struct(
        F.greatest(F.lit(0.0), at(i, 0) * x_scale).alias("x"), F.greatest(F.lit(0.0), at(i, 1) * y_scale).alias("y"),
        (at(i, 2) * x_scale).alias("w"), (at(i, 3) * y_scale).alias("h"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), at(i, 4))).alias("confidence"),
    )
    whole = F.floor(F.size(flat) / 5).cast("int")
    every = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), lambda i: (i < whole) & (at(i, 4) >= least)), one)
    return F.filter(every, lambda b: (b["w"] > 0) & (b["h"] > 0))
