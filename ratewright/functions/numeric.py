"""Scalar functions as columns: band penalties, monotone maps, rounding and clamping with the project's tie rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Nearest, ties towards plus infinity, as the project's scores are rounded (not away from zero)."""
    p = 10.0**digits
    return F.floor(c * p + 0.5) / F.lit(p)


def clamp(c: Column, low: float, high: float) -> Column:
    """Into ``[low, high]``; NaN and null stay what they are."""
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), c)))


def band_penalty(c: Column, low: float, high: float, scale: float) -> Column:
    """Distance outside ``[low, high]`` times ``scale``; 0 inside; null for null."""
    return F.when(c < low, (F.lit(low) - c) * scale).when(c > high, (c - F.lit(high)) * scale).when(c.isNotNull(), F.lit(0.0))


def piecewise(c: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between ``knots`` (ascending x), constant beyond them; null for null."""
    if len(knots) < 2 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:])):
        raise ValueError("need two knots or more, strictly ascending")
    out = F.when(c <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(c <= x1, F.lit(float(y0)) + (c - x0) / F.lit(float(x1 - x0)) * F.lit(float(y1 - y0)))
    return out.when(c > knots[-1][0], F.lit(float(knots[-1][1])))


def piecewise_sql(x: str, knots: list[tuple[float, float]]) -> str:
    """The same map as SQL text."""
    parts = [f"when {x} <= {knots[0][0]} then {float(knots[0][1])}"]
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        parts.append(f"when {x} <= {x1} then cast({float(y0)} as double) + ({x} - {x0}) / cast({float(x1 - x0)!r} as double) * {float(y1 - y0)}")
    return "case " + " ".join(parts) + f" when {x} > {knots[-1][0]} then {float(knots[-1][1])} end"


def apply_knots(c: Column, knots: Column) -> Column:
    """As ``piecewise``, for knots held in a column of ``array<struct<x,y>>``; no knots give 0, equal x the later y."""
    first, last = F.try_element_at(knots, F.lit(1)), F.try_element_at(knots, F.lit(-1))
    upper = F.try_element_at(F.filter(knots, lambda k: k["x"] >= c), F.lit(1))
    lower = F.try_element_at(F.filter(knots, lambda k: k["x"] < c), F.lit(-1))
    inside = F.when(upper["x"] == lower["x"], upper["y"]).otherwise(lower["y"] + (c - lower["x"]) / (upper["x"] - lower["x"]) * (upper["y"] - lower["y"]))
    return F.when(F.size(knots) == 0, 0.0).when(c <= first["x"], first["y"]).when(c >= last["x"], last["y"]).otherwise(inside)


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column, width: int) -> Column:
    """Differing bits of two hex strings of ``width`` digits, any width; null if one isn't such a string."""
    ok = a.rlike(rf"^[0-9A-Fa-f]{{{width}}}\z") & b.rlike(rf"^[0-9A-Fa-f]{{{width}}}\z")
    total = F.lit(0)
    for i in range(0, width, 15):
        n = min(15, width - i)
        x, y = (F.conv(F.substring(s, i + 1, n), 16, 10).cast("bigint") for s in (a, b))
        total = total + F.bit_count(x.bitwiseXOR(y))
    return F.when(ok, total)


def hmac_sha256(key: str, message: Column) -> Column:
    """Keyed hash of a string column as hex, composed of built-in SHA-256 over bytes."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in raw)), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in raw)), F.unhex(inner)), 256)


def percent(c: Column) -> Column:
    """A share as percent text: one decimal below one percent, else whole."""
    v = c * 100
    return F.when((v > 0) & (v < 1), F.format_string("%.1f%%", v)).otherwise(F.concat(F.floor(v + 0.5).cast("string"), F.lit("%")))
