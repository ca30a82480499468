"""Keys of 64-bit codes by which codes within a Hamming radius meet."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_masks(radius: int, agree: int) -> list[int]:
    """Masks of ``agree`` of ``radius + agree`` blocks of the 64 bits: codes within ``radius`` agree under one at least."""
    blocks = radius + agree
    if radius < 0 or agree < 1 or blocks > 64:
        raise ValueError("radius must not be negative, agree positive, and both at most 64 together")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    signed = [sum(c) for c in combinations(parts, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in signed]


#: A key costs as much as so many comparisons: it is written, sent and sorted.
KEY_COST = 8


def best_agree(one: int, other: int, radius: int, most: int = 1000) -> int:
    """The number of agreeing blocks with the least keys and candidates for so many codes on each side.

    Few blocks give few keys and many candidates. With more codes more blocks pay, so the work grows little faster than
    the codes do; no plan has over ``most`` keys a code.
    """

    def work(agree: int) -> float:
        keys, bits = comb(radius + agree, agree), 64 * agree / (radius + agree)
        return KEY_COST * keys * (one + other) + one * other * keys / 2**bits

    return min((a for a in range(1, 65 - radius) if comb(radius + a, a) <= max(most, radius + 1)), key=work)


def mask_keys(code: Column, masks: list[int]) -> Column:
    """One key for each mask. Of all ``block_masks``, codes within the radius share one key at least: that is exact."""
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.xxhash64(code.bitwiseAND(m), m))
