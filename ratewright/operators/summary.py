"""Descriptions of numeric columns with the project's four quantile rules, frequency tables and coverage bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_bucket(value: Column) -> Column:
    """Bucket that rises with the value, each about 0.02 % wide: far fewer than values, however those are spread."""
    v = value.cast("double")
    size = F.floor(F.ln(F.abs(v)) * 5000) + 4_000_000
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("bigint")


def value_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(…, value, n, before)``: each distinct finite value, its count and how many rows lie below it.

    All quantiles follow from it. Rows are neither collected nor sorted: counts are summed over order buckets first, then
    within each bucket, so no task holds a whole column, even one with as many values as rows.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n")).withColumn("bucket", order_bucket(F.col("value")))
    per = c.groupBy(*by, "bucket").agg(F.sum("n").alias("t"))
    over = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("bucket")
    start = per.select(*by, "bucket", (F.sum("t").over(over) - F.col("t")).alias("start"))
    within = Window.partitionBy(*by, "bucket").orderBy("value")
    return c.join(start, [*by, "bucket"]).select(*by, "value", "n", (F.col("start") + F.sum("n").over(within) - F.col("n")).alias("before"))


def at_index(index: Column) -> Column:
    """Value at a sorted position, over groups of ``value_counts``."""
    return F.min(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("n")), F.col("value")))


def quantile_floor(q: float, total: Column) -> Column:
    """Position ``min(n - 1, floor(q n))``."""
    return at_index(F.least(total - 1, F.floor(total * q)))


def quantile_lower(q: float, total: Column) -> Column:
    """Position ``floor((n - 1) q)``."""
    return at_index(F.floor((total - 1) * q))


def quantile_nearest(q: float, total: Column) -> Column:
    """Nearest rank: position ``ceil(q n) - 1``."""
    return at_index(F.greatest(F.lit(0), F.ceil(total * q) - 1))


def with_totals(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds each group's ``total``; there are as few groups as columns described, so their totals are broadcast if small."""
    key = by or ["__j"]
    c = counts if by else counts.withColumn("__j", F.lit(0))
    out = c.join(c.groupBy(*key).agg(F.sum("n").alias("total")), key)
    return out.drop("__j")


def mode(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value per ``by``; of equal counts the one seen first by ``order``."""
    c = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = c.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("less"), "seen", value)).alias("m"), F.sum("n").alias("t"))
    return best.select(*by, F.col(f"m.{value}").alias("mode"), (-F.col("m.less") / F.col("t")).alias("share"))


def equal_width_bin(value: Column, low: Column, high: Column, bins: int = 8) -> Column:
    """Bin 0 to ``bins - 1`` of an equal-width grid; null or a flat range give 0."""
    return F.when(value.isNull() | (high <= low), 0).otherwise(F.least(F.lit(bins - 1), F.floor((value - low) / (high - low) * bins).cast("int")))
