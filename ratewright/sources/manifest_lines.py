"""Manifest files as raw lines: valid lines become typed rows, every other line keeps its reason.

Structure is judged once per line by one regular expression; values are judged once per distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.common import WHITE, attach, materialize

#: Columns of a manifest line, in order (fixed values).
COLUMNS = ["sha256", "url", "sourceUrl", "licence", "photographer", "photographerUrl", "query", "queryVariant", "width", "height", "file"]
HEADER = ",".join(COLUMNS)
VARIANTS = ["good", "mediocre", "bad", "edge"]

#: One field with the comma before it (a line gets one in front). Possessive, so that a line of any length needs no backtracking.
FIELD = r',("[^"]*+(?:""[^"]*+)*+"|[^",]*+)'

#: What a value of each checked column must look like, and the reason if it doesn't.
RULES = {
    "sha256": (r"^[0-9a-f]{64}\z", "sha256 is not 64 lower-case hex digits"),
    "width": (r"^[0-9]*[1-9][0-9]*\z", "width is not a whole number from 1 up"),
    "height": (r"^[0-9]*[1-9][0-9]*\z", "height is not a whole number from 1 up"),
    "queryVariant": (r"^(?:good|mediocre|bad|edge)\z", "queryVariant is not one of good, mediocre, bad, edge"),
    "photographer": (rf"(?s)^.*[^{WHITE[1:-1]}].*\z", "photographer is blank"),
}


def split_lines(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    """Adds ``__fields`` (array of unquoted fields) and ``__fault`` ('quoting', 'column_count' or null).

    Blank lines, null lines and lines that are exactly the header are dropped: they hold no record.
    """
    c = F.col(line)
    kept = lines.where(c.isNotNull() & (c != HEADER) & c.rlike(rf"[^{WHITE[1:-1]}]"))
    parts = F.regexp_extract_all(F.concat(F.lit(","), c), F.lit(FIELD), F.lit(0))
    whole = F.length(F.array_join(F.col("__parts"), "")) == F.length(c) + 1
    field = F.transform(F.col("__parts"), lambda p: _unquote(F.substr(p, F.lit(2))))
    return (
        kept.withColumn("__parts", parts)
        .withColumn("__fault", F.when(~whole, "quoting").when(F.size("__parts") != len(COLUMNS), "column_count"))
        .withColumn("__fields", F.when(F.col("__fault").isNull(), field))
        .drop("__parts")
    )


def _unquote(p: Column) -> Column:
    return F.when(p.startswith('"'), F.replace(F.substr(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p)


def _cells(split: DataFrame, *more: str) -> DataFrame:
    """Checked values of structurally sound lines, one row a line and column."""
    cell = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.element_at("__fields", COLUMNS.index(n) + 1).alias("value"), F.lit(i).alias("i")) for i, n in enumerate(RULES)]))
    return split.where(F.col("__fault").isNull()).select(*more, cell.alias("p")).select(*more, "p.*")


def value_dictionary(split: DataFrame) -> DataFrame:
    """``(column, value, n, why)``: each distinct value judged once; ``why`` is null for a valid one."""
    why = None
    for name, (pattern, text) in RULES.items():
        bad = (F.col("column") == name) & ~F.col("value").rlike(pattern)
        why = F.when(bad, text) if why is None else why.when(bad, text)
    return _cells(split).groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("why", why)


def parse_manifest_lines(lines: DataFrame, key: str = "raw_id", line: str = "raw_line") -> tuple[DataFrame, DataFrame]:
    """Separate loadable lines from broken ones.

    Returns ``(valid, rejected)``. ``valid`` has ``key`` and the eleven ManifestRow columns, width and height as long
    (null, never wrapped, where they don't fit) and also as they were written, ``width_text`` and ``height_text``, so that
    no valid value is lost. ``rejected`` has ``key``, ``reason`` (quoting, column_count, invalid_value: the first that
    holds) and ``details`` (for invalid values, one text per failing column in column order).

    Null, blank and exact header lines are in neither result. Repeated lines are judged each on their own (key is
    unique). Very long lines are split without recursion. Extra columns of the input are ignored, whatever their names.
    An empty input gives two empty results.
    """
    # Split once: the structure, the dictionary, its join and the valid rows all read it.
    split = materialize(split_lines(lines.select(F.col(key).alias("__key"), F.col(line).alias("__line")), "__line").drop("__line"), "lines")
    total = split.count() * len(RULES)
    hits = (
        attach(_cells(split, "__key"), value_dictionary(split), ["column", "value"], "n", total, only=F.col("why").isNotNull())
        .groupBy("__key")
        .agg(F.array_sort(F.collect_list(F.struct("i", "why"))).alias("w"))
        .select("__key", F.col("w.why").alias("details"))
    )
    structural = split.where(F.col("__fault").isNotNull()).select(
        F.col("__key").alias(key), F.col("__fault").alias("reason"), F.array().cast("array<string>").alias("details")
    )
    rejected = structural.unionByName(hits.select(F.col("__key").alias(key), F.lit("invalid_value").alias("reason"), "details"))
    valid = (
        split.where(F.col("__fault").isNull())
        .join(hits.select("__key"), "__key", "left_anti")
        .select(
            F.col("__key").alias(key),
            *[
                (F.element_at("__fields", i + 1).try_cast("bigint") if n in ("width", "height") else F.element_at("__fields", i + 1)).alias(n.lower())
                for i, n in enumerate(COLUMNS)
            ],
            *[F.element_at("__fields", COLUMNS.index(n) + 1).alias(f"{n}_text") for n in ("width", "height")],
        )
    )
    return valid, rejected
