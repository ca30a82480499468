"""File sources and sinks: JSON lines (strict or collecting), CSV with quoted breaks, image folders, atomic rewrites."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.functions.text import csv_line, label_lines, mime_of


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: any line that doesn't fit fails the read; a path that isn't there is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_label_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Collecting: ``(records, problems)`` with the file of each line."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    return label_lines(lines, "line")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Full rewrite: written beside the target, which is then moved aside and, once the new table stands in its place,
    deleted. A failure leaves the old table; between the two moves a reader may for a moment find none.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows.write.json(fresh.toString())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}.old")
    held = fs.exists(target) and fs.rename(target, aside)
    if not fs.rename(fresh, target):
        if held:
            fs.rename(aside, target)
        raise OSError(f"cannot move {fresh} to {target}")
    if held:
        fs.delete(aside, True)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """CSV with doubled quotes and breaks inside quotes; a byte order mark and empty records are dropped. With a schema any
    misfit fails the read; without, all columns are strings."""
    r = spark.read.option("header", header).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST" if schema else "PERMISSIVE")
    return (r.schema(schema) if schema else r).csv(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV lines added to a folder; breaks flattened, quoted only where needed."""
    rows.select(csv_line([F.col(c) for c in rows.columns]).alias("value")).write.mode("append").text(path)


def scan_images(spark: SparkSession, path: str, most: int = 10 * 1024 * 1024) -> DataFrame:
    """``(path, length, sha256, mime, fault)`` of the files below a folder, the first fault that holds: empty, too_large,
    not_an_image. Contents don't leave the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    mime = mime_of(F.col("content"))
    fault = F.when(F.col("length") == 0, "empty").when(F.col("length") > most, "too_large").when(mime.isNull(), "not_an_image")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), mime.alias("mime"), fault.alias("fault"))


def dead_letters(rows: DataFrame, stage: str, key: str, fault: str) -> tuple[DataFrame, DataFrame]:
    """``(passed, failed)``: rows without a fault, and of the others their key, stage and message."""
    bad = rows.where(F.col(fault).isNotNull()).select(F.col(key).alias("item"), F.lit(stage).alias("stage"), F.col(fault).alias("message"))
    return rows.where(F.col(fault).isNull()).drop(fault), bad


def collisions(scanned: DataFrame, corpus: DataFrame) -> DataFrame:
    """Scanned files whose content is in the corpus already (column ``sha256``)."""
    return scanned.join(corpus.select("sha256"), "sha256", "left_semi")
