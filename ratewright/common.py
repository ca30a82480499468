"""Helpers shared by all operators: table access, key normalisation, lineage cuts, skew-safe lookups."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of any script, so that keys pasted with no-break or ideographic spaces still agree.
WHITE = r"[\s\u0085   -     　]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the test tables, by name."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def norm_key(col: Column | str) -> Column:
    """The one spelling of a key: outer white space gone, inner runs single, lower case, blank as null."""
    c = F.col(col) if isinstance(col, str) else col
    squeezed = F.trim(F.regexp_replace(c, f"{WHITE}+", " "))
    # A key of visible ASCII signs alone, as most are, has no white space to look for.
    return F.nullif(F.lower(F.when(c.rlike("[^!-~]"), squeezed).otherwise(c)), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; the cluster's own setting wins, a temporary one is for local runs only."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        sc = spark.sparkContext
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            got = current.get()
        else:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            got = tempfile.mkdtemp(prefix="ratewright-")
            sc.setCheckpointDir(got)
    return got


_WRITTEN: list[tuple[SparkSession, str]] = []


#: Spark's setting by which a query deletes its shuffle files when it ends, where this version has it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind; for steps whose result is written and read again."""
    try:
        before = spark.conf.get(CLEANUP)
    except Exception:  # noqa: BLE001  (unknown to this version)
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder, to be deleted by ``release`` or when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/ratewright-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage: write to the shared folder and read back. Lost executors then cost no recomputation."""
    spark = df.sparkSession
    path = written(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ratewright_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete what materialize wrote, once nothing will read it again."""
    path = getattr(df, "_ratewright_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN[:] = [(s, x) for s, x in _WRITTEN if x != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_WRITTEN):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  (the session may be gone)
            pass


def heavy_bound(total: int, most: int = 5000, least: int = 20_000) -> int:
    """Rows per key above which a key counts as hot. At most ``most`` keys can exceed it, whatever the data."""
    return max(least, total // most + 1)


def attach(rows: DataFrame, stats: DataFrame, key: str | list[str], count: str, total: int, only: Column | None = None) -> DataFrame:
    """Inner join of per-key ``stats`` (one row a key, with its row ``count``) onto ``rows`` without a hot reducer.

    Keys above ``heavy_bound`` are joined by broadcast, of which there are at most 5000 by construction; all others by
    shuffle, where no key has more rows than the bound. ``only`` restricts the stats that may match.
    """
    keys = [key] if isinstance(key, str) else key
    bound = heavy_bound(total)
    columns = [*rows.columns, *[c for c in stats.columns if c not in keys]]
    heavy = F.broadcast(stats.where(F.col(count) > bound))
    light = stats.where(F.col(count) <= bound)
    hot = rows.join(heavy if only is None else heavy.where(only), keys)
    cold = rows.join(heavy.select(*keys), keys, "left_anti").join(light if only is None else light.where(only), keys)
    return hot.select(*columns).unionByName(cold.select(*columns))


def sorted_positions(rows: DataFrame, column: str) -> DataFrame:
    """``(column, position)`` of distinct non-null values in sorted order, from 0.

    Values are range partitioned and numbered within their partition; the partitions' counts, one row each, give the
    offsets. No task sorts or counts more than its range. ``release`` deletes what is held.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    kind = rows.schema[column].dataType.simpleString()
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def number(batches):
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * b.num_rows, pa.int32()), pa.array(np.arange(at, at + b.num_rows, dtype=np.int64))], names=["v", "part", "own"])
            at += b.num_rows

    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct()
    held = materialize(values.repartitionByRange(parts, "v").sortWithinPartitions("v").mapInArrow(number, f"v {kind}, part int, own long"), "positions")
    starts, total = [], 0
    for r in held.groupBy("part").count().orderBy("part").collect():
        starts.append((r[0], total))
        total += r[1]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start long"))  # as many rows as partitions
    out = held.join(offsets, "part").select(F.col("v").alias(column), (F.col("start") + F.col("own")).alias("position"))
    out._ratewright_path = held._ratewright_path
    return out
