"""Streaming forms of the stateful operators, with event time, watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ratewright.common import written


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, directory or single file, as a stream with the schema it has now; times get the session's zone."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = reader.option("pathGlobFilter", p.getName()).parquet(str(p.getParent().toString())) if single else reader.parquet(path)
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, t in stream.dtypes if t == "timestamp_ntz"})


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Drains a stream, in append mode, into a table in the shared folder and returns what was written.

    The folder, its checkpoint included, is deleted when the process ends, or earlier by ``release``.
    """
    spark = stream.sparkSession
    base = written(spark, f"stream-{name}")
    out = f"{base}/out"
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").option("path", out).start()
    q.awaitTermination()
    got = spark.read.schema(stream.schema).parquet(out)
    got._ratewright_path = base
    return got


def windowed_counts(events: DataFrame, at: str, kind: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window and kind; rows later than the watermark are dropped."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = events.withWatermark(at, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("started"), kind, "n", "total")


def distinct_events(events: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Repeated deliveries dropped while the watermark still holds the first."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def stream_limited(events: DataFrame, key: str, at: str, tie: str, limit: int, seconds: float, late: str = "10 minutes") -> DataFrame:
    """Fixed-window limit with the open window of each key as its state, which ends with the window.

    Events of a micro-batch are taken in time order. Events that are ``late`` or more behind the newest are dropped, and no
    window is closed before the watermark has passed its end.
    """
    micros = int(seconds * 1e6)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["t", "tie"], kind="stable")
        out = []
        for t, tie_ in zip(rows["t"].tolist(), rows["tie"].tolist()):
            if opened is None or t >= opened + micros:
                opened, used = t, 0
            used += 1
            out.append((k[0], tie_, used <= limit))
        state.update((opened, used))
        state.setTimeoutTimestamp(max((opened + micros) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "tie", "allowed"])

    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late).select(F.col(at), F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(tie).cast("long").alias("tie"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, tie long, allowed boolean", "opened long, used long", "append", GroupStateTimeout.EventTimeTimeout)
