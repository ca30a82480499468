"""Windows anchored at their first event, per key: the base of fixed-window limits and of expiring leases.

A window opens with the first event at or after the end of the one before. That is a sequence, so each key's events are
scanned in order; the scan streams over sorted rows and holds one key's state, never its events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anchored_windows(rows: DataFrame, key: str, at: str, tie: str, seconds: float) -> DataFrame:
    """Adds ``opened`` (start of the event's window, timestamp) and ``place`` (its position in the window, from 1).

    Rows with a null key or time are left out. Equal times are ordered by ``tie``. Other columns keep their values.
    """
    micros = int(seconds * 1_000_000)
    clean = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    work = clean.select(F.col(key).cast("string").alias("__k"), F.unix_micros(F.col(at).cast("timestamp")).alias("__t"), F.col(tie).cast("long").alias("__o"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opened, place = None, 0, 0
        for b in batches:
            keys, times = b.column(0).to_pylist(), b.column(1).to_numpy()
            starts, places = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
            for i, (k, t) in enumerate(zip(keys, times.tolist())):
                if k != held or t >= opened + micros:
                    held, opened, place = k, t, 0
                place += 1
                starts[i], places[i] = opened, place
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(starts), pa.array(places)], names=["__k", "__o", "__opened", "place"])

    scanned = work.repartition(parts, "__k").sortWithinPartitions("__k", "__t", "__o").mapInArrow(scan, "__k string, __o long, __opened long, place long")
    out = clean.withColumn("__k", F.col(key).cast("string")).withColumn("__o", F.col(tie).cast("long")).join(scanned, ["__k", "__o"])
    return out.select(*rows.columns, F.timestamp_micros("__opened").alias("opened"), "place")


def limited(rows: DataFrame, key: str, at: str, tie: str, limit: int, seconds: float) -> DataFrame:
    """Decisions of a fixed-window limit: ``allowed``, and ``retry_after`` in whole seconds (1 at least) when not."""
    w = anchored_windows(rows, key, at, tie, seconds)
    left = F.unix_micros("opened") + int(seconds * 1e6) - F.unix_micros(F.col(at).cast("timestamp"))
    return w.withColumn("allowed", F.col("place") <= limit).withColumn("retry_after", F.when(F.col("place") > limit, F.greatest(F.lit(1), F.ceil(left / 1e6))).otherwise(0).cast("long"))


def leases(rows: DataFrame, key: str, at: str, tie: str, seconds: float) -> DataFrame:
    """Which claims are granted when a lease goes stale after ``seconds``: the first of each anchored window."""
    return anchored_windows(rows, key, at, tie, seconds).withColumn("granted", F.col("place") == 1)


def sessions(rows: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Event-time sessions that end after ``gap`` without an event."""
    return rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")
