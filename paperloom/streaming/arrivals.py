"""Structured Streaming over arrivals. A file folder of Parquet parts is the source; any streaming DataFrame of that shape works."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom.functions.scalars import count
from paperloom.operators import store


def read(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Event times in the session's zone, as watermarks want them."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def discoveries_by_window(events: DataFrame, ts: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Arrivals by tumbling window and kind; rows later than the watermark are left out. Works on batches too."""
    return _timed(events, ts).withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), F.col(kind).alias("kind")).agg(count().alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n")


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions that a gap of inactivity ends."""
    return _timed(events, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(count().alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fresh(events: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first arrival of each key within the watermark."""
    return _timed(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def upsert_sink(space: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merge each micro-batch into a versioned Parquet store.

    A version is written whole before its successor is read, so a failed batch leaves the last version as it was, and a
    repeated batch writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        before = f"{space}/version={number - 1}"
        here = fs_path(before)
        known = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(here)
        merged = store.upsert(spark.read.parquet(before) if known else None, batch)
        merged.write.mode("overwrite").parquet(f"{space}/version={number}")

    return merge


class _Registry(StatefulProcessor):
    """Accesses of each session; a session that is not seen for its time to live is forgotten."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        n = (self.seen.get()[0] if self.seen.exists() else 0) + sum(len(part) for part in rows)
        self.seen.update((n,))
        yield pd.DataFrame({"session_id": [key[0]], "accesses": [n]})

    def close(self) -> None:
        pass


def session_registry(events: DataFrame, key: str = "session_id", ttl_ms: int = 2 * 60 * 60 * 1000) -> DataFrame:
    """Running accesses of each session, with the state's time to live."""
    return events.groupBy(key).transformWithStateInPandas(_Registry(ttl_ms), "session_id string, accesses bigint", "Update", "processingTime")
