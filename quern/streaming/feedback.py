"""The feedback log as a stream: windowed counts, and state kept up to date by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.streaming.buckets import Buckets


def window_counts(log: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, kind, n) by event time; on a stream, rows later than ``late`` are past counting."""
    if late is not None:
        log = log.withWatermark("at", late)
    return log.groupBy(F.window("at", width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


#: Buckets of the state, by a hash of the photo.
BUCKETS = 64
STATE = "photo_id long, at timestamp_ntz, kind string"


def _table(spark: SparkSession, path: str) -> Buckets:
    return Buckets(spark, path, STATE, "photo_id", ["at", "kind"], BUCKETS)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """(photo_id, at, kind): the last event of each photo, after the last micro-batch that is complete."""
    return _table(spark, path).read()


def maintain(log: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Keep the last event of each photo up to date from a stream; ``read_state`` reads it."""
    table = _table(log.sparkSession, path)
    return log.writeStream.foreachBatch(table.fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
