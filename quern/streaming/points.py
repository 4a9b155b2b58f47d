"""Points as a stream of upserts: the last version of each id wins, whatever batches the stream comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.streaming.buckets import Buckets


def point_table(spark: SparkSession, path: str, schema: str, version: str = "version", buckets: int = 64) -> Buckets:
    """The table that ``upsert_stream`` keeps; of rows of one id and version the greatest counts."""
    columns = spark.createDataFrame([], schema).columns
    return Buckets(spark, path, schema, "id", [version, *(c for c in columns if c not in ("id", version))], buckets)


def upsert_stream(points: DataFrame, table: Buckets, checkpoint: str, trigger: dict | None = None):
    """Fold a stream of points into a table.  Once a batch is over, every reader sees all of it."""
    return points.writeStream.foreachBatch(table.fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
