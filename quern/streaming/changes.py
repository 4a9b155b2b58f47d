"""What changed on disk, as a stream: sightings of files in, decisions out, an index of what is known kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators.state import latest
from quern.scratch import Scratch
from quern.streaming.buckets import Buckets

SIGHTINGS = "path string, seen_at timestamp_ntz, mtime long, size long, walked boolean"
DECISIONS = "path string, reason string, mtime long, size long, batch long"
KNOWN = "path string, seen_at timestamp_ntz, present boolean, mtime long, size long"


class Changes:
    """Known files and decisions below ``path``, from sightings (path, seen_at, mtime, size, walked).

    A sighting of a file is *new*, *changed* (time or size differs from what is known, or one of
    the two is missing) or *skip*; of several in a batch the last counts.  A row that is ``walked``
    says that the folder ``path`` was walked to its end, beginning at ``seen_at``: files below it that were
    not seen since are *gone*, those that a later batch says were seen before as well; they are new when they are seen again.  Only times count, not the order of
    arrival: a sighting from before what is known, or the same one again, is skipped.  Of sightings of
    one time that with the greatest mtime and size counts.  Rows without a path or time are left out.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.known = Buckets(spark, f"{self.path}/known", KNOWN, "path", ["seen_at", "present", "mtime", "size"], buckets)
        self.walks = Buckets(spark, f"{self.path}/walks", "root string, begun timestamp_ntz", "root", ["begun"], buckets)

    def start(self, index: DataFrame) -> None:
        """Begin with an index (path, mtime, size), as known before any sighting; does nothing after the first batch."""
        self.known.fold(index.select("path", F.lit(None).cast("timestamp_ntz").alias("seen_at"), F.lit(True).alias("present"), "mtime", "size"), 0)

    def decisions(self) -> DataFrame:
        """(path, reason, mtime, size, batch) of all complete batches."""
        empty = self.spark.createDataFrame([], DECISIONS)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/decisions")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return empty
        return self.spark.read.schema(DECISIONS).parquet(f"{self.path}/decisions").where(F.col("batch") <= self.known.done())

    def fold(self, batch: DataFrame, number: int) -> None:
        """Take in a micro-batch, numbered from 1; one that is complete changes nothing, one that is run again replaces what it wrote."""
        if number <= self.known.done():
            return
        scratch = Scratch(self.spark)
        rows = scratch.keep(batch.select("path", "seen_at", "mtime", "size", F.coalesce("walked", F.lit(False)).alias("walked")).where("path is not null and seen_at is not null"), "sightings")
        seen = latest(rows.where("not walked").select("path", "seen_at", "mtime", "size"), ["path"], ["seen_at", "mtime", "size"])
        touched = self.known.touched(seen)
        old = self.known.read(buckets=touched).select("path", *[F.col(c).alias(f"_{c}") for c in ("seen_at", "present", "mtime", "size")])
        same = F.coalesce((F.col("mtime") == F.col("_mtime")) & (F.col("size") == F.col("_size")), F.lit(False))
        # a sighting of the time of a walk's beginning comes after it
        known = F.struct("_seen_at", "_mtime", "_size")
        late = F.coalesce(F.when(F.col("_present"), F.struct("seen_at", "mtime", "size") <= known).otherwise(F.col("seen_at") < F.col("_seen_at")), F.lit(False))
        reason = F.when(late, "late").when(F.coalesce("_present", F.lit(False)), F.when(same, "skip").otherwise("changed")).otherwise("new")
        judged = scratch.keep(seen.join(old, "path", "left").select("path", "seen_at", "mtime", "size", reason.alias("reason")), "judged")
        gone = scratch.keep(self._gone(rows.where("walked"), judged, number), "gone")
        decided = judged.select("path", F.when(F.col("reason") == "late", "skip").otherwise(F.col("reason")).alias("reason"), "mtime", "size")
        out = decided.unionByName(gone.select("path", F.lit("gone").alias("reason"), F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("long").alias("size")))
        out.write.mode("overwrite").parquet(f"{self.path}/decisions/batch={number}")
        now = judged.where("reason <> 'late'").select("path", "seen_at", F.lit(True).alias("present"), "mtime", "size")
        self.known.fold(now.unionByName(gone.select("path", "seen_at", F.lit(False).alias("present"), F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("long").alias("size"))), number)
        scratch.drop(rows, judged, gone)

    def _gone(self, walks: DataFrame, judged: DataFrame, number: int) -> DataFrame:
        """(path, seen_at) of files below a folder that was walked since they were seen: now, or, if they are seen late, before."""
        plain = lambda c: F.rtrim(F.lower(F.replace(c, F.lit("\\"), F.lit("/"))), F.lit("/"))  # noqa: E731 - as in ``under_root``
        seen = judged.where("reason <> 'late'").select("path", F.col("seen_at").alias("last"))
        if walks.limit(1).count():
            self.walks.fold(walks.select(plain(F.col("path")).alias("root"), F.col("seen_at").alias("begun")), number)
            known = self.known.read().where("present").select("path", F.col("seen_at").alias("before"))
            seen = known.join(seen, "path", "full").select("path", F.greatest("last", "before").alias("last"))
        # a file meets its folders by equal keys, however many were walked
        parts = F.split(plain(F.col("path")), "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        walked = seen.select("path", "last", F.explode(above).alias("root")).join(self.walks.read(number), "root").where("last is null or begun > last")
        return walked.groupBy("path").agg(F.max("begun").alias("seen_at"))


def change_stream(sightings: DataFrame, changes: Changes, checkpoint: str, trigger: dict | None = None):
    """Fold a stream of sightings; its batches are numbered after the index that ``start`` took in."""
    return sightings.writeStream.foreachBatch(lambda rows, n: changes.fold(rows, n + 1)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
