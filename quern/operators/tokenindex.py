"""An inverted index of path tokens as tables, kept up by micro-batches.

Postings (token, id, place) are clustered by ranges of tokens, so a token and a prefix are range
scans that skip all other files and row groups; a token that most paths have is split over
several files by id.  How many paths have each token is a table of its own, so whether a filter
would keep too much is decided without reading postings.

A batch of inserts, updates and deletions is a segment: the postings of its new paths, and
tombstones that hide what earlier segments have of its ids.  Its folder is named by its number,
so a batch that is applied again after a failure writes the same once more.  ``compact`` folds all segments into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators.textfilter import GUARD, Pattern, tokens
from quern.scratch import Scratch, delete_path

#: Beyond every character: the end of the range of a prefix.
LAST = "\U0010ffff"
POSTINGS = "token string, id long, place int, segment long"
TOMBS, COUNTS, PATHS = "id long, segment long", "token string, n long, segment long", "id long, path string, segment long"


class TokenIndex:
    """Tables below ``path``, which all executors must reach; segments are numbered from 0 in the order in which they count."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame, name: str, segment: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/segment={segment}")

    def apply(self, batch: DataFrame, segment: int) -> None:
        """Take in rows (id, path[, version]): a null path deletes its id; of several rows of an id the last version counts.

        Null ids are left out.  Fit for ``foreachBatch``: a batch may be applied again, as long as
        no later one has been.
        """
        scratch = Scratch(self.spark)
        version = F.col("version") if "version" in batch.columns else F.lit(0)
        last = batch.where("id is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.max(F.struct(version.alias("version"), F.col("path").alias("path"))).alias("r")).select("id", "r.path")
        rows = scratch.keep(last, "tokens-batch")
        old = self._live_paths(segment).join(rows.select("id"), "id", "left_semi").select("path", F.lit(-1).alias("d"))
        deltas = rows.where("path is not null").select("path", F.lit(1).alias("d")).union(old)
        counts = deltas.select(F.explode(F.array_distinct(tokens(F.col("path")))).alias("token"), "d").groupBy("token").agg(F.sum("d").cast("long").alias("n"))
        self._write(counts.where("n <> 0").repartitionByRange("token").sortWithinPartitions("token"), "counts", segment)
        posted = rows.where("path is not null").select(F.posexplode(tokens(F.col("path"))).alias("place", "token"), "id").select("token", "id", "place")
        self._write(posted.repartitionByRange("token", "id").sortWithinPartitions("token", "id"), "postings", segment)
        self._write(rows.where("path is not null").repartitionByRange("id").sortWithinPartitions("id"), "paths", segment)
        # last: until its tombstones are there, readers see the ids of the batch as they were, or twice alike
        self._write(rows.select("id").repartitionByRange("id").sortWithinPartitions("id"), "tombs", segment)
        scratch.drop(rows)

    def _shown(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Rows (id, segment, ...) that no later segment hides, of those before a segment if that is given."""
        tombs = self._table("tombs", TOMBS)
        if before is not None:
            rows, tombs = rows.where(F.col("segment") < before), tombs.where(F.col("segment") < before)
        newest = tombs.groupBy(F.col("id").alias("_id")).agg(F.max("segment").alias("_newest"))
        return rows.join(newest, F.col("id") == F.col("_id")).where(F.col("segment") == F.col("_newest")).drop("_id", "_newest")

    def _live_paths(self, before: int | None = None) -> DataFrame:
        return self._shown(self._table("paths", PATHS), before)

    def total(self) -> int:
        return self._live_paths().count()

    def _counts(self, part: str, prefix: bool) -> int:
        """Sum of the numbers of paths that have the token, or each token of the prefix."""
        c = self._table("counts", COUNTS).where(_within(part, prefix))
        return c.agg(F.sum("n")).first()[0] or 0

    def matches(self, pattern: Pattern) -> DataFrame:
        """(id) of the paths that have the pattern's token, or tokens one after the other, each once."""
        parts = [p for p in pattern.body.split("_") if p]
        if not parts:
            return self.spark.createDataFrame([], "id long")
        found = None
        for k, part in enumerate(parts):
            some = self._table("postings", POSTINGS).where(_within(part, pattern.prefix and k == len(parts) - 1)).select("id", "segment", (F.col("place") - k).alias("start"))
            found = some if found is None else found.join(some.distinct(), ["id", "segment", "start"], "left_semi")
        return self._shown(found).select("id").distinct()

    def guarded(self, pattern: Pattern | None, guard: float = GUARD) -> DataFrame:
        """(id) of the matching paths; of all paths if the pattern is absent or matches more than ``guard`` of them.

        The table of counts decides where it can: for a token it is exact, for a prefix or
        several tokens a bound, beyond which the matches are counted.
        """
        everything = self._live_paths().select("id")
        if pattern is None:
            return everything
        parts = [p for p in pattern.body.split("_") if p]
        most = guard * self.total()
        n = min((self._counts(p, pattern.prefix and k == len(parts) - 1) for k, p in enumerate(parts)), default=0)
        if n > most and (pattern.prefix or len(parts) > 1):
            n = self.matches(pattern).count()
        return everything if n > most else self.matches(pattern)

    def compact(self) -> None:
        """All segments as one, with the number of the last; hidden postings and sums of counts go."""
        last = self._table("tombs", TOMBS).agg(F.max("segment")).first()[0]
        if last is None:
            return
        scratch = Scratch(self.spark)
        paths = scratch.keep(self._live_paths().select("id", "path"), "tokens-paths")
        for name in ("counts", "postings", "paths", "tombs"):
            delete_path(self.spark, f"{self.path}/{name}")
        self.apply(paths, last)
        scratch.drop(paths)


def _within(part: str, prefix: bool):
    t = F.col("token")
    return (t >= part) & (t < part + LAST) if prefix else t == part
