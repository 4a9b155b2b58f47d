"""Centroids of sets of photos, kept up to date by a stream of what happens to sets and photos.

For each set the number and the sum of its photos' vectors are kept, so that a batch costs what
it touches: what its photos gave before it is taken away, and what they give after it is added.
A vector is added up as whole numbers in two parts, which doubles hold exactly, so a
photo that leaves takes away just what it brought, and results do not depend on how the log is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.operators.search import l2_normalise, sum_vectors
from quern.scratch import Scratch
from quern.streaming.buckets import Buckets

LOG = "at timestamp_ntz, kind string, name string, photo_id long, vector array<double>"
KINDS = ("add", "remove", "vector", "delete", "drop")
#: Steps of the two parts of a component: 2**20 to one, and 2**24 to one of those.
COARSE, FINE = float(1 << 20), float(1 << 24)


def _parts(vector: Column) -> Column:
    """Both parts one after the other; the sums of a thousand million vectors are exact if components are below 8."""
    coarse = F.transform(vector, lambda x: F.rint(x * COARSE))
    fine = F.transform(vector, lambda x: F.rint((x * COARSE - F.rint(x * COARSE)) * FINE))
    return F.concat(coarse, fine)


def _usable(vector: Column) -> Column:
    """The vector, or null if it is empty or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.when((F.size(vector) > 0) & F.coalesce(finite, F.lit(False)), vector)


class KeptCentroids:
    """Centroids below ``path``, from a log of (at, kind, name, photo_id, vector).

    * ``add`` and ``remove`` put a photo into a set and take it out, ``drop`` empties a set.
    * ``vector`` gives a photo a vector, ``delete`` takes it away: it then counts in no set.

    Only times count, not the order of arrival: a late addition from before a removal or a
    drop changes nothing.  Of one time, additions and vectors come last.  A batch that is
    run again changes nothing, and readers see all of a batch or nothing.  Rows without a
    name or photo that their kind needs, and those of any other kind, are left out.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, path = spark, path.rstrip("/")
        # pairs and points of a photo are in buckets of one number
        self.pairs = Buckets(spark, f"{path}/pairs", "name string, photo_id long, at timestamp_ntz, on boolean", ["name", "photo_id"], ["at", "on"], buckets, ["photo_id"])
        self.points = Buckets(spark, f"{path}/points", "photo_id long, at timestamp_ntz, vector array<double>", "photo_id", ["at", "vector"], buckets)
        self.drops = Buckets(spark, f"{path}/drops", "name string, at timestamp_ntz", "name", ["at"], buckets)
        self.sums = Buckets(spark, f"{path}/sums", "name string, dim int, version long, n long, s array<double>", ["name", "dim"], ["version"], buckets, ["name"])

    def read(self) -> DataFrame:
        """(name, n, mean, centroid) of the sets that have photos with vectors; one row for each dimension among these.

        The centroid is the normalised mean, null where that has no length.
        """
        half = F.col("dim")
        n = F.nullif(F.col("n"), F.lit(0))  # emptied sets are filtered out, but maybe after this is worked out
        mean = F.zip_with(F.slice("s", 1, half), F.slice("s", half + 1, half), lambda a, b: (a / COARSE + b / (COARSE * FINE)) / n)
        return self.sums.read().where("n > 0").select("name", "n", mean.alias("mean")).withColumn("centroid", l2_normalise(F.col("mean")))

    def done(self) -> int:
        """Number of the last batch that readers see, -1 before the first."""
        return self.sums.done()

    def _live(self, number: int, photos: DataFrame, buckets: list[int]) -> DataFrame:
        """(name, photo_id) of the photos in their sets, as of a batch."""
        pairs = self.pairs.read(number, buckets).where("on").join(photos, "photo_id", "left_semi")
        drops = self.drops.read(number).select("name", F.col("at").alias("dropped"))
        return pairs.join(drops, "name", "left").where("dropped is null or at >= dropped").select("name", "photo_id")

    def _moves(self, number: int, photos: DataFrame, buckets: list[int]) -> DataFrame:
        """(photo_id, was, now, dim, vector): what a photo brings to a set that it was or is in, before and after a batch.

        The vector has both parts of the photo's, and 1, 0 or -1 for their number.  It is worked out once a
        photo, and a photo that stays in a set with the vector that it had brings nothing.
        """

        def known(n, column):
            points = self.points.read(n, buckets).where("vector is not null").join(photos, "photo_id", "left_semi")
            return points.select("photo_id", _parts(F.col("vector")).alias(column))

        def move(was, now, vector, more):
            dim = (F.size(vector) / 2).cast("int")
            return F.struct(F.lit(was).alias("was"), F.lit(now).alias("now"), dim.alias("dim"), F.concat(vector, F.array(F.lit(more))).alias("vector"))

        old, new = F.col("old"), F.col("new")
        less = F.transform(old, lambda x: -x)
        alike = F.coalesce(F.size(old) == F.size(new), F.lit(False)) & old.isNotNull() & new.isNotNull()
        moves = [F.when(old.isNotNull(), move(True, False, less, -1.0)), F.when(new.isNotNull(), move(False, True, new, 1.0))]
        moves.append(F.when(alike & (old != new), move(True, True, F.zip_with(new, old, lambda a, b: a - b), 0.0)))
        moves += [F.when(old.isNotNull() & ~alike, move(True, True, less, -1.0)), F.when(new.isNotNull() & ~alike, move(True, True, new, 1.0))]
        both = known(number - 1, "old").join(known(number, "new"), "photo_id", "full")
        return both.select("photo_id", F.inline(F.filter(F.array(*moves), lambda m: m.isNotNull())))

    def fold(self, batch: DataFrame, number: int) -> None:
        """Take in a micro-batch of the log.

        The sums are written last and say that the batch is over; if the driver is lost before,
        the tables that are written already stay, and what they were before the batch is still there.
        """
        if number <= self.done():
            return
        scratch = Scratch(self.spark)
        log = scratch.keep(batch.select("at", "kind", "name", "photo_id", "vector"), "centroid-log")
        pairs = log.where("kind in ('add', 'remove')").select("name", "photo_id", "at", (F.col("kind") == "add").alias("on")).dropna(subset=["name", "photo_id"])
        points = log.where("kind in ('vector', 'delete')").select("photo_id", "at", F.when(F.col("kind") == "vector", _usable(F.col("vector"))).alias("vector"))
        drops = log.where("kind = 'drop' and name is not null").select("name", "at")
        kinds = {r.kind for r in log.where(F.col("kind").isin(*KINDS)).select("kind").distinct().collect()}
        for table, rows, some in ((self.pairs, pairs, {"add", "remove"}), (self.points, points, {"vector", "delete"}), (self.drops, drops, {"drop"})):
            if kinds & some:
                table.fold(rows, number)
        ids = pairs.select("photo_id").union(points.select("photo_id"))
        if "drop" in kinds:  # the photos of an emptied set may be in any bucket
            ids = ids.union(self.pairs.read(number).join(drops.select("name"), "name", "left_semi").select("photo_id"))
        photos = scratch.keep(ids.where("photo_id is not null").distinct(), "centroid-photos")
        buckets = self.points.touched(photos)
        lives = [self._live(n, photos, buckets).select("name", "photo_id", F.lit(n < number).alias("was"), F.lit(n == number).alias("now")) for n in (number - 1, number)]
        pairs = lives[0].union(lives[1]).groupBy("name", "photo_id").agg(F.max("was").alias("was"), F.max("now").alias("now"))
        moved = pairs.join(self._moves(number, photos, buckets), ["photo_id", "was", "now"]).select("name", "dim", "vector")
        more, by = F.element_at("s", -1).cast("long"), F.slice("s", F.lit(1), 2 * F.col("dim"))
        change = sum_vectors(moved, ["name", "dim"]).select("name", "dim", more.alias("more"), by.alias("by"))
        old = self.sums.read(number - 1).select("name", "dim", "n", "s")
        s = F.when(F.col("s").isNull(), F.col("by")).otherwise(F.zip_with("s", "by", lambda a, b: a + b))
        new = change.join(old, ["name", "dim"], "left").select("name", "dim", F.lit(number).cast("long").alias("version"), (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"), s.alias("s"))
        new = scratch.keep(new, "centroid-sums")
        self.sums.fold(new, number)
        scratch.drop(log, photos, new)


def centroid_stream(log: DataFrame, kept: KeptCentroids, checkpoint: str, trigger: dict | None = None):
    """Fold a stream of the log into the centroids."""
    return log.writeStream.foreachBatch(kept.fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
