"""Results kept for a while, and a cache of the index that one writer refreshes."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.scratch import Scratch
from quern.sources.tables import replace

# fixed values: how long a ranking is kept, and how many
TTL_SECONDS, MOST_ENTRIES = 300, 64


class ResultCache:
    """Whole rankings by key, as scratch tables; the oldest goes when there are too many."""

    def __init__(self, spark: SparkSession, ttl: float = TTL_SECONDS, most: int = MOST_ENTRIES, clock: Callable[[], float] = time.monotonic):
        self._scratch, self._ttl, self._most, self._clock = Scratch(spark), max(0.0, ttl), max(1, most), clock
        self._held: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()

    def __len__(self) -> int:
        return len(self._held)

    def get(self, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The table that is kept for the key, or else what ``compute`` gives, kept from now on."""
        held = self._held.get(key)
        if held and self._clock() - held[0] < self._ttl:
            return held[1]
        self._drop(key)
        if not self._ttl:
            return compute()
        kept = self._scratch.keep(compute(), "result")
        self._held[key] = self._clock(), kept
        while len(self._held) > self._most:
            self._drop(next(iter(self._held)))
        return kept

    def _drop(self, key: str) -> None:
        held = self._held.pop(key, None)
        if held:
            self._scratch.drop(held[1])

    def clear(self) -> None:
        for key in list(self._held):
            self._drop(key)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def checked_images(points: DataFrame) -> DataFrame:
    """Rows of the index cache; a point without an id or a path fails the job, and with it the rebuild."""
    bad = F.col("id").isNull() | (F.coalesce("path", F.lit("")) == "")
    key = F.when(bad, F.raise_error(F.lit("a point without id or path"))).otherwise(F.col("id"))
    return points.select(key.cast(points.schema["id"].dataType).alias("id"), *[c for c in points.columns if c != "id"])


def rebuild(points: DataFrame, path: str, force: bool = False) -> int:
    """Fill the cache table from the store and count it; a cache that has rows stays, unless forced.

    The new table is written beside the old one and takes its place in one move, so a
    rebuild that fails leaves the old one as it was.
    """
    spark = points.sparkSession
    if not force and exists(spark, path):
        n = spark.read.parquet(path).count()
        if n:
            return n
    replace(checked_images(points), path)
    return spark.read.parquet(path).count()


class Refresher:
    """Rebuilds of one cache by one writer at a time: whoever comes while a rebuild runs is told that it was skipped.

    The claim is a file that only one writer can create, so it also holds between drivers;
    a claim older than ``stale`` seconds is that of a driver that was lost.
    """

    def __init__(self, spark: SparkSession, path: str, stale: float = 21_600):
        self.spark, self.path, self.stale = spark, path, stale
        self._claim = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".refresh")

    def _store(self):
        return self._claim.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def claim(self) -> bool:
        store = self._store()
        if store.exists(self._claim) and time.time() - store.getFileStatus(self._claim).getModificationTime() / 1000 > self.stale:
            store.delete(self._claim, False)
        return bool(store.createNewFile(self._claim))

    def release(self) -> None:
        self._store().delete(self._claim, False)

    def refresh(self, points: Callable[[], DataFrame]) -> int | None:
        """Rows after a forced rebuild, or None if another writer is at it."""
        if not self.claim():
            return None
        try:
            return rebuild(points(), self.path, force=True)
        finally:
            self.release()
