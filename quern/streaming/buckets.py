"""A keyed table in hashed buckets, kept up to date by micro-batches.

A micro-batch folds into the buckets that it touches, writes their next versions under its number,
and then says in one small file which version of each bucket counts.  So readers see whole
batches, a batch that is run again replaces what it wrote, and one that had been counted changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators.state import latest
from quern.scratch import delete_path


class Buckets:
    """The table below ``path``: of each key the row that is last by ``order``.

    A key is one column or several.  Rows are dealt to buckets by the columns ``by``, which are
    among the key's (all of them if not given).  ``buckets`` bounds what a batch of few keys
    rewrites, and how much of the table one task holds.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | list[str], order: list[str], buckets: int = 64, by: list[str] | None = None):
        self.spark, self.path, self.schema, self.order, self.buckets = spark, path.rstrip("/"), schema, order, buckets
        self.keys = [key] if isinstance(key, str) else list(key)
        self.by = by or self.keys
        self.columns = spark.createDataFrame([], schema).columns

    def _versions(self, number: int) -> dict[int, int]:
        """Version of each bucket after micro-batch ``number``; nothing before the first."""
        if number < 0:
            return {}
        stream = self._store().open(self._state(number))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _store(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _state(self, number: int):
        return self._path(f"{self.path}/state-{number}.json")

    def _folders(self, versions: dict[int, int]) -> list[str]:
        return [f"{self.path}/v={v}/bucket={b}" for b, v in sorted(versions.items())]

    def _complete(self) -> list[int]:
        root, store = self._path(self.path), self._store()
        names = [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []
        return sorted(int(n[len("state-") : -len(".json")]) for n in names if n.startswith("state-"))

    def done(self) -> int:
        """Number of the last complete micro-batch, -1 before the first."""
        return max(self._complete(), default=-1)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Numbers of the buckets that the rows, which have the columns ``by``, belong to."""
        return sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table after the last complete micro-batch; of some buckets only, if these are given.

        With a number, as it was after that batch, or after the last one before it.  This can be
        asked for the last complete batch and for the one before it.
        """
        at = max((n for n in self._complete() if number is None or n <= number), default=-1)
        folders = self._folders({b: v for b, v in self._versions(at).items() if buckets is None or b in buckets})
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def fold(self, batch: DataFrame, number: int) -> None:
        """Take in a micro-batch; those up to the last complete one change nothing.  Null keys are left out."""
        last = self.done()
        if number <= last:
            return
        before = self._versions(last)
        new = latest(batch.dropna(subset=self.keys).select(*self.columns), self.keys, self.order)
        touched = self.touched(new)
        old = self._folders({b: v for b, v in before.items() if b in touched})
        if old:
            new = latest(self.spark.read.schema(self.schema).parquet(*old).unionByName(new), self.keys, self.order)
        now = before | {b: number for b in touched}
        if touched:
            new.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={number}")
        self._count(now, number)
        # what a reader of the batch before may still read stays
        kept = set(self._folders(now)) | set(self._folders(before))
        for n in [n for n in self._complete() if n < last]:
            for folder in set(self._folders(self._versions(n))) - kept:
                delete_path(self.spark, folder)
            delete_path(self.spark, f"{self.path}/state-{n}.json")

    def _count(self, versions: dict[int, int], number: int) -> None:
        """Write the file of versions: it has its name once it is whole."""
        store, draft = self._store(), self._path(f"{self.path}/_draft-{number}")
        stream = store.create(draft, True)
        stream.write(json.dumps(versions).encode())
        stream.close()
        if not store.rename(draft, self._state(number)):
            raise OSError(f"batch {number} of {self.path} could not be counted")
