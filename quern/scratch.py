"""Scratch tables: the one place where intermediate results are written.

Iterative and multi-pass operators cut their lineage by writing a Parquet table
below the folder that the cluster names in ``spark.checkpoint.dir``, which the
driver and all executors share.  Only where that setting is absent and Spark runs in this
process (local runs, tests) a folder of this process is used; a cluster without
the setting is an error.  Operators remove what they have read to its end; tables that a
lazy result still reads go when the driver's process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROW_GROUP_BYTES = 16 << 20

_local: dict[str, str] = {}
_made: dict[str, SparkSession] = {}


def _setting(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def scratch_root(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    root = _setting(spark)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if "root" not in _local:
            _local["root"] = "file://" + (folder := tempfile.mkdtemp(prefix="quern-"))
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = _local["root"]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, which goes when this process ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    return path


def _remove_all() -> None:
    for path, spark in list(_made.items()):
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the cluster is gone before its driver
            return


class Scratch:
    """Tables of one run of an operator; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = scratch_path(self.spark, label)
        # small row groups: a task that writes long texts holds little of them
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        # the schema is known, so that no job is spent on reading it back
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quern_path = path  # keeps the frame and its path together
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_quern_path", None)
            if path:
                delete_path(self.spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    _made.pop(path, None)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(_remove_all)
