"""Tables of the library's state: explicit schemas, an index cache, and atomic replacement."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.scratch import delete_path

POINTS = (
    "id string, vector array<float>, path string not null, shard string, collection string, blurhash string, content_sha256 string, dhash string, "
    "mtime long, size long, model_name string, model_revision string, indexed_at timestamp, width int, height int, source string"
)
CACHE = "version int, collection string, path string, id string, mtime long, size long"
CACHE_VERSION = 1


def read_cache(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """Entries of an index cache in JSON lines; those of other versions or collections do not count."""
    return spark.read.schema(CACHE).json(path).where((F.col("version") == CACHE_VERSION) & (F.col("collection") == collection)).select("path", "id", "mtime", "size")


def write_cache(entries: DataFrame, path: str, collection: str) -> None:
    rows = entries.select(F.lit(CACHE_VERSION).alias("version"), F.lit(collection).alias("collection"), "path", "id", "mtime", "size")
    replace(rows, path, "json")


def replace(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write beside the table and rename in place, so that readers see the old or the new one.

    The result may read from the table that it replaces.
    """
    spark, beside = df.sparkSession, f"{path}.{uuid.uuid4().hex[:8]}"
    df.write.format(kind).save(beside)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    delete_path(spark, path)
    if not store.rename(hadoop(beside), hadoop(path)):
        raise OSError(f"{beside} could not be moved to {path}")


def once(spark: SparkSession, flags: str, key: str, work: Callable[[], None]) -> bool:
    """Do a migration unless its flag is set, then set it; whether it was done now.

    A flag is a file in the folder ``flags``, made after the work, so work that fails is
    done again.
    """
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{flags.rstrip('/')}/{key}")
    store = mark.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(mark):
        return False
    work()
    store.mkdirs(mark.getParent())
    store.createNewFile(mark)
    return True
