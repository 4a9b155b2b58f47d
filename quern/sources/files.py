"""Snapshots of a file tree as tables, through Spark's own readers, so any store will do."""

from __future__ import annotations

import signal
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators.ingest import IMAGE_SUFFIXES, is_image


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime seconds, size) of the images below a folder, contents unread.

    A missing root is an error.  Files of other kinds, dot files and system files are left
    out, and so is what lies in dot folders, which Spark's listing does not enter.
    """
    either_case = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in "|".join(IMAGE_SUFFIXES)).replace("|", ",")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{either_case}}}").load(root)
    out = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("modificationTime").cast("long").alias("mtime"), F.col("length").alias("size"))
    return out.where(is_image(F.col("path")))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, content_sha256) of the images below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(is_image(F.col("path")))
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content", F.sha2("content", 256).alias("content_sha256"))


@contextmanager
def within(seconds: float):
    """TimeoutError for what takes longer, in a process's main thread, as Python workers run their tasks."""

    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def decoded(files: DataFrame, size: int = 384, seconds: float = 30.0) -> DataFrame:
    """Letterboxed RGB pixels (path, pixels binary or null) of image contents; needs Pillow on the executors.

    What is no image, or takes longer than ``seconds``, has null pixels.
    """

    def run(batches):
        import io

        import pandas as pd
        from PIL import Image, ImageOps

        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    with within(seconds):
                        image = ImageOps.exif_transpose(Image.open(io.BytesIO(content))).convert("RGB")
                        out.append(ImageOps.pad(image, (size, size), color=(0, 0, 0)).tobytes())
                except (OSError, ValueError):  # TimeoutError is an OSError
                    out.append(None)
            yield pd.DataFrame({"path": batch["path"], "pixels": out})

    return files.select("path", "content").mapInPandas(run, "path string, pixels binary")
