"""Ingestion from end to end: walk, plan, embed, upsert, prune, as tables in and a table out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.scalars import point_id
from quern.operators.ingest import backfill, canonical_path


@dataclass(frozen=True)
class Source:
    """A folder that a run manages: its name is the points' collection."""

    name: str
    base: str
    prefix: str


def _located(files: DataFrame, source: Source) -> DataFrame:
    """Files of a source with the id and the path that their points have."""
    return files.select(point_id(F.lit(""), F.col("path")).alias("id"), canonical_path(F.col("path"), source.base, source.prefix).alias("path"), F.lit(source.name).alias("collection"), "mtime", "size", "content")


def plan(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files with a ``reason``: new, changed (a time or size is missing or differs), or skip."""
    i = index.select("id", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_known"))
    same = F.coalesce((F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s")), F.lit(False))
    reason = F.when(F.col("_known").isNull(), "new").when(same, "skip").otherwise("changed")
    return files.join(i, "id", "left").withColumn("reason", reason).drop("_m", "_s", "_known")


def prune(index: DataFrame, files: DataFrame, collections: Sequence[str]) -> DataFrame:
    """Points of the managed collections whose path is blank or no file any more."""
    return index.where(F.col("collection").isin(list(collections))).join(files.select("path").where("path <> ''"), "path", "left_anti")


def synced(index: DataFrame, walks: Sequence[tuple[Source, DataFrame]], embed: Callable[[Column], Column], pruning: bool = False, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """(index after the run, counts) of a run over the walks (path, mtime, size, content) of its sources.

    New and changed files are embedded, into the point of the same id where there is one;
    files that cannot be embedded (a null vector) are errors and leave the index alone.
    Pruning takes the managed sources together, so that no source loses points to another,
    and never touches others; a full run brings times and sizes up to date, too, and prunes
    last.  Nothing is written here: for a dry run look at the counts.  They are one row:
    indexed, re_embedded, skipped, errors, pruned.
    """
    names = [s.name for s, _ in walks]
    files = None
    for source, walk in walks:
        located = _located(walk, source)
        files = located if files is None else files.unionByName(located)
    planned = plan(files, index).withColumn("vector", F.when(F.col("reason") != "skip", embed(F.col("content"))))
    done = planned.where("reason <> 'skip' and vector is not null")
    columns = index.columns
    fresh = done.select(*[F.col(c) if c in planned.columns else F.lit(None).cast(index.schema[c].dataType).alias(c) for c in columns])
    kept = index
    lost = prune(index, files, names).select("id") if pruning or full else None
    if lost is not None:
        kept = kept.join(lost, "id", "left_anti").select(*columns)
    if full:
        stale = backfill(kept, files.select("id", "mtime", "size"), "id", ["mtime", "size"])
        new = stale.select("id", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_hit"))
        j = kept.join(new, "id", "left")
        kept = j.select(*[F.when(F.col("_hit"), F.col({"mtime": "_m", "size": "_s"}[c])).otherwise(F.col(c)).alias(c) if c in ("mtime", "size") else F.col(c) for c in columns])
    after = kept.join(fresh.select("id"), "id", "left_anti").select(*columns).unionByName(fresh)
    counts = planned.agg(
        F.count_if((F.col("reason") == "new") & F.col("vector").isNotNull()).alias("indexed"),
        F.count_if((F.col("reason") == "changed") & F.col("vector").isNotNull()).alias("re_embedded"),
        F.count_if(F.col("reason") == "skip").alias("skipped"),
        F.count_if((F.col("reason") != "skip") & F.col("vector").isNull()).alias("errors"),
    )
    pruned = lost.agg(F.count("*").alias("pruned")) if lost is not None else counts.sparkSession.createDataFrame([(0,)], "pruned long")
    return after, counts.crossJoin(pruned)
