"""Ingestion and reconciliation of files and index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: what counts as an image, and what never does
IMAGE_SUFFIXES = ("jpg", "jpeg", "jfif", "png", "webp", "heic", "heif")
SKIPPED_NAMES = ("thumbs.db", ".ds_store")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def is_image(path: Column) -> Column:
    """By suffix, whatever its case; no dot files, no system files."""
    name = F.lower(base_name(path))
    return name.rlike(r"\.(" + "|".join(IMAGE_SUFFIXES) + ")$") & ~name.startswith(".") & ~name.isin(*SKIPPED_NAMES)


def under_root(path: Column, root: str) -> Column:
    """Whether a path is the root or below it: case and kind of slash do not matter, segments do."""
    r = root.replace("\\", "/").rstrip("/").lower()
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return (p == r) | p.startswith(r + "/")


def sync_plan(files: DataFrame, index: DataFrame) -> DataFrame:
    """(path, reason) of each file: new, changed (a time or size is missing or differs) or skip."""
    i = index.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_known"))
    j = files.join(i, "path", "left")
    same = F.coalesce((F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s")), F.lit(False))
    return j.select("path", F.when(F.col("_known").isNull(), "new").when(same, "skip").otherwise("changed").alias("reason"))


def prune(index: DataFrame, files: DataFrame, collections: list[str] | None = None) -> DataFrame:
    """Index rows, within the collections, whose path is blank or no file."""
    scope = index.where(F.col("collection").isin(collections)) if collections else index
    return scope.join(files.select("path").where("path <> ''"), "path", "left_anti")


def reconcile(files: DataFrame, index: DataFrame, root: str) -> DataFrame:
    """(path, state) of files and index: new, same, modified, orphan, outside or no_path.

    A missing time or size differs from any value, and equals a missing one.
    """
    f = files.select("path", F.col("mtime").alias("fm"), F.col("size").alias("fs"), F.lit(True).alias("on_disk"))
    i = index.select("path", F.col("mtime").alias("im"), F.col("size").alias("is"), F.lit(True).alias("known"))
    j = f.join(i.where("path <> ''"), "path", "full")
    state = (
        F.when(~under_root(F.col("path"), root), "outside")
        .when(F.col("known").isNull(), "new")
        .when(F.col("on_disk").isNull(), "orphan")
        .when(F.col("fm").eqNullSafe(F.col("im")) & F.col("fs").eqNullSafe(F.col("is")), "same")
        .otherwise("modified")
    )
    lost = index.where("path is null or path = ''").select("path", F.lit("no_path").alias("state"))
    return j.select("path", state.alias("state")).union(lost)


def canonical_path(path: Column, base: str, prefix: str) -> Column:
    """The local base replaced by the stored prefix, whatever the base's case; other paths stay."""
    p, b = F.replace(path, F.lit("\\"), F.lit("/")), base.replace("\\", "/").rstrip("/")
    rest = F.substr(p, F.lit(len(b) + 1))
    return F.when(F.lower(p).startswith(b.lower() + "/"), F.concat(F.lit(prefix.rstrip("/")), rest)).otherwise(path)


def source_of_path(path: Column) -> Column:
    """The two segments after ``/images/``; null if there are not both and something below."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.nullif(F.regexp_extract(p, r"(?i)/images/([^/]+/[^/]+)/", 1), F.lit(""))


def migration(index: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """(id, desired, outcome): already_correct, updated, unmapped or no_path."""
    desired = source_of_path(F.col(path))
    outcome = F.when(F.coalesce(F.col(path), F.lit("")) == "", "no_path").when(desired.isNull(), "unmapped").when(desired.eqNullSafe(F.col(source)), "already_correct").otherwise("updated")
    return index.select("id", F.col(source).alias("current"), desired.alias("desired"), outcome.alias("outcome"))


def backfill(stored: DataFrame, computed: DataFrame, key: str, columns: list[str], collections: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Keys, within the collections, of which some column differs from what was computed, a missing value included.

    With a limit, so many of them in the order of the key: what one run is to write.
    """
    scope = stored.where(F.col("collection").isin(collections)) if collections else stored
    c = computed.select(key, *[F.col(x).alias(f"_c_{x}") for x in columns])
    differ = F.lit(False)
    for x in columns:
        differ = differ | ~F.col(x).eqNullSafe(F.col(f"_c_{x}"))
    out = scope.join(c, key).where(differ).select(key, *[F.col(f"_c_{x}").alias(x) for x in columns])
    return out.orderBy(key).limit(limit) if limit is not None else out


def common_root(paths: DataFrame) -> DataFrame:
    """The longest directory that all paths share: it is shared by the least and the largest path."""
    ends = paths.agg(F.min("path").alias("a"), F.max("path").alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    same = F.aggregate(
        F.arrays_zip(a.alias("x"), b.alias("y")),
        F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")),
        lambda acc, z: F.struct((acc.on & z.x.eqNullSafe(z.y)).alias("on"), (acc.n + F.when(acc.on & z.x.eqNullSafe(z.y), 1).otherwise(0)).alias("n")),
        lambda acc: acc.n,
    )
    return ends.select(F.array_join(F.slice(a, F.lit(1), F.least(same, F.size(a) - 1)), "/").alias("root"))
