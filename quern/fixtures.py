"""Views of a photo library over the driver's tables, for Spark and, word for word, for SQL.

The tables hold no photos, so vectors with documents stand for points, purchases and errors
of one user for likes and dislikes, views for album memberships, and pages for files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LIKER = 8  # the user whose purchases and errors are the likes and dislikes

SQL = """
WITH RECURSIVE points AS (
  SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS vector, 'lib' || e.label AS collection, coalesce(d.lang, '') AS shard,
    '/images/' || coalesce(d.source, 'none') || '/lib' || e.label || '/' || e.vec_id || '.jpg' AS path,
    sha256(d.text) AS content_sha256, d.n_chars AS size
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
), favorites AS (
  SELECT CAST(props->>'$.k' AS BIGINT) AS id, max(ts) AS favorited_at FROM events WHERE event_type = 'purchase' AND user_id = 8 GROUP BY 1
), dislikes AS (
  SELECT CAST(props->>'$.k' AS BIGINT) AS id, max(ts) AS disliked_at FROM events WHERE event_type = 'error' AND user_id = 8 GROUP BY 1
), feedback AS (
  SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS photo_id, CASE WHEN event_type = 'purchase' THEN 'like' ELSE 'dislike' END AS kind, ts AS at
  FROM events WHERE event_type IN ('purchase', 'error')
), members AS (
  SELECT user_id AS album_id, CAST(props->>'$.k' AS BIGINT) AS photo_id, min(ts) AS added_at FROM events WHERE event_type = 'view' GROUP BY 1, 2
), albums AS (
  SELECT album_id, 'album-' || album_id AS name FROM members GROUP BY album_id
), files AS (
  SELECT page_id AS id, '/images/s' || (page_id % 4) || '/set' || (page_id % 9) || '/' || page_id ||
    CASE page_id % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.webp' WHEN 3 THEN '.jpeg' ELSE '.txt' END AS path, length(html) AS size FROM pages
), disk AS (
  SELECT path, id AS mtime, size FROM files WHERE id % 7 <> 0
), indexed AS (
  SELECT id, path, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 11 = 0 THEN id + 1 ELSE id END AS mtime, size, 'src' || (id % 3) AS collection FROM files WHERE id % 5 <> 0
)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    j = e.join(d, e.vec_id == d.doc_id, "left")
    return j.select(
        e.vec_id.alias("id"),
        e.embedding.cast("array<double>").alias("vector"),
        F.concat(F.lit("lib"), e.label).alias("collection"),
        F.coalesce(d.lang, F.lit("")).alias("shard"),
        F.concat(F.lit("/images/"), F.coalesce(d.source, F.lit("none")), F.lit("/lib"), e.label, F.lit("/"), e.vec_id, F.lit(".jpg")).alias("path"),
        F.sha2(d.text, 256).alias("content_sha256"),
        d.n_chars.alias("size"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vector and collection alone: no join for queries that need no document."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(e.vec_id.alias("id"), e.embedding.cast("array<double>").alias("vector"), F.concat(F.lit("lib"), e.label).alias("collection"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def _latest(spark, sf_dir, event_type, at):
    e = table(spark, sf_dir, "events").where((F.col("event_type") == event_type) & (F.col("user_id") == LIKER))
    return e.groupBy(_k().alias("id")).agg(F.max("ts").alias(at))


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir, "purchase", "favorited_at")


def dislikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir, "error", "disliked_at")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return e.select("event_id", _k().alias("photo_id"), F.when(F.col("event_type") == "purchase", "like").otherwise("dislike").alias("kind"), F.col("ts").alias("at"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.groupBy(F.col("user_id").alias("album_id"), _k().alias("photo_id")).agg(F.min("ts").alias("added_at"))


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).select("album_id").distinct().withColumn("name", F.concat(F.lit("album-"), "album_id"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    ext = F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".webp", ".jpeg", ".txt"))), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/images/s"), F.col("page_id") % 4, F.lit("/set"), F.col("page_id") % 9, F.lit("/"), "page_id", ext)
    return p.select(F.col("page_id").alias("id"), path.alias("path"), F.length("html").cast("long").alias("size"))


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as a walk finds them; every seventh is gone."""
    return files(spark, sf_dir).where("id % 7 <> 0").select("path", F.col("id").alias("mtime"), "size")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as the index knows them: some are missing, some changed since, some without a time."""
    f = files(spark, sf_dir).where("id % 5 <> 0")
    mtime = F.when(F.col("id") % 13 == 0, None).when(F.col("id") % 11 == 0, F.col("id") + 1).otherwise(F.col("id"))
    return f.select("id", "path", mtime.alias("mtime"), "size", F.concat(F.lit("src"), F.col("id") % 3).alias("collection"))
