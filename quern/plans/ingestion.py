"""Queries of ingestion, reconciliation, path filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from quern import fixtures as X
from quern.functions import scalars as C
from quern.operators import ingest as I, textfilter as T
from quern.operators.search import MOST_PROMPTS
from quern.plans.registry import query
from quern.plans.retrieval import sql
from quern.scratch import scratch_path
from quern.streaming.changes import Changes

IMG = r"regexp_matches(lower(path), '\.(jpg|jpeg|jfif|png|webp|heic|heif)$')"


@query("scan_file_filter", sql(f"SELECT path, mtime, size FROM disk WHERE {IMG}"))
def scan_file_filter(spark, d):
    return X.disk(spark, d).where(I.is_image(F.col("path")))


@query("liveness_filter", sql("SELECT i.id, i.path FROM indexed i WHERE i.path IN (SELECT path FROM disk)"))
def liveness_filter(spark, d):
    return X.indexed(spark, d).join(X.disk(spark, d).select("path"), "path", "left_semi").select("id", "path")


@query("cache_hit_join", sql("SELECT d.path FROM disk d JOIN indexed i ON i.path = d.path AND i.mtime = d.mtime AND i.size = d.size"))
def cache_hit_join(spark, d):
    return X.disk(spark, d).join(X.indexed(spark, d).select("path", "mtime", "size"), ["path", "mtime", "size"]).select("path")


@query("cache_rebuild", sql("SELECT i.id, i.path, d.mtime, d.size FROM indexed i JOIN disk d USING (path)"))
def cache_rebuild(spark, d):
    return X.indexed(spark, d).select("id", "path").join(X.disk(spark, d), "path").select("id", "path", "mtime", "size")


@query("images_rebuild", sql("SELECT id, path, collection, coalesce(mtime, 0) AS mtime, size FROM indexed"))
def images_rebuild(spark, d):
    from quern.sources.cache import checked_images

    return checked_images(X.indexed(spark, d)).select("id", "path", "collection", F.coalesce("mtime", F.lit(0)).alias("mtime"), "size")


@query("sync_counts", sql(", s AS (SELECT d.path, CASE WHEN i.path IS NULL THEN 'new' WHEN d.mtime = i.mtime AND d.size = i.size THEN 'skip' ELSE 'changed' END AS reason FROM disk d LEFT JOIN indexed i USING (path)), lost AS (SELECT path FROM indexed WHERE path NOT IN (SELECT path FROM disk)) SELECT count(*) FILTER (WHERE reason = 'new') AS indexed, count(*) FILTER (WHERE reason = 'changed') AS re_embedded, count(*) FILTER (WHERE reason = 'skip') AS skipped, 0 AS errors, (SELECT count(*) FROM lost) AS pruned FROM s"))
def sync_counts(spark, d):
    """What a run over all files does: embeds what is new or changed and prunes what is gone."""
    from quern.functions.images import mock_image_embedding
    from quern.operators.sync import Source, synced

    files = X.disk(spark, d).withColumn("content", F.col("path").cast("binary"))
    index = X.indexed(spark, d).select(C.point_id(F.lit(""), F.col("path")).alias("id"), "path", F.lit("all").alias("collection"), "mtime", "size", F.lit(None).cast("array<double>").alias("vector"))
    return synced(index, [(Source("all", "/images", "/images"), files)], lambda c: mock_image_embedding(c, 16), pruning=True)[1]


@query("stamps", f"SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stamps(spark, d):
    return X.table(spark, d, "events").select("event_id", C.iso_stamp(F.col("ts")).alias("stamp"), C.day_stamp(F.col("ts")).alias("day"))


@query("sync_plan", sql("SELECT d.path, CASE WHEN i.path IS NULL THEN 'new' WHEN d.mtime = i.mtime AND d.size = i.size THEN 'skip' ELSE 'changed' END AS reason FROM disk d LEFT JOIN indexed i USING (path)"))
def sync_plan(spark, d):
    return I.sync_plan(X.disk(spark, d), X.indexed(spark, d))


@query("sync_plan_counts", sql("SELECT CASE WHEN i.path IS NULL THEN 'new' WHEN d.mtime = i.mtime AND d.size = i.size THEN 'skip' ELSE 'changed' END AS reason, count(*) AS n FROM disk d LEFT JOIN indexed i USING (path) GROUP BY 1"))
def sync_plan_counts(spark, d):
    return I.sync_plan(X.disk(spark, d), X.indexed(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


@query("change_decisions", sql("SELECT d.path, CASE WHEN i.path IS NULL THEN 'new' WHEN d.mtime = i.mtime AND d.size = i.size THEN 'skip' ELSE 'changed' END AS reason FROM disk d LEFT JOIN indexed i USING (path) UNION ALL SELECT path, 'gone' FROM indexed WHERE path NOT IN (SELECT path FROM disk)"))
def change_decisions(spark, d):
    """The plan of a sync from sightings in two micro-batches, one of them run twice, and a walk's end that comes before the second."""
    changes, disk = Changes(spark, scratch_path(spark, "changes"), buckets=16), X.disk(spark, d)
    changes.start(X.indexed(spark, d))
    seen = disk.select("path", F.timestamp_seconds(F.col("mtime") % 1000 + 1).cast("timestamp_ntz").alias("seen_at"), "mtime", "size", F.lit(False).alias("walked"))
    walk = spark.range(1).select(F.lit("/Images/").alias("path"), F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz").alias("seen_at"), F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("long").alias("size"), F.lit(True).alias("walked"))
    changes.fold(seen.where("mtime % 2 = 0"), 1)
    changes.fold(seen.where("mtime % 2 = 0"), 1)
    changes.fold(seen.where("mtime % 2 <> 0").union(walk), 2)
    return changes.decisions().select("path", "reason")


@query("prune_missing", sql("SELECT id, path FROM indexed WHERE collection IN ('src0', 'src1') AND path NOT IN (SELECT path FROM disk)"))
def prune_missing(spark, d):
    return I.prune(X.indexed(spark, d), X.disk(spark, d), ["src0", "src1"]).select("id", "path")


@query("delete_orphans", sql("SELECT id, path FROM indexed WHERE path IN (SELECT path FROM disk) OR collection NOT IN ('src0', 'src1')"))
def delete_orphans(spark, d):
    i = X.indexed(spark, d)
    return i.join(I.prune(i, X.disk(spark, d), ["src0", "src1"]).select("id"), "id", "left_anti").select("id", "path")


HEAL = """, j AS (SELECT coalesce(d.path, i.path) AS path, d.path IS NOT NULL AS on_disk, i.path IS NOT NULL AS known, d.mtime AS fm, d.size AS fs, i.mtime AS im, i.size AS s FROM disk d FULL JOIN indexed i ON d.path = i.path),
h AS (SELECT path, CASE WHEN NOT starts_with(lower(path), '/images/') THEN 'outside' WHEN NOT known THEN 'new' WHEN NOT on_disk THEN 'orphan' WHEN fm IS NOT DISTINCT FROM im AND fs IS NOT DISTINCT FROM s THEN 'same' ELSE 'modified' END AS state FROM j)"""


@query("heal_reconcile", sql(HEAL + " SELECT path, state FROM h"))
def heal_reconcile(spark, d):
    return I.reconcile(X.disk(spark, d), X.indexed(spark, d), "/Images")


@query("heal_summary", sql(HEAL + " SELECT state, count(*) AS n FROM h GROUP BY state"))
def heal_summary(spark, d):
    return I.reconcile(X.disk(spark, d), X.indexed(spark, d), "/Images").groupBy("state").agg(F.count("*").alias("n"))


@query("path_under_root", sql("SELECT id FROM files WHERE starts_with(lower(path), '/images/s1/')"))
def path_under_root(spark, d):
    return X.files(spark, d).where(I.under_root(F.col("path"), "\\IMAGES\\S1\\")).select("id")


@query("canonical_path", sql("SELECT id, CASE WHEN starts_with(path, '/images/s2/') THEN '//nas/photos' || substr(path, 11) ELSE path END AS path FROM files"))
def canonical_path(spark, d):
    return X.files(spark, d).select("id", I.canonical_path(F.col("path"), "/Images/S2", "//nas/photos/").alias("path"))


@query("resolve_local", sql("SELECT id, CASE WHEN starts_with(path, '/images/') THEN '/mnt/photos' || substr(path, 8) ELSE path END AS path FROM files"))
def resolve_local(spark, d):
    return X.files(spark, d).select("id", I.canonical_path(F.col("path"), "/images", "/mnt/photos").alias("path"))


@query("source_from_path", sql("SELECT id, nullif(regexp_extract(path, '/images/([^/]+/[^/]+)/', 1), '') AS source FROM files"))
def source_from_path(spark, d):
    return X.files(spark, d).select("id", I.source_of_path(F.col("path")).alias("source"))


MIG = ", m AS (SELECT id, CASE id % 3 WHEN 0 THEN 's' || (id % 4) || '/set' || (id % 9) WHEN 1 THEN 'old' END AS current, nullif(regexp_extract(path, '/images/([^/]+/[^/]+)/', 1), '') AS desired FROM files), o AS (SELECT *, CASE WHEN desired IS NULL THEN 'unmapped' WHEN desired IS NOT DISTINCT FROM current THEN 'already_correct' ELSE 'updated' END AS outcome FROM m)"


def _migration(spark, d):
    now = F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), F.col("id") % 4, F.lit("/set"), F.col("id") % 9)).when(F.col("id") % 3 == 1, "old")
    return I.migration(X.files(spark, d).withColumn("source", now))


@query("migrate_source", sql(MIG + " SELECT id, desired, outcome FROM o"))
def migrate_source(spark, d):
    return _migration(spark, d).select("id", "desired", "outcome")


@query("migrate_drift_report", sql(MIG + " SELECT desired, current, count(*) AS n FROM o WHERE outcome = 'updated' GROUP BY 1, 2"))
def migrate_drift_report(spark, d):
    return _migration(spark, d).where("outcome = 'updated'").groupBy("desired", "current").agg(F.count("*").alias("n"))


@query("backfill_diff", sql("SELECT i.id, d.mtime, d.size FROM indexed i JOIN disk d USING (path) WHERE i.mtime IS DISTINCT FROM d.mtime OR i.size IS DISTINCT FROM d.size"))
def backfill_diff(spark, d):
    i = X.indexed(spark, d)
    computed = X.disk(spark, d).join(i.select("id", "path"), "path")
    return I.backfill(i, computed, "id", ["mtime", "size"])


@query("existing_ids", sql("SELECT id FROM indexed WHERE id IN (SELECT id FROM files WHERE size > 3000)"))
def existing_ids(spark, d):
    return X.indexed(spark, d).select("id").join(X.files(spark, d).where("size > 3000"), "id", "left_semi")


@query("common_root", sql(", p AS (SELECT string_split(path, '/') AS p FROM files), depth AS (SELECT min(len(p)) - 1 AS n FROM p), same AS (SELECT i, count(DISTINCT list_slice(p, 1, i)) AS heads FROM p, depth, range(1, 50) r(i) WHERE i <= depth.n GROUP BY i) SELECT array_to_string(list_slice((SELECT any_value(p) FROM p), 1, (SELECT max(i) FROM same WHERE heads = 1)), '/') AS root"))
def common_root(spark, d):
    return I.common_root(X.files(spark, d))


@query("zip_manifest", sql("SELECT p.id, replace(p.shard, '/', '_') || '__' || p.id || '.jpg' AS entry, p.id IN (SELECT id FROM dislikes) AS missing FROM points p JOIN favorites f USING (id)"))
def zip_manifest(spark, d):
    p = X.points(spark, d).join(X.favorites(spark, d), "id", "left_semi")
    gone = X.dislikes(spark, d).select("id", F.lit(True).alias("missing"))
    return p.join(gone, "id", "left").select("id", C.zip_entry(F.col("shard"), F.col("path")).alias("entry"), F.coalesce("missing", F.lit(False)).alias("missing"))


TOK = ", t AS (SELECT page_id AS id, url AS path, list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda x: x <> '') AS tokens FROM pages)"


def _paths(spark, d):
    return X.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"))


@query("path_token_match", sql(TOK + " SELECT id FROM t WHERE list_contains(tokens, 'm')"))
def path_token_match(spark, d):
    return _paths(spark, d).where(T.matches(F.col("path"), T.Pattern.parse("M"))).select("id")


@query("path_token_prefix", sql(TOK + " SELECT id FROM t WHERE len(list_filter(tokens, lambda x: starts_with(x, 'thth'))) > 0"))
def path_token_prefix(spark, d):
    return _paths(spark, d).where(T.matches(F.col("path"), T.Pattern.parse("thth*"))).select("id")


@query("filename_guard", sql(TOK + ", c AS (SELECT avg(CASE WHEN list_contains(tokens, 'en') THEN 1.0 ELSE 0.0 END) AS share FROM t) SELECT id FROM t, c WHERE list_contains(tokens, 'en') OR share > 0.5"))
def filename_guard(spark, d):
    return T.guarded(_paths(spark, d), T.Pattern.parse("en")).select("id")


@query("content_hash", "SELECT doc_id AS id, sha256(text) AS content_sha256 FROM documents")
def content_hash(spark, d):
    t = X.table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_sha256"))


UUID = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(shard || '::' || path))"


@query("point_id_uuid5", sql(f", h AS (SELECT id, {UUID} AS h FROM points) SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(strpos('0123456789abcdef', substr(h, 17, 1)) - 1 AS BIGINT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h"))
def point_id_uuid5(spark, d):
    return X.points(spark, d).select("id", C.point_id(F.col("shard"), F.col("path")).alias("point_id"))


@query("dhash_from_pixels", sql(", b AS (SELECT id, [CASE WHEN vector[CAST(i // 8 * 9 + i % 8 AS BIGINT) % 64 + 1] > vector[CAST(i // 8 * 9 + i % 8 + 1 AS BIGINT) % 64 + 1] THEN 1 ELSE 0 END for i in range(64)] AS bits FROM points) SELECT id, list_aggregate([substr('0123456789abcdef', CAST(bits[4 * j + 1] * 8 + bits[4 * j + 2] * 4 + bits[4 * j + 3] * 2 + bits[4 * j + 4] AS BIGINT) + 1, 1) for j in range(16)], 'string_agg', '') AS dhash FROM b"))
def dhash_from_pixels(spark, d):
    """A vector, read round, stands for eight rows of nine pixels."""
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.get("vector", i % 64))
    return X.vectors(spark, d).select("id", C.dhash(pixels).alias("dhash"))


@query("blurhash_valid", "SELECT page_id, coalesce(regexp_full_match(url, '[ -~]{6,200}'), FALSE) AS valid FROM pages")
def blurhash_valid(spark, d):
    return X.table(spark, d, "pages").select("page_id", C.blurhash_valid(F.col("url")).alias("valid"))


@query("content_type", sql("SELECT id, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' ELSE 'application/octet-stream' END AS content_type FROM files"))
def content_type(spark, d):
    return X.files(spark, d).select("id", C.content_type(F.col("path")).alias("content_type"))


@query("album_slug", "SELECT page_id, coalesce(nullif(left(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-'), 64), ''), CAST(page_id AS VARCHAR)) AS slug FROM pages")
def album_slug(spark, d):
    return X.table(spark, d, "pages").select("page_id", C.album_slug(F.col("url"), F.col("page_id").cast("string")).alias("slug"))


@query("optional_int", "SELECT event_id, TRY_CAST(CASE event_id % 3 WHEN 0 THEN ' 12 ' WHEN 1 THEN 'x1' ELSE CAST(user_id AS VARCHAR) END AS BIGINT) AS n FROM events")
def optional_int(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, " 12 ").when(F.col("event_id") % 3 == 1, "x1").otherwise(F.col("user_id").cast("string"))
    return X.table(spark, d, "events").select("event_id", C.optional_int(text).alias("n"))


@query("cache_key", sql(" SELECT id, left(sha256(sha256(list_aggregate(list_transform(vector, lambda x: printf('%.8f', x)), 'string_agg', ',')) || '|balanced|' || collection), 20) AS key FROM points"))
def cache_key(spark, d):
    return X.vectors(spark, d).select("id", C.cache_key(F.col("vector"), F.lit("balanced"), F.col("collection")).alias("key"))


@query("prompt_normalize", "WITH p AS (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE trim(text) <> '' AND length(trim(text)) <= 512), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(t) ORDER BY turn) AS n FROM p), k AS (SELECT conv_id, turn, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM r WHERE n = 1) SELECT conv_id, turn, t AS prompt FROM k WHERE pos <= 16")
def prompt_normalize(spark, d):
    """Of each conversation's texts as prompts: trimmed, the first of each spelling, sixteen at most."""
    c = X.table(spark, d, "conversations")
    p = c.select("conv_id", "turn", F.trim("text").alias("t")).where("t <> '' and length(t) <= 512")
    one = p.groupBy("conv_id", F.lower("t").alias("k")).agg(F.min(F.struct("turn", "t")).alias("r")).select("conv_id", "r.*")
    # each task keeps sixteen rows of a conversation before they are shuffled
    first = one.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "t"))).where(F.col("n") <= MOST_PROMPTS)
    return first.select("conv_id", "turn", F.col("t").alias("prompt"))
