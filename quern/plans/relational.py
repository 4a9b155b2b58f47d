"""Queries of user state: likes, dislikes, albums, saved searches, feedback, paging and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import fixtures as X
from quern.operators import state as O
from quern.plans.registry import query
from quern.plans.retrieval import seeded, sql
from quern.scratch import scratch_path
from quern.streaming.points import point_table

Q = '"at"'


@query("list_favorites", sql("SELECT p.id, p.path, f.favorited_at FROM points p JOIN favorites f USING (id) ORDER BY favorited_at DESC, id LIMIT 200"))
def list_favorites(spark, d):
    j = X.points(spark, d).join(X.favorites(spark, d), "id").select("id", "path", "favorited_at")
    return O.paged(j, [F.col("favorited_at").desc(), "id"], 200)


@query("list_dislikes", sql("SELECT p.id, p.path, f.disliked_at FROM points p JOIN dislikes f USING (id) ORDER BY disliked_at DESC, id LIMIT 200"))
def list_dislikes(spark, d):
    j = X.points(spark, d).join(X.dislikes(spark, d), "id").select("id", "path", "disliked_at")
    return O.paged(j, [F.col("disliked_at").desc(), "id"], 200)


@query("list_album_members", sql("SELECT m.album_id, p.id, p.path, m.added_at FROM members m JOIN points p ON p.id = m.photo_id"))
def list_album_members(spark, d):
    m = X.members(spark, d)
    return m.join(X.points(spark, d), m.photo_id == F.col("id")).select("album_id", "id", "path", "added_at")


@query("albums_for_photo", sql("SELECT a.album_id, a.name FROM albums a JOIN members m USING (album_id) WHERE m.photo_id = 7 ORDER BY name"))
def albums_for_photo(spark, d):
    m = X.members(spark, d).where("photo_id = 7").select("album_id")
    return X.albums(spark, d).join(m, "album_id").select("album_id", "name").orderBy("name")


@query("get_by_id", sql("SELECT p.id, p.path, p.collection, f.id IS NOT NULL AS is_favorite FROM points p LEFT JOIN favorites f USING (id) WHERE p.id = 7"))
def get_by_id(spark, d):
    p = X.points(spark, d).where("id = 7")
    return p.join(X.favorites(spark, d), "id", "left").select("id", "path", "collection", F.col("favorited_at").isNotNull().alias("is_favorite"))


@query("images_with_flags", sql("SELECT p.id, p.collection, f.id IS NOT NULL AS is_favorite, x.id IS NOT NULL AS is_disliked FROM points p LEFT JOIN favorites f USING (id) LEFT JOIN dislikes x ON x.id = p.id"))
def images_with_flags(spark, d):
    from quern.operators.search import with_flags

    return with_flags(X.vectors(spark, d).select("id", "collection"), X.favorites(spark, d), X.dislikes(spark, d))


@query("dislike_subset", sql("SELECT id FROM dislikes WHERE id BETWEEN 10 AND 60"))
def dislike_subset(spark, d):
    wanted = spark.range(10, 61)
    return X.dislikes(spark, d).join(wanted, "id", "left_semi").select("id")


@query("pick_unseen", sql(f"SELECT id, {seeded()} AS h FROM points WHERE id NOT IN (SELECT id FROM favorites) ORDER BY h, id LIMIT 2"))
def pick_unseen(spark, d):
    v = X.vectors(spark, d).select("id").join(X.favorites(spark, d), "id", "left_anti")
    return _seeded(v).orderBy("h", "id").limit(2)


def _seeded(df):
    return df.select("id", F.md5(F.concat(F.lit("seed:"), F.col("id").cast("string")).cast("binary")).alias("h"))


@query("pick_random", sql(f"SELECT id, {seeded()} AS h FROM points ORDER BY h, id LIMIT 20"))
def pick_random(spark, d):
    return _seeded(X.vectors(spark, d)).orderBy("h", "id").limit(20)


@query("random_rows", sql(f"SELECT id, {seeded()} AS h FROM points WHERE collection IN ('lib1', 'lib2') ORDER BY h, id LIMIT 30"))
def random_rows(spark, d):
    return _seeded(X.vectors(spark, d).where("collection in ('lib1', 'lib2')")).orderBy("h", "id").limit(30)


@query("scroll_dedupe", sql(f", first AS (SELECT id FROM points ORDER BY {seeded()}, id LIMIT 50) SELECT id FROM points WHERE id NOT IN (SELECT id FROM first)"))
def scroll_dedupe(spark, d):
    v = X.vectors(spark, d).select("id")
    return v.join(_seeded(v).orderBy("h", "id").limit(50).select("id"), "id", "left_anti")


@query("list_liked_ordered", sql(", picks AS (SELECT 0 AS pos, 9 AS id UNION ALL SELECT 1, 999999 UNION ALL SELECT 2, 4 UNION ALL SELECT 3, 30) SELECT CAST(pos AS BIGINT) AS pos, p.id, p.path FROM picks JOIN points p USING (id) ORDER BY pos"))
def list_liked_ordered(spark, d):
    picks = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (9, 999999, 4, 30)])).alias("pos", "id"))
    return F.broadcast(picks).join(X.points(spark, d), "id").select(F.col("pos").cast("long").alias("pos"), "id", "path").orderBy("pos")


@query("count_images", sql("SELECT count(*) AS n FROM points"))
def count_images(spark, d):
    return X.vectors(spark, d).agg(F.count("*").alias("n"))


@query("count_favorites", sql("SELECT count(*) AS n FROM points JOIN favorites USING (id)"))
def count_favorites(spark, d):
    return X.vectors(spark, d).join(X.favorites(spark, d), "id", "left_semi").agg(F.count("*").alias("n"))


@query("count_dislikes", sql("SELECT count(*) AS n FROM points JOIN dislikes USING (id)"))
def count_dislikes(spark, d):
    return X.vectors(spark, d).join(X.dislikes(spark, d), "id", "left_semi").agg(F.count("*").alias("n"))


@query("count_album_members", sql("SELECT album_id, count(*) AS n FROM members m JOIN points p ON p.id = m.photo_id GROUP BY album_id"))
def count_album_members(spark, d):
    m = X.members(spark, d)
    return m.join(X.vectors(spark, d).select(F.col("id").alias("photo_id")), "photo_id", "left_semi").groupBy("album_id").agg(F.count("*").alias("n"))


@query("list_albums", sql("SELECT a.album_id, a.name, (SELECT count(*) FROM members m WHERE m.album_id = a.album_id) AS member_count, coalesce((SELECT CAST(arg_min(m.photo_id, {'t': m.added_at, 'p': m.photo_id}) AS VARCHAR) FROM members m WHERE m.album_id = a.album_id), '') AS first_member_id FROM albums a"))
def list_albums(spark, d):
    return O.album_list(X.albums(spark, d), X.members(spark, d))


@query("feedback_counts", sql("SELECT count(*) FILTER (WHERE kind = 'like') AS likes, count(*) FILTER (WHERE kind = 'dislike') AS dislikes FROM feedback"))
def feedback_counts(spark, d):
    return X.feedback(spark, d).agg(F.count_if(F.col("kind") == "like").alias("likes"), F.count_if(F.col("kind") == "dislike").alias("dislikes"))


@query("latest_feedback", sql(f"SELECT max({Q}) AS latest FROM feedback"))
def latest_feedback(spark, d):
    return X.feedback(spark, d).agg(F.max("at").alias("latest"))


@query("id_bounds", sql("SELECT min(id) AS low, max(id) AS high FROM points"))
def id_bounds(spark, d):
    return X.vectors(spark, d).agg(F.min("id").alias("low"), F.max("id").alias("high"))


@query("cache_drift", sql("SELECT (SELECT count(*) FROM points) - (SELECT count(*) FROM indexed) AS drift"))
def cache_drift(spark, d):
    a, b = X.vectors(spark, d).agg(F.count("*").alias("a")), X.indexed(spark, d).agg(F.count("*").alias("b"))
    return a.crossJoin(b).select((F.col("a") - F.col("b")).alias("drift"))


@query("set_excluded_union", sql("SELECT id FROM favorites UNION SELECT id FROM dislikes"))
def set_excluded_union(spark, d):
    return X.favorites(spark, d).select("id").union(X.dislikes(spark, d).select("id")).distinct()


@query("set_allowed_intersect", sql("SELECT id FROM points WHERE collection <> 'lib0' INTERSECT SELECT id FROM favorites"))
def set_allowed_intersect(spark, d):
    return X.vectors(spark, d).where("collection <> 'lib0'").select("id").intersect(X.favorites(spark, d).select("id"))


@query("set_new_files", sql("SELECT path FROM disk EXCEPT SELECT path FROM indexed"))
def set_new_files(spark, d):
    return X.disk(spark, d).select("path").subtract(X.indexed(spark, d).select("path"))


LOG = f""", log AS (SELECT photo_id AS id, {Q}, kind = 'like' AS mark FROM feedback), last AS (SELECT id, arg_max({{'t': {Q}, 'm': mark}}, {{'t': {Q}, 'm': mark}}) AS r FROM log GROUP BY id)"""


@query("favorites_fold", sql(LOG + f" SELECT id, r.t AS {Q} FROM last WHERE r.m AND id IN (SELECT id FROM points)"))
def favorites_fold(spark, d):
    log = X.feedback(spark, d).select(F.col("photo_id").alias("id"), "at", (F.col("kind") == "like").alias("mark"))
    return O.marked(log, images=X.vectors(spark, d))


@query("dislikes_fold", sql(LOG.replace("kind = 'like'", "kind = 'dislike'") + f" SELECT id, r.t AS {Q} FROM last WHERE r.m"))
def dislikes_fold(spark, d):
    return O.marked(X.feedback(spark, d).select(F.col("photo_id").alias("id"), "at", (F.col("kind") == "dislike").alias("mark")))


@query("feedback_append", sql(f"SELECT event_id, photo_id, kind, {Q} FROM feedback UNION ALL SELECT -1, 5, 'like', TIMESTAMP '2024-01-01 00:00:00'"))
def feedback_append(spark, d):
    new = spark.sql("SELECT -1L AS event_id, 5L AS photo_id, 'like' AS kind, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS at")
    return X.feedback(spark, d).unionByName(new)


MEMBER_LOG = f", log AS (SELECT user_id AS album_id, CAST(props->>'$.k' AS BIGINT) AS photo_id, ts AS {Q}, event_type = 'view' AS added FROM events WHERE event_type IN ('view', 'error'))"


@query("membership_fold", sql(MEMBER_LOG + f", gone AS (SELECT album_id, photo_id, max({Q}) FILTER (WHERE NOT added) AS g FROM log GROUP BY 1, 2) SELECT l.album_id, l.photo_id, min(l.{Q}) AS added_at FROM log l JOIN gone g ON g.album_id = l.album_id AND g.photo_id = l.photo_id WHERE added AND (g.g IS NULL OR l.{Q} > g.g) GROUP BY 1, 2"))
def membership_fold(spark, d):
    e = X.table(spark, d, "events").where("event_type in ('view', 'error')")
    return O.memberships(e.select(F.col("user_id").alias("album_id"), F.get_json_object("props", "$.k").cast("long").alias("photo_id"), F.col("ts").alias("at"), (F.col("event_type") == "view").alias("added")))


ALBUM_LOG = f""", elog AS (SELECT user_id AS owner, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, ts AS {Q},
  CASE event_type WHEN 'view' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'cover' ELSE 'rename' END AS kind, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
alog AS (SELECT owner, n, {Q}, kind, k % 7 AS album_id, CASE WHEN k % 10 = 9 THEN '' ELSE 'n' || (k % 10) END AS name, CASE WHEN k % 3 = 0 THEN 'd' || k END AS description, 'p' || k AS cover FROM elog)"""

ALBUM_FOLD = ALBUM_LOG + f""", st AS (
  SELECT DISTINCT owner, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(album_id BIGINT, name VARCHAR, description VARCHAR, cover VARCHAR, created_at TIMESTAMP, updated_at TIMESTAMP)[]) AS a FROM alog
  UNION ALL
  SELECT s.owner, l.n, CASE
    WHEN l.kind = 'delete' THEN list_filter(s.a, lambda x: x.album_id <> l.album_id)
    WHEN l.kind = 'cover' THEN list_transform(s.a, lambda x: CASE WHEN x.album_id = l.album_id THEN struct_pack(album_id := x.album_id, name := x.name, description := x.description, cover := l.cover, created_at := x.created_at, updated_at := l.{Q}) ELSE x END)
    WHEN l.name = '' OR len(list_filter(s.a, lambda x: x.album_id <> l.album_id AND x.name = l.name)) > 0 THEN s.a
    WHEN l.kind = 'rename' THEN list_transform(s.a, lambda x: CASE WHEN x.album_id = l.album_id THEN struct_pack(album_id := x.album_id, name := l.name, description := coalesce(l.description, x.description), cover := x.cover, created_at := x.created_at, updated_at := l.{Q}) ELSE x END)
    WHEN len(list_filter(s.a, lambda x: x.album_id = l.album_id)) > 0 THEN s.a
    ELSE list_append(s.a, struct_pack(album_id := l.album_id, name := l.name, description := coalesce(l.description, ''), cover := '', created_at := l.{Q}, updated_at := l.{Q})) END
  FROM st s JOIN alog l ON l.owner = s.owner AND l.n = s.n + 1
), done AS (SELECT owner, unnest(arg_max(a, n)) AS x FROM st GROUP BY owner)
SELECT owner, x.album_id AS album_id, x.name AS name, x.description AS description, x.cover AS cover, x.created_at AS created_at, x.updated_at AS updated_at FROM done"""


def _library_log(spark, d):
    """Events as a person's log over a few albums and searches, with names that collide."""
    k = F.get_json_object("props", "$.k").cast("long")
    return X.table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), "event_type", k.alias("k"))


@query("album_crud_fold", sql(ALBUM_FOLD))
def album_crud_fold(spark, d):
    e, k = _library_log(spark, d), F.col("k")
    kind = F.when(F.col("event_type") == "view", "create").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "cover").otherwise("rename")
    name = F.when(k % 10 == 9, "  ").otherwise(F.concat(F.lit(" n"), k % 10, F.lit(" ")))
    return O.live_albums(e.select("owner", "at", "seq", kind.alias("kind"), (k % 7).alias("album_id"), name.alias("name"), F.when(k % 3 == 0, F.concat(F.lit("d"), k)).alias("description"), F.concat(F.lit("p"), k).alias("cover")))


SAVED_FOLD = ALBUM_LOG + f""", slog AS (SELECT owner, n, {Q}, CASE kind WHEN 'delete' THEN 'delete' ELSE 'create' END AS kind, k % 9 AS saved_id, CASE WHEN k % 12 = 11 THEN repeat('x', 81) WHEN k % 12 = 10 THEN '' ELSE 's' || (k % 12) END AS name, CASE WHEN k % 5 = 0 THEN '' ELSE 'cat ' || k END AS p, CASE WHEN k % 4 = 0 THEN 'dog' ELSE '' END AS m FROM elog),
st AS (
  SELECT DISTINCT owner, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(saved_id BIGINT, name VARCHAR, positives VARCHAR, negatives VARCHAR, created_at TIMESTAMP)[]) AS a FROM slog
  UNION ALL
  SELECT s.owner, l.n, CASE
    WHEN l.kind = 'delete' THEN list_filter(s.a, lambda x: x.saved_id <> l.saved_id)
    WHEN length(l.name) NOT BETWEEN 1 AND 80 OR (l.p = '' AND l.m = '') OR len(list_filter(s.a, lambda x: x.saved_id = l.saved_id OR x.name = l.name)) > 0 THEN s.a
    ELSE list_append(s.a, struct_pack(saved_id := l.saved_id, name := l.name, positives := l.p, negatives := l.m, created_at := l.{Q})) END
  FROM st s JOIN slog l ON l.owner = s.owner AND l.n = s.n + 1
), done AS (SELECT owner, unnest(arg_max(a, n)) AS x FROM st GROUP BY owner)
SELECT owner, x.saved_id AS saved_id, x.name AS name, x.positives AS positives, x.negatives AS negatives, x.created_at AS created_at FROM done"""


@query("saved_search_fold", sql(SAVED_FOLD))
def saved_search_fold(spark, d):
    e, k = _library_log(spark, d), F.col("k")
    name = F.when(k % 12 == 11, F.repeat(F.lit("x"), F.lit(81))).when(k % 12 == 10, " ").otherwise(F.concat(F.lit("s"), k % 12, F.lit(" ")))
    positives = F.array(F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" cat "), k)), F.lit(None).cast("string"))
    log = e.select("owner", "at", "seq", F.when(F.col("event_type") == "error", "delete").otherwise("create").alias("kind"), (k % 9).alias("saved_id"), name.alias("name"), positives.alias("positives"), F.array(F.when(k % 4 == 0, "dog ").otherwise("")).alias("negatives"))
    return O.live_searches(log).select("owner", "saved_id", "name", F.array_join("positives", "|").alias("positives"), F.array_join("negatives", "|").alias("negatives"), "created_at")


@query("count_saved_searches", f"SELECT owner, count(*) AS n FROM ({sql(SAVED_FOLD)}) GROUP BY owner")
def count_saved_searches(spark, d):
    return saved_search_fold(spark, d).groupBy("owner").agg(F.count("*").alias("n"))


RESET = f", r AS (SELECT user_id, max(ts) AS reset FROM events WHERE event_type = 'error' AND CAST(props->>'$.k' AS BIGINT) % 5 = 0 GROUP BY 1)"


@query("feedback_reset", sql(RESET + " SELECT e.event_id, e.user_id FROM events e LEFT JOIN r USING (user_id) WHERE e.event_type IN ('purchase', 'error') AND (reset IS NULL OR e.ts > reset)"))
def feedback_reset(spark, d):
    """Feedback that is left after each person's last reset."""
    e = X.table(spark, d, "events").withColumn("at", F.col("ts"))
    resets = e.where((F.col("event_type") == "error") & (F.get_json_object("props", "$.k").cast("long") % 5 == 0)).select("user_id", "at")
    return O.after_reset(e.where("event_type in ('purchase', 'error')").select("event_id", "user_id", "at"), resets, "user_id").select("event_id", "user_id")


@query("saved_search_json", sql(""", raw AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '["cat","' || event_type || '"]' WHEN 1 THEN '[]' ELSE '{oops' END AS t FROM events),
p AS (SELECT event_id, CASE WHEN json_valid(t) THEN CAST(TRY_CAST(t AS JSON) AS VARCHAR[]) ELSE [] END AS p FROM raw) SELECT event_id, len(p) AS n, array_to_string(p, '|') AS joined FROM p"""))
def saved_search_json(spark, d):
    e = X.table(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["cat","'), "event_type", F.lit('"]'))).when(F.col("event_id") % 3 == 1, "[]").otherwise("{oops")
    p = e.select("event_id", text.alias("t")).select("event_id", O.saved_prompts("t").alias("p"))
    return p.select("event_id", F.size("p").cast("long").alias("n"), F.array_join("p", "|").alias("joined"))


UPSERTED = sql(", u AS (SELECT id, 'moved/' || path AS path, size, 2 AS version FROM points WHERE collection = 'lib4' UNION ALL SELECT id + 1000000, path, size, 2 FROM points WHERE collection = 'lib5'), a AS (SELECT id, path, size, 1 AS version FROM points UNION ALL SELECT * FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS n FROM a) SELECT id, path, size, CAST(version AS BIGINT) AS version FROM r WHERE n = 1")


@query("upsert_fold", UPSERTED)
def upsert_fold(spark, d):
    p = X.points(spark, d)
    base = p.select("id", "path", "size", F.lit(1).cast("long").alias("version"))
    moved = p.where("collection = 'lib4'").select("id", F.concat(F.lit("moved/"), "path").alias("path"), "size", F.lit(2).cast("long").alias("version"))
    added = p.where("collection = 'lib5'").select((F.col("id") + 1000000).alias("id"), "path", "size", F.lit(2).cast("long").alias("version"))
    return O.upsert(base, moved.union(added), ["id"], "version")


@query("upsert_batches", UPSERTED)
def upsert_batches(spark, d):
    """The same points in three micro-batches, the second of which is run twice."""
    p = X.points(spark, d)
    row = lambda some, id, path, version: some.select(id.alias("id"), path.alias("path"), "size", F.lit(version).cast("long").alias("version"))
    table = point_table(spark, scratch_path(spark, "points"), "id long, path string, size long, version long")
    moved = row(p.where("collection = 'lib4'"), F.col("id"), F.concat(F.lit("moved/"), "path"), 2)
    added = row(p.where("collection = 'lib5'"), F.col("id") + 1000000, F.col("path"), 2)
    for number, batch in enumerate([moved, row(p.where("id % 2 = 0"), F.col("id"), F.col("path"), 1).union(added), row(p.where("id % 2 <> 0"), F.col("id"), F.col("path"), 1)]):
        table.fold(batch, number)
        if number == 1:
            table.fold(batch, number)
    return table.read()


@query("payload_patch", sql("SELECT id, CASE WHEN collection IN ('lib1', 'lib2') THEN 'src-' || collection ELSE shard END AS shard FROM points"))
def payload_patch(spark, d):
    p = X.points(spark, d).select("id", "shard", "collection")
    new = p.where("collection in ('lib1', 'lib2')").select("id", F.concat(F.lit("src-"), "collection").alias("shard"))
    return O.patched(p, new, "id", ["shard"]).select("id", "shard")


@query("schema_evolution", sql("SELECT id, path, NULL::BIGINT AS width FROM points WHERE collection = 'lib1' UNION ALL SELECT id, path, size AS width FROM indexed"))
def schema_evolution(spark, d):
    old = X.points(spark, d).where("collection = 'lib1'").select("id", "path")
    return old.unionByName(X.indexed(spark, d).select("id", "path", F.col("size").alias("width")), allowMissingColumns=True)


@query("feedback_window_counts", sql(f"SELECT date_trunc('hour', {Q}) AS hour, kind, count(*) AS n FROM feedback GROUP BY 1, 2"))
def feedback_window_counts(spark, d):
    from quern.streaming.feedback import window_counts

    return window_counts(X.feedback(spark, d), "1 hour").select(F.col("start").alias("hour"), "kind", "n")


@query("meta_singleton", sql(f"SELECT 'sync' AS id, count(*) AS pending, max({Q}) AS last FROM feedback WHERE kind = 'dislike'"))
def meta_singleton(spark, d):
    return X.feedback(spark, d).where("kind = 'dislike'").agg(F.count("*").alias("pending"), F.max("at").alias("last")).select(F.lit("sync").alias("id"), "pending", "last")
