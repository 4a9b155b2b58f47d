"""Queries of vector retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern import fixtures as X
from quern.operators import search as S
from quern.plans.registry import query
from quern.scratch import scratch_path
from quern.streaming.centroids import KeptCentroids

COS = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"


def sql(text: str) -> str:
    return X.SQL + text


def near(source: int, where: str = "TRUE", columns: str = "p.id, round(score, 6) AS score", tail: str = "LIMIT 10", frm: str = "points") -> str:
    score = COS.format(a="p.vector", b="q.vector")
    return sql(f", scored AS (SELECT p.*, {score} AS score FROM {frm} p, points q WHERE q.id = {source}) SELECT {columns} FROM scored p WHERE {where} ORDER BY p.score DESC, p.id {tail}")


def out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), *more)


@query("scan_points", sql("SELECT id, collection, shard, path, size FROM points"))
def scan_points(spark: SparkSession, d: str) -> DataFrame:
    return X.points(spark, d).select("id", "collection", "shard", "path", "size")


@query("retrieve_batch", sql("SELECT id, collection, path FROM points WHERE id IN (3, 7, 11, 999999)"))
def retrieve_batch(spark, d):
    return X.points(spark, d).where(F.col("id").isin(3, 7, 11, 999999)).select("id", "collection", "path")


@query("filter_collection", sql("SELECT id, collection FROM points WHERE collection IN ('lib1', 'lib3')"))
def filter_collection(spark, d):
    return S.filtered(X.vectors(spark, d), ["lib1", "lib3"]).select("id", "collection")


@query("filter_allowed_ids", sql("SELECT id FROM points WHERE id IN (SELECT id FROM favorites) AND collection <> 'lib0'"))
def filter_allowed_ids(spark, d):
    return S.filtered(X.vectors(spark, d), allowed=X.favorites(spark, d)).where("collection <> 'lib0'").select("id")


@query("filter_exclude_ids", sql("SELECT id FROM points WHERE id NOT IN (SELECT id FROM dislikes WHERE id IS NOT NULL)"))
def filter_exclude_ids(spark, d):
    return S.filtered(X.vectors(spark, d), excluded=X.dislikes(spark, d)).select("id")


@query("knn_topk", near(7))
def knn_topk(spark, d):
    v = X.vectors(spark, d)
    return out(S.top(S.against(v, S.vector_of(v, 7)), 10))


@query("knn_filtered", near(7, "p.collection IN ('lib1', 'lib2') AND p.id NOT IN (SELECT id FROM dislikes)"))
def knn_filtered(spark, d):
    v = X.vectors(spark, d)
    return out(S.top(S.against(S.filtered(v, ["lib1", "lib2"], excluded=X.dislikes(spark, d)), S.vector_of(v, 7)), 10))


@query("knn_page", near(7, tail="LIMIT 20 OFFSET 30"))
def knn_page(spark, d):
    v = X.vectors(spark, d)
    return out(S.top(S.against(v, S.vector_of(v, 7)), S.Page(20, 30)))


@query("topk_capped", sql(", many AS (SELECT p.id * 16 + r.r AS id, p.vector FROM points p, range(16) r(r))" + f", scored AS (SELECT p.id, {COS.format(a='p.vector', b='q.vector')} AS score FROM many p, points q WHERE q.id = 7) SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 100 OFFSET 4900"))
def topk_capped(spark, d):
    """A page that the limit on all rows cuts from 200 to 100, over every point in sixteen copies."""
    v = X.vectors(spark, d)
    many = v.select("vector", F.explode(F.sequence(F.col("id") * 16, F.col("id") * 16 + 15)).alias("id"))
    return out(S.top(S.against(many, S.vector_of(v, 7)), S.Page(200, 4900)))


@query("page_has_more", sql("SELECT count(*) > 40 AS has_more, least(count(*), 40) AS n FROM points"))
def page_has_more(spark, d):
    return X.vectors(spark, d).limit(41).agg((F.count("*") > 40).alias("has_more"), F.least(F.count("*"), F.lit(40).cast("long")).alias("n"))


@query("knn_with_vectors", near(7, columns="p.id, round(score, 6) AS score, round(p.vector[1], 6) AS first, CAST(len(p.vector) AS BIGINT) AS dim"))
def knn_with_vectors(spark, d):
    v = X.vectors(spark, d)
    t = S.top(S.against(v, S.vector_of(v, 7)), 10)
    return t.select("id", F.round("score", 6).alias("score"), F.round(F.col("vector")[0], 6).alias("first"), F.size("vector").cast("long").alias("dim"))


@query("similar_to_id", near(12, "p.id <> 12", tail="LIMIT 25"))
def similar_to_id(spark, d):
    return out(S.top(S.similar_to(X.vectors(spark, d), 12), 25))


@query("search_page", near(7, "p.collection = 'lib1'", columns="p.id, round(score, 6) AS score", tail="LIMIT 30 OFFSET 20").replace("SELECT p.id, round", "SELECT *, count(*) OVER () >= 30 AS has_more FROM (SELECT p.id, round") + ")")
def search_page(spark, d):
    """A page says that there may be more if it is full."""
    v = X.vectors(spark, d)
    return out(S.page(S.against(S.filtered(v, ["lib1"]), S.vector_of(v, 7)), S.Page(30, 20)), "has_more")


@query("similar_page", near(12, "p.id <> 12", columns="p.id, round(score, 6) AS score", tail="LIMIT 26").replace("SELECT p.id, round", "SELECT id, score, n > 25 AS has_more FROM (SELECT *, count(*) OVER () AS n, row_number() OVER () AS i FROM (SELECT p.id, round") + ")) WHERE i <= 25")
def similar_page(spark, d):
    return out(S.page(S.similar_to(X.vectors(spark, d), 12), S.Page(25), "next"), "has_more")


TARGET = """, pos AS (SELECT p.vector FROM points p JOIN favorites f USING (id)), neg AS (SELECT p.vector FROM points p JOIN dislikes x USING (id)),
pm AS (SELECT i, avg(vector[i]) AS m FROM pos, range(1, 65) r(i) GROUP BY i), nm AS (SELECT i, avg(vector[i]) AS m FROM neg, range(1, 65) r(i) GROUP BY i),
target AS (SELECT list(coalesce(pm.m, 0) - coalesce(nm.m, 0) ORDER BY r.i) AS vector FROM range(1, 65) r(i) LEFT JOIN pm ON pm.i = r.i LEFT JOIN nm ON nm.i = r.i)
"""


@query("recommend_pos_neg", sql(TARGET + f", s AS (SELECT p.id, {COS.format(a='p.vector', b='t.vector')} AS score FROM points p, target t WHERE p.id NOT IN (SELECT id FROM favorites UNION SELECT id FROM dislikes)) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 20"))
def recommend_pos_neg(spark, d):
    return out(S.recommend(X.vectors(spark, d), X.favorites(spark, d), X.dislikes(spark, d), 20))


def centroid_sql(group: str, frm: str) -> str:
    return f""", m AS (SELECT {group} AS g, i, avg(p.vector[i]) AS m FROM {frm}, range(1, 65) r(i) GROUP BY 1, 2),
    c AS (SELECT g, list(m ORDER BY i) AS v FROM m GROUP BY g), n AS (SELECT g, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM c)"""


FLAT = " SELECT g AS {name}, CAST(i - 1 AS BIGINT) AS pos, round(v[i], 6) AS value FROM n, range(1, 65) r(i)"


def flat(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, F.posexplode("centroid").alias("pos", "value")).select(*by, F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("favourites_centroid", sql(centroid_sql("'favourites'", "points p JOIN favorites f USING (id)") + FLAT.format(name="name")))
def favourites_centroid(spark, d):
    liked = X.vectors(spark, d).join(X.favorites(spark, d), "id")
    return flat(S.mean_vectors(liked).withColumn("name", F.lit("favourites")), "name")


@query("album_centroids", sql(centroid_sql("album_id", "points p JOIN members m ON m.photo_id = p.id") + FLAT.format(name="album_id")))
def album_centroids(spark, d):
    m = X.members(spark, d).select("album_id", F.col("photo_id").alias("id"))
    return flat(S.mean_vectors(X.vectors(spark, d).join(m, "id"), ["album_id"]), "album_id")


KEPT = """, log AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'album-' ELSE 'user-' END || user_id AS name, CAST(props->>'$.k' AS BIGINT) AS k, ts, event_type <> 'error' AS live FROM events WHERE event_type IN ('purchase', 'error', 'view')),
emptied AS (SELECT name, max(ts) AS emptied_at FROM log WHERE NOT live AND k % 50 = 0 GROUP BY 1),
pair AS (SELECT name, k, ts, live, row_number() OVER (PARTITION BY name, k ORDER BY ts DESC, live DESC) AS n FROM log WHERE live OR k % 50 <> 0),
inset AS (SELECT p.name, p.k FROM pair p LEFT JOIN emptied e USING (name) WHERE n = 1 AND live AND (emptied_at IS NULL OR ts >= emptied_at) AND k % 17 <> 0)"""


@query("kept_centroids", sql(KEPT + centroid_sql("s.name", "points p JOIN inset s ON s.k = p.id") + FLAT.format(name="name")))
def kept_centroids(spark, d):
    """Centroids of likes and albums kept by micro-batches: late events, points that change their vectors or are deleted, a batch run twice."""
    e = X.table(spark, d, "events").where("event_type in ('purchase', 'error', 'view')")
    k, wrong = F.get_json_object("props", "$.k").cast("long"), F.col("event_type") == "error"
    kind = F.when(~wrong, "add").when(k % 50 == 0, "drop").otherwise("remove")
    name = F.concat(F.when(F.col("event_type") == "view", "album-").otherwise("user-"), "user_id")
    log = e.select(F.col("ts").alias("at"), kind.alias("kind"), name.alias("name"), k.alias("photo_id"), F.lit(None).cast("array<double>").alias("vector"), "event_id")
    vectors = X.vectors(spark, d)

    def point(day, kind, vector, some="true"):
        return vectors.where(some).select(F.lit(day).cast("timestamp_ntz").alias("at"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("name"), F.col("id").alias("photo_id"), vector.alias("vector"))

    kept, half = KeptCentroids(spark, scratch_path(spark, "centroids"), buckets=16), log.where("event_id % 2 = 0").drop("event_id")
    first = half.union(point("2000-01-01", "vector", F.reverse("vector")))
    rest = log.where("event_id % 2 <> 0").drop("event_id").union(point("2000-01-02", "vector", F.col("vector"))).union(point("2000-01-03", "delete", F.lit(None).cast("array<double>"), "id % 17 = 0"))
    for number, batch in enumerate([first, rest]):
        kept.fold(batch, number)
    kept.fold(rest, 1)
    return flat(kept.read().where("centroid is not null"), "name")


@query("label_centroids", sql(centroid_sql("collection", "points p") + FLAT.format(name="collection")))
def label_centroids(spark, d):
    return flat(S.mean_vectors(X.vectors(spark, d), ["collection"]), "collection")


@query("centroid_search", sql(centroid_sql("collection", "points p") + f", s AS (SELECT p.id, {COS.format(a='p.vector', b='n.v')} AS score FROM points p, n WHERE lower(n.g) = 'lib3') SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 15"))
def centroid_search(spark, d):
    v = X.vectors(spark, d)
    c = S.mean_vectors(v, ["collection"]).where(F.lower("collection") == "lib3").select(F.col("centroid").alias("q"))
    return out(S.top(S.against(v, c), 15))


@query("centroid_blend", sql(", w AS (SELECT id, vector, CASE id WHEN 3 THEN 3.0 WHEN 5 THEN 1.0 ELSE 2.0 END AS w FROM points WHERE id IN (3, 5, 9)), m AS (SELECT i, sum(w * vector[i]) AS m FROM w, range(1, 65) r(i) GROUP BY i), c AS (SELECT list(m ORDER BY i) AS v FROM m) SELECT CAST(i - 1 AS BIGINT) AS pos, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS value FROM c, range(1, 65) r(i)"))
def centroid_blend(spark, d):
    w = X.vectors(spark, d).where("id in (3, 5, 9)").withColumn("w", F.when(F.col("id") == 3, 3.0).when(F.col("id") == 5, 1.0).otherwise(2.0))
    return flat(S.mean_vectors(w, weight="w"))


@query("prompt_compose", sql(", m AS (SELECT i, avg(vector[i]) FILTER (WHERE id IN (1, 2)) - avg(vector[i]) FILTER (WHERE id = 4) AS m FROM points, range(1, 65) r(i) WHERE id IN (1, 2, 4) GROUP BY i), c AS (SELECT list(m ORDER BY i) AS v FROM m) SELECT CAST(i - 1 AS BIGINT) AS pos, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS value FROM c, range(1, 65) r(i)"))
def prompt_compose(spark, d):
    v = X.vectors(spark, d)
    q = S.recommend_target(v, v.where("id in (1, 2)"), v.where("id = 4"))
    return flat(q.select(F.col("q").alias("centroid")))


@query("filename_only", sql("SELECT id, 0.0::DOUBLE AS score FROM points WHERE collection = 'lib2' ORDER BY id LIMIT 20"))
def filename_only(spark, d):
    v = S.filtered(X.vectors(spark, d), ["lib2"])
    return out(S.top(S.scored(v, [0.0] * 64), 20))


def seeded(c: str = "id") -> str:
    return f"md5('seed:' || {c})"


@query("surprise_sample", near(7, columns="p.id, md5('seed:' || p.id) AS h", tail="LIMIT 5000").replace("SELECT p.id, md5", "SELECT * FROM (SELECT p.id, md5") + ") ORDER BY h, id LIMIT 28")
def surprise_sample(spark, d):
    """The best are shuffled: by a hash of a seed and the id, so that a page can be repeated."""
    v = X.vectors(spark, d)
    best = S.best(S.against(v, S.vector_of(v, 7)), S.MOST_ROWS)
    return best.select("id", F.md5(F.concat(F.lit("seed:"), F.col("id").cast("string")).cast("binary")).alias("h")).orderBy("h", "id").limit(28)


@query("knn_favorites_pre", near(7, "p.id IN (SELECT id FROM favorites)"))
def knn_favorites_pre(spark, d):
    v = X.vectors(spark, d)
    return out(S.top(S.against(S.filtered(v, allowed=X.favorites(spark, d)), S.vector_of(v, 7)), 10))


@query("knn_favorites_post", near(7, columns="p.id, p.score", tail="LIMIT 5000").replace("SELECT p.id, p.score FROM", "SELECT id, round(score, 6) AS score, n > 15 AS has_more FROM (SELECT t.id, t.score, count(*) OVER () AS n, row_number() OVER (ORDER BY t.score DESC, t.id) AS i FROM (SELECT p.id, p.score FROM") + ") t JOIN favorites f ON f.id = t.id) WHERE i BETWEEN 6 AND 15")
def knn_favorites_post(spark, d):
    """A page of the likes among the best rows; there is more if likes are left behind it."""
    v = X.vectors(spark, d)
    best = S.best(S.against(v, S.vector_of(v, 7)), S.MOST_ROWS)
    return out(S.page(best.join(X.favorites(spark, d).select("id"), "id", "left_semi"), S.Page(10, 5), "next"), "has_more")


@query("result_projection", near(7, columns="p.id, format('{:.3f}', p.score) AS score_str, '/photo/' || p.id || '/raw' AS url, p.id IN (SELECT id FROM favorites) AS is_favorite, p.id IN (SELECT id FROM dislikes) AS is_disliked, p.collection"))
def result_projection(spark, d):
    v = X.vectors(spark, d)
    t = S.with_flags(S.top(S.against(v, S.vector_of(v, 7)), 10), X.favorites(spark, d), X.dislikes(spark, d))
    return t.select("id", F.format_string("%.3f", "score").alias("score_str"), F.concat(F.lit("/photo/"), "id", F.lit("/raw")).alias("url"), "is_favorite", "is_disliked", "collection")


@query("facet_collections", sql("SELECT collection, count(*) AS n FROM points WHERE coalesce(collection, '') <> '' GROUP BY collection ORDER BY collection LIMIT 100"))
def facet_collections(spark, d):
    return X.vectors(spark, d).where(F.coalesce("collection", F.lit("")) != "").groupBy("collection").agg(F.count("*").alias("n")).orderBy("collection").limit(100)


SEEDS = ", seeds AS (SELECT p.id, p.vector FROM points p JOIN favorites f USING (id))"
THR = SEEDS + f", thr AS (SELECT coalesce(quantile_disc(1 - {COS.format(a='a.vector', b='b.vector')}, 0.01), 0) AS t FROM seeds a JOIN seeds b ON a.id < b.id)"


@query("near_dup_threshold", sql(THR + " SELECT round(t, 6) AS threshold FROM thr"))
def near_dup_threshold(spark, d):
    seeds = X.vectors(spark, d).join(X.favorites(spark, d), "id", "left_semi")
    return S.near_dup_threshold(seeds).select(F.round("threshold", 6).alias("threshold"))


KEEP = f", m AS (SELECT p.id, max({COS.format(a='p.vector', b='s.vector')}) AS most FROM points p, seeds s WHERE p.id NOT IN (SELECT id FROM seeds) GROUP BY p.id), kept AS (SELECT m.id FROM m, thr WHERE 1 - m.most + 1e-9 >= thr.t)"


@query("near_dup_filter", sql(THR + KEEP + " SELECT id FROM kept"))
def near_dup_filter(spark, d):
    v, liked = X.vectors(spark, d), X.favorites(spark, d)
    seeds = v.join(liked, "id", "left_semi")
    return S.near_dup_filter(S.filtered(v, excluded=liked), seeds, S.near_dup_threshold(seeds)).select("id")


@query("centroid_search_dedup", sql(THR + ", m2 AS (SELECT i, avg(vector[i]) AS m FROM seeds, range(1, 65) r(i) GROUP BY i), c AS (SELECT list(m ORDER BY i) AS v FROM m2)" + f""", f AS (SELECT p.id, p.vector, {COS.format(a='p.vector', b='c.v')} AS score FROM points p, c WHERE p.id NOT IN (SELECT id FROM seeds) ORDER BY score DESC, p.id LIMIT 60),
k AS (SELECT f.id, f.score, max({COS.format(a='f.vector', b='s.vector')}) AS most FROM f, seeds s GROUP BY 1, 2), kept AS (SELECT id, score FROM k, thr WHERE 1 - most + 1e-9 >= thr.t)
SELECT id, round(score, 6) AS score, (SELECT count(*) FROM kept) < (SELECT count(*) FROM f) OR (SELECT count(*) FROM kept) >= 20 AS has_more FROM kept ORDER BY kept.score DESC, id LIMIT 20"""))
def centroid_search_dedup(spark, d):
    v = X.vectors(spark, d)
    seeds = v.join(X.favorites(spark, d), "id", "left_semi")
    return out(S.search_without_copies(v, seeds, 20), "has_more")


@query("for_you_state", sql("SELECT (SELECT count(*) FROM points JOIN favorites USING (id)) AS likes, (SELECT count(*) FROM points JOIN dislikes USING (id)) AS dislikes, (SELECT max(f.at) FROM feedback f) AS freshest, (SELECT count(*) FROM (SELECT id FROM favorites UNION SELECT id FROM dislikes)) AS excluded"))
def for_you_state(spark, d):
    v, f, x = X.vectors(spark, d).select("id"), X.favorites(spark, d), X.dislikes(spark, d)
    return (
        v.join(f, "id").agg(F.count("*").alias("likes"))
        .crossJoin(v.join(x, "id").agg(F.count("*").alias("dislikes")))
        .crossJoin(X.feedback(spark, d).agg(F.max("at").alias("freshest")))
        .crossJoin(f.select("id").union(x.select("id")).distinct().agg(F.count("*").alias("excluded")))
    )


@query("centroid_load_guard", sql(", raw AS (SELECT id AS source, CASE WHEN id % 10 = 0 THEN ' ' ELSE 'c' || (id % 17) END AS name, CASE WHEN id % 4 = 0 THEN 'other' ELSE 'model' END AS model, CASE WHEN id % 6 = 0 THEN 32 ELSE len(vector) END AS feature_dim, len(vector) AS dim FROM points), ok AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source) AS r FROM raw WHERE trim(name) <> '' AND model = 'model' AND feature_dim = 64 AND dim = 64) SELECT name, source FROM ok WHERE r = 1"))
def centroid_load_guard(spark, d):
    from quern.sources.centroids import usable_centroids

    v = X.vectors(spark, d)
    raw = v.select(
        F.col("id").alias("source"),
        F.when(F.col("id") % 10 == 0, " ").otherwise(F.concat(F.lit("c"), F.col("id") % 17)).alias("name"),
        F.when(F.col("id") % 4 == 0, "other").otherwise("model").alias("model"),
        F.when(F.col("id") % 6 == 0, 32).otherwise(F.size("vector")).alias("feature_dim"),
        F.col("vector").alias("centroid"),
    )
    return usable_centroids(raw, "model", 64).select("name", "source")
