"""Queries that are answered from indexes, which they build from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import fixtures as X
from quern.operators import search as S, textfilter as T
from quern.operators.pages import Cursor, Pages, shuffled
from quern.operators.tokenindex import TokenIndex
from quern.operators.vectorindex import VectorIndex
from quern.plans.ingestion import TOK, _paths
from quern.plans.registry import query
from quern.plans.retrieval import near, out, sql
from quern.scratch import scratch_path


def _index(spark, points) -> VectorIndex:
    return VectorIndex.build(points, scratch_path(spark, "vector-index"))


def _vector(points, id):
    return S.one_vector(S.vector_of(points, id))


@query("index_topk", near(7))
def index_topk(spark, d):
    """The best of all points, through the index."""
    v = X.vectors(spark, d)
    return out(_index(spark, v).search(_vector(v, 7), 10).rows)


@query("index_filtered", near(7, "p.collection IN ('lib1', 'lib3') AND p.id NOT IN (SELECT id FROM dislikes)", tail="LIMIT 20 OFFSET 10"))
def index_filtered(spark, d):
    """A page among two collections without disliked points; cells without points of the two are not opened."""
    v = X.vectors(spark, d)
    return out(_index(spark, v).search(_vector(v, 7), S.Page(20, 10), ["lib1", "lib3"], excluded=X.dislikes(spark, d)).rows)


@query("index_append", near(12, tail="LIMIT 25"))
def index_append(spark, d):
    """Points of which a third came after the index was built."""
    v = X.vectors(spark, d)
    index = _index(spark, v.where("id % 3 <> 0"))
    index.append(v.where("id % 3 = 0"))
    return out(index.search(_vector(v, 12), 25).rows)


@query("index_facet", sql("SELECT collection, count(*) AS n FROM points WHERE collection <> '' GROUP BY collection"))
def index_facet(spark, d):
    """Points of each collection from the index's table of cells."""
    return _index(spark, X.vectors(spark, d)).facet().select("collection", F.col("n").cast("long").alias("n"))


def _tokens(spark, d) -> TokenIndex:
    """The index after three batches: wrong paths for all and an id too many, then right ones for half of them, then the rest and a deletion."""
    index, paths = TokenIndex(spark, scratch_path(spark, "token-index")), _paths(spark, d).select("id", "path")
    extra = spark.createDataFrame([(-1, "/gone/m.jpg")], "id long, path string")
    index.apply(paths.withColumn("path", F.concat(F.lit("/old/m/"), "id")).union(extra), 0)
    index.apply(paths.where("id % 2 = 0"), 1)
    index.apply(paths.where("id % 2 <> 0").union(extra.withColumn("path", F.lit(None).cast("string"))), 2)
    return index


@query("index_token_match", sql(TOK + " SELECT id FROM t WHERE list_contains(tokens, 'm')"))
def index_token_match(spark, d):
    return _tokens(spark, d).matches(T.Pattern.parse("M"))


@query("index_token_prefix", sql(TOK + " SELECT id FROM t WHERE len(list_filter(tokens, lambda x: starts_with(x, 'thth'))) > 0"))
def index_token_prefix(spark, d):
    return _tokens(spark, d).matches(T.Pattern.parse("thth*"))


@query("index_filename_guard", sql(TOK + ", c AS (SELECT avg(CASE WHEN list_contains(tokens, 'en') THEN 1.0 ELSE 0.0 END) AS share FROM t) SELECT id FROM t, c WHERE list_contains(tokens, 'en') OR share > 0.5"))
def index_filename_guard(spark, d):
    return _tokens(spark, d).guarded(T.Pattern.parse("en"))


def _pages(spark, key) -> Pages:
    return Pages(spark, scratch_path(spark, "pages"), "id long, collection string", key, "collection", part_rows=4096)


@query("scan_cursor", sql(""", wanted AS (SELECT id FROM points WHERE collection IN ('lib1', 'lib3')), p1 AS (SELECT id FROM wanted WHERE id % 3 <> 0 ORDER BY id LIMIT 25),
p2 AS (SELECT id FROM wanted WHERE id > (SELECT max(id) FROM p1) ORDER BY id LIMIT 25) SELECT 1 AS page, id FROM p1 UNION ALL SELECT 2, id FROM p2"""))
def scan_cursor(spark, d):
    """Two pages of two collections by id; a third of the points comes between them."""
    v, pages = X.vectors(spark, d).select("id", "collection"), _pages(spark, F.col("id"))
    pages.append(v.where("id % 3 <> 0"), 0)
    first = pages.page(25, groups=["lib1", "lib3"])
    pages.append(v.where("id % 3 = 0"), 1)
    second = pages.page(25, first.after, ["lib1", "lib3"]).rows
    return first.rows.select(F.lit(1).alias("page"), "id").union(second.select(F.lit(2), "id"))


@query("shuffled_page", sql(""", keyed AS (SELECT id, collection, CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 15) AS BIGINT) AS key FROM points), start AS (SELECT key FROM keyed WHERE id = 7)
SELECT id FROM keyed WHERE collection IN ('lib1', 'lib2') ORDER BY key <= (SELECT key FROM start), key, id LIMIT 40"""))
def shuffled_page(spark, d):
    """A page of two collections in shuffled order, from the place of a point on and around the end."""
    v, pages = X.vectors(spark, d).select("id", "collection"), _pages(spark, shuffled())
    pages.append(v, 0)
    place = v.where("id = 7").select(shuffled()).first()
    return pages.around(40, Cursor(place[0], 7), ["lib1", "lib2"]).rows.select("id")
