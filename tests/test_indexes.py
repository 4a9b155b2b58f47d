"""Indexes against full scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import search as S
from quern.operators.vectorindex import OTHER, VectorIndex, fit_centroids

SCHEMA = "id long, vector array<double>, collection string"


def clustered(rng, clusters=30, each=60, dim=24, spread=0.05):
    centers = rng.normal(size=(clusters, dim))
    v = np.repeat(centers / np.linalg.norm(centers, axis=1, keepdims=True), each, 0) + rng.normal(size=(clusters * each, dim)) * spread
    return [(i, x.tolist(), f"c{i % 3}") for i, x in enumerate(v)]


def scan(rows, query, limit, offset=0, where=lambda r: True):
    q = np.array(query)
    def score(v):
        n = np.linalg.norm(v) * np.linalg.norm(q)
        return float(np.dot(v, q) / n) if n > 0 else 0.0
    kept = [(r[0], score(np.array(r[1]))) for r in rows if r[1] is not None and len(r[1]) == len(q) and where(r)]
    kept.sort(key=lambda t: (-round(t[1], 10), t[0]))
    return [i for i, _ in kept[offset : offset + limit]]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = clustered(np.random.default_rng(3))
    path = str(tmp_path_factory.mktemp("index") / "x")
    return rows, VectorIndex.build(spark.createDataFrame(rows, SCHEMA), path)


def test_searches_are_exact_and_read_few_cells(made, spark):
    rows, index = made
    rng = np.random.default_rng(4)
    for k, (limit, offset) in enumerate([(1, 0), (10, 0), (20, 30), (200, 0)]):
        q = (np.array(rows[77 * k + 5][1]) + rng.normal(size=24) * 0.02).tolist()
        got = index.search(q, S.Page(limit, offset))
        assert [r.id for r in got.rows.collect()] == scan(rows, q, limit, offset)
        assert got.points == len(rows) and got.cells > 20
        if limit <= 20:  # the page lies within one cluster of sixty
            assert got.opened <= got.cells / 5 and got.points_opened <= 300


def test_filters(made, spark):
    rows, index = made
    q = rows[100][1]
    few = spark.createDataFrame([(i,) for i in range(0, 1800, 90)], "id long")
    many = spark.createDataFrame([(i,) for i in range(60, 130)], "id long")
    ids = lambda s: [r.id for r in s.rows.collect()]
    assert ids(index.search(q, 15, ["c1"])) == scan(rows, q, 15, where=lambda r: r[2] == "c1")
    assert ids(index.search(q, 30, allowed=few)) == scan(rows, q, 30, where=lambda r: r[0] % 90 == 0)
    assert ids(index.search(q, 15, excluded=many)) == scan(rows, q, 15, where=lambda r: not 60 <= r[0] < 130)
    assert ids(index.search(q, 15, ["none"])) == []


def test_any_direction_and_odd_queries(made):
    """Queries far from all points, of no length and of another dimension."""
    rows, index = made
    rng = np.random.default_rng(5)
    for _ in range(3):
        q = rng.normal(size=24).tolist()
        assert [r.id for r in index.search(q, 25).rows.collect()] == scan(rows, q, 25)
    assert [r.id for r in index.search([0.0] * 24, 5).rows.collect()] == [0, 1, 2, 3, 4]
    assert index.search([1.0, 2.0], 5).opened == index.search([1.0, 2.0], 5).cells


def test_appends_keep_radii(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = clustered(rng, 12, 40, 8)
    more = [(10_000 + i, x.tolist(), None if i % 2 else "new") for i, x in enumerate(rng.normal(size=(60, 8)))] + [(20_000, [0.0] * 8, "zero"), (20_001, [1.0, 2.0], "short"), (20_002, None, "null"), (20_003, [float("nan")] * 8, "nan")]
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "x"))
    before = {r.cell: r.radius for r in index._read_stats().groupBy("cell").agg({"radius": "max"}).toDF("cell", "radius").collect()}
    index.append(spark.createDataFrame(more, SCHEMA))
    after = {r.cell: r.radius for r in index._read_stats().groupBy("cell").agg({"radius": "max"}).toDF("cell", "radius").collect()}
    assert all(after[c] >= r for c, r in before.items()) and any(after[c] > r for c, r in before.items()) and OTHER in after
    good = [r for r in rows + more if r[1] is not None and r[2] != "nan"]
    for r in more[:5]:
        got = index.search(r[1], 12)
        assert [x.id for x in got.rows.collect()] == scan(good, r[1], 12)
    facet = {r.collection: r.n for r in index.facet().collect()}
    assert facet == {"c0": 160, "c1": 160, "c2": 160, "new": 30, "zero": 1, "short": 1, "nan": 1}


def test_copies_and_empty_tables(spark, tmp_path):
    rows = [(i, [1.0, 0.0], "a") for i in range(300)] + [(1000 + i, [0.0, 1.0], "a") for i in range(3)]
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "x"))
    assert [r.id for r in index.search([1.0, 0.1], 4).rows.collect()] == [0, 1, 2, 3]
    assert [r.id for r in index.search([0.0, 1.0], 4).rows.collect()] == [1000, 1001, 1002, 0]
    empty = VectorIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "y"))
    assert empty.search([1.0], 4).rows.count() == 0 and empty.facet().count() == 0
    assert len(fit_centroids(np.eye(3), 10)) == 3


def test_token_index_follows_its_batches(spark, tmp_path):
    """Inserts, updates and deletions in batches, one of them applied twice: as a scan of what is left."""
    import random

    from quern.operators.textfilter import Pattern, guarded, matches
    from quern.operators.tokenindex import TokenIndex

    rng, index, left = random.Random(10), TokenIndex(spark, str(tmp_path / "t")), {}
    words = ["Chaewon", "kazuha", "2024", "Émile", "winter_portrait", "all", "img", "a", "ab", "abc"]
    schema = "id long, path string, version long"
    for segment in range(4):
        batch = [(rng.randrange(60), None if rng.random() < 0.2 else "/all/" + "/".join(rng.choices(words, k=3)) + ".jpg", v) for v in range(50)] + [(None, "/all/x.jpg", 0)]
        for i, p, _ in batch:
            if i is not None:
                left[i] = p
        for _ in range(1 + (segment == 2)):
            index.apply(spark.createDataFrame(batch, schema), segment)
        live = spark.createDataFrame([(i, p) for i, p in left.items() if p], "id long, path string")
        if segment in (0, 3):
            for compacted in range(1 + (segment == 3)):
                if compacted:
                    index.compact()
                for text in ("chaewon", "emile", "ab*", "winter_por*", "portrait_jpg", "none", "all", "a*"):
                    pattern = Pattern.parse(text)
                    ids = lambda df: sorted(r.id for r in df.select("id").collect())
                    assert ids(index.matches(pattern)) == ids(live.where(matches(F.col("path"), pattern))), text
                    if text in ("all", "emile", "a*"):
                        assert ids(index.guarded(pattern)) == ids(guarded(live, pattern)), text
    assert index._counts("all", False) == index.total() == sum(p is not None for p in left.values())
    assert TokenIndex(spark, str(tmp_path / "none")).matches(Pattern.parse("a")).count() == 0
