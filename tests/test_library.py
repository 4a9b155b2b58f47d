"""Centroids by name, kept results, refreshes, pictures, and ingestion from end to end."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import images, scalars
from quern.operators import centroids as N, sync as Y
from quern.sources import cache


# -- centroids -----------------------------------------------------------------------


def test_registry(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    calls, wanted = [], ["id = 1"]

    def source():
        calls.append(1)
        return df.where(wanted[0])

    r = N.Registry()
    assert r.get("likes") is None and r.names() == []
    r.register("likes", source)
    assert r.count("likes") is None and r.get("likes").vector == pytest.approx([1, 0]) and r.count("likes") == 1
    wanted[0] = "true"
    assert r.get("likes").n == 1 and len(calls) == 1  # still the old one
    r.invalidate("likes")
    assert r.count("likes") is None and r.get("likes").n == 2 and [s.id for s in r.get("likes").seeds.collect()] == [1, 2]
    wanted[0] = "false"
    r.invalidate("likes")
    assert not r.is_empty("likes") and r.get("likes") is None and r.is_empty("likes")
    r.register("broken", lambda: 1 / 0)
    assert r.get("broken") is None and r.names() == ["broken", "likes"]
    r.unregister("likes")
    assert r.names() == ["broken"] and r.get("likes") is None


def test_all_or_nothing(spark):
    r = N.Registry()
    r.register("mine", lambda: spark.createDataFrame([(1, [0.0, 2.0])], "id long, vector array<double>"))
    static = {"sea": [1.0, 0.0], "odd": [1.0, 0.0, 0.0]}
    assert N.resolve(["sea", "mine"], static, r) == pytest.approx([2**-0.5] * 2)
    assert N.resolve(["sea", "mine"], static, r, [5, 12]) == pytest.approx([5 / 13, 12 / 13])
    with pytest.raises(LookupError, match="gone"):
        N.resolve(["sea", "gone", "lost"], static, r)
    with pytest.raises(ValueError):
        N.resolve(["odd"], static, r, dim=2)
    table = spark.createDataFrame([("Sea", [1.0]), ("SEA", [2.0]), ("hill", [3.0])], "name string, centroid array<double>")
    assert N.static_vectors(table, ["SEA", "sea", "Hill", "none"]) == {"SEA": [2.0], "sea": [2.0], "Hill": [3.0]}


def test_centroids_or_prompts():
    by = {"centroid": lambda names: ["c", *names], "text": lambda p, n: ["t", *p, *n], "dim": 2}
    assert N.query_vector(["a"], [], [], **by) == ["c", "a"] and N.query_vector([], ["p"], ["n"], **by) == ["t", "p", "n"]
    assert N.query_vector([], [], [], pattern="lake", **by) == [0.0, 0.0]
    for names, p, n, pattern in ((["a"], ["p"], [], ""), (["a"], [], ["n"], ""), ([], [], [], " "), ([], [], ["n"], "")):
        with pytest.raises(ValueError):
            N.query_vector(names, p, n, pattern=pattern, **by)


def test_source_names_and_drift():
    assert N.source_names(["/a/b/", "C:\\x\\y"]) == ["b", "y"] and N.source_names(["/a", "/b"], ["one"]) == ["one", "one"] and N.source_names(["/a", "/b"], ["x", "y"]) == ["x", "y"]
    with pytest.raises(ValueError):
        N.source_names(["/a", "/b", "/c"], ["x", "y"])
    assert N.drift(7, 5) == 2 and N.drift(-1, 5) == N.drift(None, 5) == "unknown"


# -- kept results --------------------------------------------------------------------


def test_result_cache(spark):
    now, made = [0.0], []

    def make(n):
        return lambda: made.append(n) or spark.range(n)

    c = cache.ResultCache(spark, ttl=10, most=2, clock=lambda: now[0])
    first = c.get("a", make(3))
    assert first.count() == 3 and c.get("a", make(4)).count() == 3 and made == [3]
    now[0] = 10
    assert c.get("a", make(5)).count() == 5 and made == [3, 5]
    c.get("b", make(1)), c.get("c", make(2))
    assert len(c) == 2 and c.get("c", make(9)).count() == 2 and c.get("a", make(6)).count() == 6
    c.clear()
    assert len(c) == 0 and cache.ResultCache(spark, ttl=0).get("x", make(8)).count() == 8


def test_rebuilds(spark, tmp_path):
    path = str(tmp_path / "images")
    rows = lambda n: spark.range(n).select("id", F.concat(F.lit("/p/"), "id").alias("path"))
    assert cache.rebuild(rows(3), path) == 3 and cache.rebuild(rows(5), path) == 3 and cache.rebuild(rows(5), path, force=True) == 5
    for bad in (rows(2).withColumn("path", F.lit("")), rows(2).withColumn("id", F.lit(None).cast("long"))):
        with pytest.raises(Exception, match="without id or path"):
            cache.rebuild(bad, path, force=True)
    assert spark.read.parquet(path).count() == 5


def test_one_refresh_at_a_time(spark, tmp_path):
    path = str(tmp_path / "images")
    one, two = (cache.Refresher(spark, path) for _ in range(2))
    rows = spark.range(4).select("id", F.lit("/p").alias("path"))
    assert one.claim() and two.refresh(lambda: rows) is None
    one.release()
    assert two.refresh(lambda: rows) == 4 and one.claim()
    assert cache.Refresher(spark, path, stale=-1).refresh(lambda: rows) == 4  # its writer was lost


# -- pictures ------------------------------------------------------------------------


def brute_blurhash(p, across, down):
    h, w, _ = p.shape
    lin = lambda v: v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4
    srgb = lambda v: int((12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055) * 255 + 0.5)
    parts = []
    for j in range(down):
        for i in range(across):
            s = [0.0] * 3
            for y in range(h):
                for x in range(w):
                    basis = (1 if i == j == 0 else 2) * math.cos(math.pi * i * x / w) * math.cos(math.pi * j * y / h)
                    for c in range(3):
                        s[c] += basis * lin(int(p[y, x, c])) / (w * h)
            parts.append(s)

    def digits(n, length):
        return "".join(images.DIGITS[n // 83**k % 83] for k in range(length - 1, -1, -1))

    scale = max(0, min(82, math.floor(max(abs(v) for s in parts[1:] for v in s) * 166 - 0.5)))
    out = digits(across - 1 + (down - 1) * 9, 1) + digits(scale, 1)
    r, g, b = (srgb(min(1, max(0, v))) for v in parts[0])
    out += digits(r * 65536 + g * 256 + b, 4)
    for s in parts[1:]:
        q = [max(0, min(18, math.floor(math.copysign(math.sqrt(abs(v) / ((scale + 1) / 166)), v) * 9 + 9.5))) for v in s]
        out += digits(q[0] * 361 + q[1] * 19 + q[2], 2)
    return out


def test_blurhash(spark):
    rng = np.random.default_rng(1)
    for across, down in ((4, 3), (1, 1), (5, 2)):
        p = rng.integers(0, 256, (9, 12, 3)).astype(np.uint8)
        if across > 1:
            assert images.blurhash(p, across, down) == brute_blurhash(p, across, down)
        assert len(images.blurhash(p, across, down)) == 4 + 2 * across * down
    assert images.blurhash(np.zeros((8, 8, 3), np.uint8)) == "L00000fQfQfQfQfQfQfQfQfQfQfQ"
    df = spark.createDataFrame([(1, p.tobytes()), (2, b"short"), (3, None)], "id long, pixels binary").select("id", images.blurhash_of(F.col("pixels"), 12, 9).alias("b"))
    assert {r.id: r.b for r in df.collect()} == {1: images.blurhash(p), 2: None, 3: None}
    assert df.where(scalars.blurhash_valid(F.col("b"))).count() == 1


def test_mock_images(spark):
    df = spark.createDataFrame([(1, b"a"), (2, b"a"), (3, b"b"), (4, None)], "id long, content binary").select("id", images.mock_image_embedding(F.col("content"), 8).alias("v"))
    got = {r.id: r.v for r in df.collect()}
    assert got[1] == got[2] != got[3] and got[4] is None and np.linalg.norm(got[3]) == pytest.approx(1)


def test_stamps(spark):
    r = spark.sql("select timestamp_ntz '2024-03-05 06:07:08.009' as t").select(scalars.iso_stamp(F.col("t")), scalars.day_stamp(F.col("t"))).first()
    assert tuple(r) == ("2024-03-05T06:07:08.009000+00:00", "2024-03-05")


# -- ingestion -----------------------------------------------------------------------


def test_a_run_from_end_to_end(spark):
    files = "path string, mtime long, size long, content binary"
    sea = spark.createDataFrame([("/disk/sea/new.jpg", 1, 1, b"n"), ("/disk/sea/same.jpg", 2, 2, b"s"), ("/disk/sea/other.jpg", 9, 3, b"o"), ("/disk/sea/bad.jpg", 1, 1, None)], files)
    hills = spark.createDataFrame([("/disk/hills/h.jpg", 5, 5, b"h")], files)
    walks = [(Y.Source("sea", "/disk", "//nas"), sea), (Y.Source("hills", "/disk", "//nas"), hills)]
    known = [("/disk/sea/same.jpg", "sea", 2, 2), ("/disk/sea/other.jpg", "sea", 3, 3), ("/disk/sea/lost.jpg", "sea", 1, 1), ("/disk/hills/h.jpg", "hills", 5, None), ("/disk/else/x.jpg", "else", 1, 1)]
    index = spark.createDataFrame([(*k, f"//nas{k[0][5:]}") for k in known], "local string, collection string, mtime long, size long, path string")
    index = index.select(scalars.point_id(F.lit(""), F.col("local")).alias("id"), "path", "collection", "mtime", "size", F.array(F.lit(1.0)).alias("vector"), F.lit("v0").alias("model_name"))
    embed = lambda c: images.mock_image_embedding(c, 4)
    after, counts = Y.synced(index, walks, embed)
    assert counts.first().asDict() == {"indexed": 1, "re_embedded": 2, "skipped": 1, "errors": 1, "pruned": 0}
    got = {r.path: r for r in after.collect()}
    assert len(got) == 6 and len(got["//nas/sea/new.jpg"].vector) == 4 and got["//nas/sea/same.jpg"].vector == [1.0]
    assert (got["//nas/sea/other.jpg"].mtime, len(got["//nas/sea/other.jpg"].vector)) == (9, 4) and got["//nas/hills/h.jpg"].size == 5
    old = {r.path: r.id for r in index.collect()}
    assert all(got[p].id == i for p, i in old.items())
    after, counts = Y.synced(index, walks, embed, pruning=True)
    assert counts.first().pruned == 1 and {r.path for r in after.collect()} == set(got) - {"//nas/sea/lost.jpg"}
    again, counts = Y.synced(after, walks, embed, full=True)
    assert counts.first().asDict() == {"indexed": 0, "re_embedded": 0, "skipped": 4, "errors": 1, "pruned": 0} and again.count() == 5


def test_cache_key_rounds_exact_values_and_ties_to_even(spark, duck):
    """Java's format would give 0.10351563 and 0.00000001 for the first two; nulls are as in SQL."""
    odd = [[0.103515625, 0.0], [0.000000005], [0.166015625, -0.103515625], [1e23, 123456789012.123456785], [float("nan"), float("inf"), -float("inf")], [-0.0, 1e-300], [None, 0.5], [None], [], None]
    rows = [(i, v, "c") for i, v in enumerate(odd)] + [(99, [0.5], None)]
    got = spark.createDataFrame(rows, "id long, vector array<double>, c string").select("id", scalars.cache_key(F.col("vector"), F.lit("balanced"), F.col("c")).alias("key")).collect()
    sql = "SELECT left(sha256(sha256(list_aggregate(list_transform(v, lambda x: printf('%.8f', x)), 'string_agg', ',')) || '|balanced|' || c), 20) FROM (SELECT $1::DOUBLE[] AS v, $2::VARCHAR AS c)"
    assert {r.id: r.key for r in got} == {i: duck.execute(sql, [v, c]).fetchone()[0] for i, v, c in rows}
