"""Centroids and known files kept by streams, against folds of everything that came."""

import datetime as dt
import random

import numpy as np
import pytest

from quern.operators.ingest import sync_plan
from quern.streaming.centroids import LOG, KeptCentroids, centroid_stream
from quern.streaming.changes import SIGHTINGS, Changes, change_stream

T0 = dt.datetime(2024, 1, 1)


def at(n):
    return T0 + dt.timedelta(seconds=n)


def happenings(rng, n, dim=3):
    out = []
    for _ in range(n):
        kind = rng.choice(["add"] * 6 + ["remove", "remove", "drop", "vector", "vector", "vector", "delete"])
        vector = [rng.uniform(-1, 1) for _ in range(dim)] if kind == "vector" else None
        out.append((at(rng.randrange(60)), kind, f"s{rng.randrange(4)}", rng.randrange(12), vector))
    bad = [(at(1), "vector", None, 3, [float("nan")] * dim), (at(99), "add", None, 3, None), (at(99), "add", "s1", None, None), (at(99), "oops", "s1", 3, None), (None, "drop", None, None, None)]
    return out + bad + out[: n // 10]


def by_hand(rows):
    pairs, points, drops = {}, {}, {}
    for t, kind, name, photo, vector in rows:
        if t is None:
            continue
        if kind in ("add", "remove") and name is not None and photo is not None:
            pairs[name, photo] = max(pairs.get((name, photo), (T0 - dt.timedelta(1), False)), (t, kind == "add"))
        elif kind in ("vector", "delete"):
            v = tuple(vector) if vector and np.isfinite(vector).all() else ()
            points[photo] = max(points.get(photo, (T0 - dt.timedelta(1), ())), (t, v))
        elif kind == "drop":
            drops[name] = max(drops.get(name, T0), t)
    sets = {}
    for (name, photo), (t, on) in pairs.items():
        if on and (name not in drops or t >= drops[name]) and points.get(photo, (None, ()))[1]:
            sets.setdefault(name, []).append(points[photo][1])
    return {name: (len(v), np.mean(v, axis=0)) for name, v in sets.items()}


def same(kept, rows):
    got, want = {r.name: (r.n, np.array(r.mean)) for r in kept.read().collect()}, by_hand(rows)
    assert got.keys() == want.keys()
    for name in want:
        assert got[name][0] == want[name][0] and np.abs(got[name][1] - want[name][1]).max() < 1e-12


def test_centroids_after_any_prefix_and_bits_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = happenings(rng, 150)
    rng.shuffle(rows)
    kept, cut = KeptCentroids(spark, str(tmp_path / "a"), 3), len(rows) // 4 + 1
    for k in range(4):
        batch = spark.createDataFrame(rows[k * cut : (k + 1) * cut], LOG)
        for number in [k, k, *range(k)]:  # run again, and older ones, too
            kept.fold(batch, number)
        same(kept, rows[: (k + 1) * cut])
    whole = KeptCentroids(spark, str(tmp_path / "b"), 2)
    whole.fold(spark.createDataFrame(rows, LOG), 0)
    assert sorted(map(tuple, whole.read().collect())) == sorted(map(tuple, kept.read().collect()))


def test_a_batch_whose_driver_is_lost_before_the_sums(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    parts = [happenings(rng, 60) for _ in range(3)]
    kept, source = KeptCentroids(spark, str(tmp_path / "k"), 2), str(tmp_path / "in")
    stream = lambda: centroid_stream(spark.readStream.schema(LOG).parquet(source), kept, str(tmp_path / "c"))
    add = lambda rows: spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)
    add(parts[0])
    stream().awaitTermination()
    same(kept, parts[0])

    def fails(*_):
        raise OSError("the driver is gone")

    fold, kept.sums.fold = kept.sums.fold, fails
    add(parts[1])
    with pytest.raises(Exception):  # noqa: B017 - whatever the stream makes of it
        stream().awaitTermination()
    same(kept, parts[0])
    kept.sums.fold = fold
    stream().awaitTermination()
    add(parts[2])
    stream().awaitTermination()
    same(kept, [r for p in parts for r in p])


def test_vectors_of_other_dimensions_and_nothing(spark, tmp_path):
    kept = KeptCentroids(spark, str(tmp_path / "k"), 2)
    kept.fold(spark.createDataFrame([], LOG), 0)
    assert kept.read().count() == 0 and kept.done() == 0
    rows = [(at(1), "add", "s", 1, None), (at(1), "add", "s", 2, None), (at(1), "vector", None, 1, [1.0, 2.0]), (at(1), "vector", None, 2, [5.0])]
    kept.fold(spark.createDataFrame(rows, LOG), 1)
    assert sorted((r.name, r.n, r.mean) for r in kept.read().collect()) == [("s", 1, [1.0, 2.0]), ("s", 1, [5.0])]
    kept.fold(spark.createDataFrame([(at(2), "vector", None, 1, [3.0]), (at(2), "vector", None, 2, [])], LOG), 2)
    assert [tuple(r) for r in kept.read().collect()] == [("s", 1, [3.0], [1.0])]
    kept.fold(spark.createDataFrame([(at(3), "drop", "s", None, None)], LOG), 3)
    assert kept.read().where("centroid is not null").count() == 0


def test_decisions_are_the_plan_whatever_the_order(spark, tmp_path):
    rng = random.Random(3)
    index = [(f"/a/f{i}", rng.choice([None, 1, 2]), rng.choice([5, 6])) for i in range(30)]
    files = [(f"/a/f{i}", rng.choice([1, 2]), rng.choice([5, 6])) for i in range(10, 45)]
    i, f = spark.createDataFrame(index, "path string, mtime long, size long"), spark.createDataFrame(files, "path string, mtime long, size long")
    want = sorted(map(tuple, sync_plan(f, i).collect()))
    rng.shuffle(files)
    changes = Changes(spark, str(tmp_path / "c"), 3)
    changes.start(i)
    for k in range(3):
        batch = spark.createDataFrame([(p, at(rng.randrange(9)), m, s, None) for p, m, s in files[k::3]], SIGHTINGS)
        for number in [k + 1, k + 1, *range(k + 1)]:
            changes.fold(batch, number)
    assert sorted((r.path, r.reason) for r in changes.decisions().collect()) == want
    walk = [("/A/", at(0), None, None, True), ("/other", at(99), None, None, True), (None, at(5), 1, 1, None), ("/a/f11", None, 1, 1, None)]
    changes.fold(spark.createDataFrame(walk, SIGHTINGS), 4)
    gone = {r.path for r in changes.decisions().where("reason = 'gone'").collect()}
    assert gone == {p for p, _, _ in index} - {p for p, _, _ in files}
    assert {r.path for r in changes.known.read().where("present").collect()} == {p for p, _, _ in files}


def test_files_change_go_and_come_back(spark, tmp_path):
    source = str(tmp_path / "in")
    changes = Changes(spark, str(tmp_path / "c"), 2)
    changes.start(spark.createDataFrame([], "path string, mtime long, size long"))
    steps = [
        [("/r/x", at(1), 1, 1, None), ("/r/y", at(1), 1, 1, None), ("/r/x", at(1), 1, 1, None)],
        [("/r/x", at(5), 2, 1, None), ("/r/x", at(3), 9, 9, None), ("/r", at(4), None, None, True)],
        [("/r/y", at(3), 7, 7, None), ("/r/x", at(2), 7, 7, None), ("/r/z", at(3), 1, 1, None), ("/rr/z", at(3), 1, 1, None)],
        [("/r/y", at(6), 1, 1, None), ("/r/x", at(7), 2, 1, None)],
    ]
    for rows in steps:
        spark.createDataFrame(rows, SIGHTINGS).coalesce(1).write.mode("append").parquet(source)
        change_stream(spark.readStream.schema(SIGHTINGS).parquet(source), changes, str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.batch, r.path, r.reason) for r in changes.decisions().collect())
    assert got == [(1, "/r/x", "new"), (1, "/r/y", "new"), (2, "/r/x", "changed"), (2, "/r/y", "gone"), (3, "/r/x", "skip"), (3, "/r/y", "skip"), (3, "/r/z", "gone"), (3, "/r/z", "new"), (3, "/rr/z", "new"), (4, "/r/x", "skip"), (4, "/r/y", "new")]


def test_a_norm_is_worked_out_once_a_vector(spark):
    from pyspark.sql import functions as F

    from quern.functions.vectors import l2_normalise

    rows = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0] * 9)]
    out = spark.createDataFrame(rows, "id long, v array<double>").select("id", l2_normalise(F.transform("v", lambda x: x * 2)).alias("u"))
    assert {r.id: r.u for r in out.collect()} == {0: [0.6, 0.8], 1: None, 2: None, 3: None, 4: [1 / 3] * 9}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_a_photo_brings_its_change_once_to_a_set_that_it_stays_in(spark, tmp_path, monkeypatch):
    from quern.streaming import centroids

    added, real = [], centroids.sum_vectors
    monkeypatch.setattr(centroids, "sum_vectors", lambda rows, *by: added.append(rows.count()) or real(rows, *by))
    first = [(at(1), "add", f"s{k % 2}", k, None) for k in range(10)] + [(at(1), "vector", None, k, [k + 0.1, 0.2]) for k in range(10)]
    # 0 to 5 stay as they are, 6 has a new vector, 7 one of another size, 8 leaves, 9 loses its vector
    second = [(at(2), "add", f"s{k % 2}", k, None) for k in range(8)] + [(at(2), "vector", None, k, [k + 0.1, 0.2]) for k in range(6)]
    second += [(at(2), "vector", None, 6, [-6.3, 0.7]), (at(2), "vector", None, 7, [7.0]), (at(2), "remove", "s0", 8, None), (at(2), "delete", None, 9, None)]
    kept = KeptCentroids(spark, str(tmp_path / "k"), 3)
    for number, rows in enumerate((first, second)):
        kept.fold(spark.createDataFrame(rows, LOG), number)
    assert added == [10, 5]
    got = {(r.name, len(r.mean)): (r.n, np.array(r.mean)) for r in kept.read().collect()}
    want = {("s0", 2): [[0.1, 0.2], [2.1, 0.2], [4.1, 0.2], [-6.3, 0.7]], ("s1", 2): [[1.1, 0.2], [3.1, 0.2], [5.1, 0.2]], ("s1", 1): [[7.0]]}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][0] == len(v) and np.abs(got[k][1] - np.mean(v, axis=0)).max() < 1e-12
