"""File snapshots, caches, and sessions as streams."""

import os

import numpy as np
import pytest

from quern.operators.discover import replay
from quern.sources import centroids, files, tables
from quern.streaming.sessions import discover


def test_snapshot(spark, tmp_path):
    for name in ("a.jpg", "b.PNG", "sub/c.webp", ".hidden.jpg", ".dir/d.jpg", "Thumbs.db", "notes.txt", "e.jpeg.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x" * 7)
    os.utime(tmp_path / "a.jpg", (1000, 1000))
    got = {os.path.relpath(r.path, tmp_path): (r.mtime, r.size) for r in files.snapshot(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.jpg", "b.PNG", "sub/c.webp"} and got["a.jpg"] == (1000, 7)
    assert files.contents(spark, str(tmp_path)).count() == 3
    with pytest.raises(Exception):
        files.snapshot(spark, str(tmp_path / "gone")).count()


def test_cache_and_replacement(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("p", "1", 5, 6)], "path string, id string, mtime long, size long")
    tables.write_cache(rows, path, "c")
    assert [tuple(r) for r in tables.read_cache(spark, path, "c").collect()] == [("p", "1", 5, 6)]
    assert tables.read_cache(spark, path, "other").count() == 0
    tables.write_cache(tables.read_cache(spark, path, "c").union(rows), path, "c")
    assert tables.read_cache(spark, path, "c").count() == 2


def test_scratch_tables_lie_in_the_shared_folder(spark, tmp_path, monkeypatch):
    """Where the setting names a folder, tables are written there, read from there, and removed from there."""
    from types import SimpleNamespace

    from quern import scratch
    from quern.operators.graph import connected_components

    monkeypatch.setattr(scratch, "_setting", lambda s: f"file://{tmp_path}/shared/")  # a running session does not take it
    try:
        s = scratch.Scratch(spark)
        kept = s.keep(spark.range(5), "t")
        assert kept.count() == 5 and [p.name.split("-")[0] for p in (tmp_path / "shared").iterdir()] == ["t"]
        s.drop(kept)
        edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "src long, dst long")
        labels = connected_components(edges)
        assert {(r.node, r.label) for r in labels.collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
        assert [p.name.split("-")[:2] for p in (tmp_path / "shared").iterdir()] == [["cc", "labels"]]  # what the result still reads
        scratch._remove_all()
        assert list((tmp_path / "shared").iterdir()) == []
    finally:
        monkeypatch.undo()
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(cluster)


def test_a_migration_is_done_once(spark, tmp_path):
    done, flags = [], str(tmp_path / "flags")
    with pytest.raises(ZeroDivisionError):
        tables.once(spark, flags, "v1", lambda: 1 / 0)
    assert tables.once(spark, flags, "v1", lambda: done.append(1)) and not tables.once(spark, flags, "v1", lambda: done.append(2)) and tables.once(spark, flags, "v2", lambda: done.append(3))
    assert done == [1, 3]


def test_what_takes_too_long():
    import time

    with pytest.raises(TimeoutError), files.within(0.05):
        time.sleep(5)
    with files.within(5):
        pass


def test_centroid_files(spark, tmp_path):
    good = '{"name": "%s", "model": "m", "feature_dim": 2, "centroid": [1.0, 0.0]}'
    for i, text in enumerate([good % "A", good % "A", good % "b", good % " ", '{"name": "x", "model": "other", "feature_dim": 2, "centroid": [1.0, 0.0]}', '{"name": "y", "model": "m", "feature_dim": 3, "centroid": [1.0]}', "{broken"]):
        (tmp_path / f"{i}.json").write_text(text)
    c = centroids.usable_centroids(centroids.read_centroids(spark, str(tmp_path)), "m", 2)
    assert {r.name: os.path.basename(r.source) for r in c.select("name", "source").collect()} == {"A": "0.json", "b": "2.json"}
    assert centroids.by_name(c, "B").first().name == "b" and centroids.by_name(c, "zz").count() == 0


def test_sessions_stream_like_a_replay(spark, tmp_path):
    rng = np.random.default_rng(0)
    m, ids = rng.normal(size=(60, 8)), np.arange(60)
    want = replay("s", [0] * 3, ids, m)
    rows = [("s", None)] + [("s", int(w[1])) for w in want[:3]] + [("s", -1)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for r in rows:
        spark.createDataFrame([r], "session string, picked_id long").coalesce(1).write.mode("append").parquet(src)
        q = discover(spark.readStream.schema("session string, picked_id long").parquet(src), ids, m, None).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r["round"], r.left_id, r.right_id, r.source) for r in spark.read.parquet(out).collect())
    assert got == [tuple(w) for w in want]


def test_forgotten_sessions(spark, tmp_path):
    """A session without picks for its time to live starts anew, others go on."""
    import time

    rng = np.random.default_rng(1)
    m, ids = rng.normal(size=(40, 4)), np.arange(40)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame(rows, "session string, picked_id long").coalesce(1).write.mode("append").parquet(src)
        q = discover(spark.readStream.schema("session string, picked_id long").parquet(src), ids, m, 1500).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)

    run([("s", None)])
    time.sleep(2)
    run([("t", None)])
    time.sleep(0.1)
    run([("s", None)])
    got = sorted((r.session, r["round"]) for r in spark.read.parquet(out).collect())
    assert got == [("s", 1), ("s", 1), ("t", 1)]
