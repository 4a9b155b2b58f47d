"""Tables kept by streams against folds of everything that came."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators.state import upsert
from quern.streaming.points import point_table, upsert_stream

SCHEMA = "id long, path string, size long, version long"


def updates(rng, n):
    return [(rng.randrange(40), f"p{rng.randrange(5)}", rng.randrange(9), rng.randrange(6)) for _ in range(n)] + [(None, "p", 1, 1)]


def folded(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).where("id is not null")
    best = df.groupBy("id").agg(F.max(F.struct("version", "path", "size")).alias("r")).select("id", "r.path", "r.size", "r.version")
    return sorted(map(tuple, best.collect()))


@pytest.mark.parametrize("splits", [1, 4])
def test_any_split_into_batches_gives_the_fold(spark, tmp_path, splits):
    rng = random.Random(splits)
    rows, table = updates(rng, 200), point_table(spark, str(tmp_path / "t"), SCHEMA, buckets=4)
    for k in range(splits):
        part = rows[k::splits]
        for number in [k, k, *range(k)]:  # run again, and older ones, too
            table.fold(spark.createDataFrame(part, SCHEMA), number)
    assert sorted(map(tuple, table.read().collect())) == folded(spark, rows)
    distinct = spark.createDataFrame({r[0]: r for r in rows if r[0] is not None}.values(), SCHEMA)
    assert upsert(distinct.limit(0), distinct, ["id"], "version").count() == distinct.count()


def test_a_batch_that_fails_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """The driver fails between the data and the file that counts them; the stream starts again where it was."""
    rng = random.Random(5)
    table, source = point_table(spark, str(tmp_path / "t"), SCHEMA, buckets=4), str(tmp_path / "in")
    parts = [updates(rng, 50) for _ in range(3)]
    stream = lambda: upsert_stream(spark.readStream.schema(SCHEMA).parquet(source), table, str(tmp_path / "c"))
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    add(parts[0])
    stream().awaitTermination()
    seen = sorted(map(tuple, table.read().collect()))
    assert seen == folded(spark, parts[0]) and table.done() == 0
    count = type(table)._count

    def fails(self, versions, number):
        raise OSError("the driver is gone")

    monkeypatch.setattr(type(table), "_count", fails)
    add(parts[1])
    with pytest.raises(Exception):  # noqa: B017 - whatever the stream makes of it
        stream().awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == seen
    monkeypatch.setattr(type(table), "_count", count)
    stream().awaitTermination()
    add(parts[2])
    stream().awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == folded(spark, [r for p in parts for r in p]) and table.done() == 2


def test_an_empty_table(spark, tmp_path):
    table = point_table(spark, str(tmp_path / "t"), SCHEMA)
    assert table.read().count() == 0 and table.done() == -1
    table.fold(spark.createDataFrame([], SCHEMA), 0)
    assert table.read().count() == 0 and table.done() == 0
