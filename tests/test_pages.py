"""Pages against sorted lists: every row once, few parts opened, random places."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators.pages import Cursor, Pages, shuffled

SCHEMA = "id long, source string"


def rows_of(ids):
    return [(i, [None, "a", "b", "c"][i % 4]) for i in ids]


def walk(pages, limit, groups=None, between=lambda k: None):
    out, after, opened = [], None, []
    for k in range(10_000):
        read = pages.page(limit, after, groups)
        got = [r.id for r in read.rows.collect()]
        assert len(got) == read.n <= limit
        out += got
        opened.append(read.opened)
        if read.after is None:
            return out, opened
        after = read.after
        between(k)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Two segments of parts of about 50 rows, by id and shuffled."""
    ids = random.Random(1).sample(range(3000), 900)
    out = []
    for name, key in (("id", F.col("id")), ("mix", shuffled())):
        pages = Pages(spark, str(tmp_path_factory.mktemp("pages") / name), SCHEMA, key, "source", 50)
        pages.append(spark.createDataFrame([*rows_of(ids[:700]), (None, "a")], SCHEMA), 0)
        pages.append(spark.createDataFrame(rows_of(ids[700:]), SCHEMA), 1)
        pages.append(spark.createDataFrame(rows_of(ids[700:]), SCHEMA), 1)  # run again
        out.append(pages)
    return ids, *out


def test_pages_cover_every_row_once_and_open_few_parts(made):
    ids, by_id, _ = made
    got, opened = walk(by_id, 100)
    assert got == sorted(ids)
    # about 24 parts in all; 100 rows are 2 to 3 parts of the one segment and 1 of the other, and those at the ends
    assert by_id.parts().count() >= 18 and max(opened) <= 9
    assert walk(by_id, 130, ["a", ""])[0] == sorted(i for i in ids if i % 4 in (0, 1))
    assert by_id.page(10, None, ["no"]).n == 0 and by_id.page(0).n == 0


def test_a_cursor_survives_appends(made, spark, tmp_path):
    pages = Pages(spark, str(tmp_path / "p"), SCHEMA, F.col("id"), part_rows=40)
    pages.append(spark.createDataFrame(rows_of(range(0, 200, 2)), SCHEMA), 0)
    got, _ = walk(pages, 60, between=lambda k: pages.append(spark.createDataFrame(rows_of(range(1, 240, 2)), SCHEMA), 1) if k == 0 else None)
    # rows behind the cursor at the time of the append are seen, those before it are not
    assert got == list(range(0, 120, 2)) + list(range(119, 200)) + list(range(201, 240, 2))


def test_shuffled_pages_go_around(made):
    ids, _, mix = made
    order, _ = walk(mix, 250)
    assert sorted(order) == sorted(ids) and order != sorted(ids)
    whole = mix.compacted(mix.path + "-whole")
    assert walk(whole, 300)[0] == order
    start = mix.random_place("seed")
    read = mix.around(850, start)
    at = order.index(start.id) + 1
    assert [r.id for r in read.rows.collect()] == (order[at:] + order[:at])[:850] and read.n == 850
    assert sorted(r.id for r in mix.around(2000, start).rows.collect()) == sorted(ids)  # every row once


def test_ties_of_keys_and_repeated_rows(spark, tmp_path):
    pages = Pages(spark, str(tmp_path / "p"), SCHEMA, F.col("id") % 3, part_rows=10)
    pages.append(spark.createDataFrame(rows_of(range(60)), SCHEMA), 0)
    assert walk(pages, 7)[0] == sorted(range(60), key=lambda i: (i % 3, i))
    empty = Pages(spark, str(tmp_path / "e"), SCHEMA, F.col("id"))
    assert empty.page(5).n == 0 and empty.random_place("s") is None
    empty.append(spark.createDataFrame([], SCHEMA), 0)
    assert empty.page(5, Cursor(1, 1)).n == 0 and empty.random_place("s") is None


def test_random_places_are_uniform_over_rows_and_not_parts(spark, tmp_path):
    """Parts of unequal size: a row's chance does not depend on its part's."""
    pages = Pages(spark, str(tmp_path / "p"), SCHEMA, shuffled(), "source")
    for segment, ids in enumerate([range(2), range(2, 20)]):
        pages.append(spark.createDataFrame(rows_of(ids), SCHEMA), segment)
    n = 60
    few = sum(pages.random_place(f"{s}").id < 2 for s in range(n))
    assert abs(few - n / 10) < 3.5 * math.sqrt(n * 0.1 * 0.9)
    assert pages.random_place("x") == pages.random_place("x")
    assert pages.random_place("x", ["c"]).id % 4 == 3
