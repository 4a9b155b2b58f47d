import itertools
import random
import re

import numpy as np
import pytest
from conftest import rows_of

from quern.llm import filteraudit


def naive(rows, good, toxic):
    """Filters applied one after the other, document by document; rows are (doc_id, source, text)."""
    rows = [(i, s or "", t or "") for i, s, t in rows]
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }

    failed = [(p, i in good, i in toxic, fails(i, t)) for i, p, t in rows]
    out = {}
    for part in {p for p, *_ in failed}:
        mine = [x for x in failed if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if x[3][f]]
                left = [x for x in left if not x[3][f]]
                total[f] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), sum(x[3][f] for x in mine) - len(gone), sum(x[3][f] and sum(x[3].values()) == 1 for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_incidence():
    orders, filters, by = filteraudit.incidence(5)
    assert len(orders) == 120 and filters.shape == (600,) and all(m.shape == (32, 600) and m.dtype == np.int64 for m in by.values())
    assert (by["kept"] + by["removed"] + by["redundant"] <= 1).all()
    # what is kept after the last step is what fails nothing
    assert (by["kept"][:, 4::5].sum(axis=1) > 0).tolist() == [True] + [False] * 31
    with pytest.raises(ValueError):
        filteraudit.incidence(9)


def test_audit(spark):
    rng = random.Random(9)
    words = ["the", "and", "word", "Name", "CAPS", "#tag", "a|b", "é", " ", "\x1c", "x\ty", "1&2"]
    texts = [" ".join(rng.choice(words[: rng.randrange(3, 12)] + [f"w{rng.randrange(200)}" for _ in range(rng.randrange(60))]) for _ in range(rng.randrange(120))) for _ in range(60)] + ["", " ", "A" * 300_000]
    rows = [(i, rng.choice(["a", "b", "c", "", None]), rng.choice([*texts, None])) for i in range(400)]
    rows += [(None, "a", texts[0]), (None, "d", None), (7, "a", rows[7][2]), (7, "b", rows[7][2]), (5, "a", texts[1])] + [(1000 + i, "hot", "the same") for i in range(200)] + [(-5, "cold", "the same")] * 3
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 400, 3)] + [(3, None, 1), (None, 1, 1), (1001, 2, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as mask", "'x' as part", "2 as n", "'y' as digest")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'z' as part", "3 as good")
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    got = filteraudit.audit(docs.repartition(7), told).collect()
    assert len(got) == 600 * len({(s or "") for _, s, _ in rows})
    assert {tuple(r) for r in got} == naive(rows, good, toxic)
    assert filteraudit.audit(docs.limit(0), told).count() == 0
    assert {r.good_lost for r in filteraudit.audit(docs, told.limit(0)).collect()} == {0}


def test_other_filters(spark):
    """Two filters of one's own: three with the copies, 6 orders of 3 steps."""
    own = {"x": lambda text, words: text.contains("x"), "y": lambda text, words: text.contains("y")}
    docs = spark.createDataFrame([(1, "p", "x"), (2, "p", "xy"), (3, "p", "xy"), (4, "p", "z")], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): r for r in filteraudit.audit(docs, labels, own, "c").collect()}
    assert len(got) == 18
    r = got["ycx", 3]
    assert (r.kept, r.removed, r.redundant, r.unique_fails) == (1, 1, 2, 1)
    assert got["cxy", 1].good_lost == 1 and got["cxy", 1].removed == 1


def test_oracle(spark, duck, sf_dir):
    got = filteraudit.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).toPandas()
    assert rows_of(got) == rows_of(duck.execute(filteraudit.ORACLE).df())
