import random

import numpy as np
import pytest

from quern.llm import minhash as M


def brute(texts, threshold=0.8, weighted=False):
    """Class of each text by comparing all pairs."""
    from collections import Counter

    s = M.Shingler()
    bags = [Counter(s.shingles(t).tolist()) if weighted else Counter(set(s.shingles(t).tolist())) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = bags[i], bags[j]
            whole = sum((a | b).values())
            if whole and sum((a & b).values()) / whole >= threshold:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice("xyz") + str(rng.randrange(10**6))
    return w


def classes(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.class_id, r.kept) for r in M.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("weighted", [False, True])
def test_against_brute_force(spark, weighted):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = words(rng, rng.choice([8, 40, 150]))
        texts += [" ".join(edited(rng, base, rng.randrange(0, 6))) for _ in range(rng.randrange(1, 9))]
    texts += [" ".join(words(rng, 50)) for _ in range(30)] + ["one two", "One, two!", "three"] + [texts[0]] * 3 + ["a b c d e f " * 9, "a b c d e f " * 10]
    want = brute(texts, weighted=weighted)
    got = classes(spark, list(enumerate(texts)), weighted=weighted)
    assert [got[i][0] for i in range(len(texts))] == want
    assert all(kept == (c == i) for i, (c, kept) in got.items())


def test_large_groups_lose_no_link(spark, monkeypatch):
    """A group of many near copies of which few pairs are linked: buckets far beyond the small ones."""
    rng = random.Random(7)
    base = words(rng, 150)
    texts = [" ".join(edited(rng, base, rng.choice([1, 2, 4, 6, 8]))) for _ in range(170)] + [" ".join(words(rng, 60)) for _ in range(20)]
    want = brute(texts)
    got = classes(spark, list(enumerate(texts)))
    assert [got[i][0] for i in range(len(texts))] == want


def test_open_nodes_of_large_buckets(spark, monkeypatch):
    """Buckets of several groups: rounds of leaders, blocks of signatures and blocks of texts find what brute force finds."""
    monkeypatch.setattr(M, "MANY", 4)
    monkeypatch.setattr(M, "LEADERS", 2)
    monkeypatch.setattr(M, "SIGNATURES", 16)
    monkeypatch.setattr(M, "BLOCK", 12)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 3000)
    asked, dense = [], []
    close, links = M._candidates, M._block_links
    monkeypatch.setattr(M, "_candidates", lambda state, *a: asked.append(state.where("open").count()) or close(state, *a))
    monkeypatch.setattr(M, "_block_links", lambda state, *a: dense.append(state.count()) or links(state, *a))
    rng = random.Random(12)
    base = words(rng, 220)
    texts = [" ".join(edited(rng, base, rng.choice([2, 5, 7, 9]))) for _ in range(200)]
    want = brute(texts)
    for peels, most in ((0, 1000), (3, 1000), (0, 0), (3, 0)):
        monkeypatch.setattr(M, "PEELS", peels)
        monkeypatch.setattr(M, "MOST_CANDIDATES", most)
        got = classes(spark, list(enumerate(texts)))
        assert [got[i][0] for i in range(len(texts))] == want
        assert bool(dense) == (most == 0)
    assert asked[1] <= asked[0] and len(set(want)) > 3


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " ... "), (4, "x y"), (4, "x y"), (5, "X, y"), (None, "x y"), (None, None), (7, "word " * 60_000), (8, "word " * 60_000)]
    got = classes(spark, rows)
    assert got[1] == (1, True) and got[2] == (2, True) and got[3] == (3, True)
    assert got[4] == (4, True) and got[5] == (4, False) and got[None] == (None, True)
    assert got[7] == (7, True) and got[8] == (7, False)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert M.near_duplicates(df).count() == len(rows)
    assert M.near_duplicates(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    extra = df.select("*", *[F.lit("z").alias(c) for c in ("node", "label", "h1", "key", "class_id", "kept")])
    assert M.near_duplicates(extra).count() == len(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    e = rng.integers(1, 2**63, 400).astype(np.uint64)
    w1, w2 = rng.uniform(0.2, 3, 300), None
    a, b = e[:300], e[100:]
    w2 = np.concatenate([w1[100:] * rng.uniform(0.5, 1.5, 200), rng.uniform(0.2, 3, 100)])
    both = dict(zip(a.tolist(), w1))
    top = sum(min(both[x], y) for x, y in zip(b.tolist(), w2) if x in both)
    want = top / (w1.sum() + w2.sum() - top)
    d = M.DartMinHash(k=2000)
    sig = d.signatures([a, b], [w1, w2])
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05
    assert (d.signatures([a, np.empty(0, np.uint64)])[1] == 0).all()
    # a document's signature does not depend on its company
    assert (d.signatures([a])[0] == d.signatures([b, a])[1]).all()


def test_signatures_of_the_query_are_weighted(spark, tmp_path, monkeypatch):
    """Shingles that say a word again weigh less, links are by sets: texts with one line said over and over are no copies."""
    from quern.llm import queries

    rng = random.Random(3)
    once, line = words(rng, 60), words(rng, 12)
    rows = [(1, " ".join(once)), (2, " ".join(once * 3)), (3, " ".join(once * 3 + once[:9])), *((10 + i, " ".join(line * 40 + words(rng, 30))) for i in range(5))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_id for r in queries.op1_minhash_dedup(spark, str(tmp_path)).collect()}
    want = brute([t for _, t in rows])
    assert [got[i] for i, _ in rows] == [rows[g][0] for g in want] and len(set(got.values())) == 6
    assert len(set(brute([t for _, t in rows], weighted=True)) & set(range(3, 8))) == 1  # by counts they would be
    made = M.Shingler()
    u, w = made.weighed("a b c d e a b c a a a a a")
    weights = dict(zip(u.tolist(), w.tolist()))
    of = lambda t: weights[made.shingles(t).item()]
    assert of("a b c d e") == 1 and of("a a a a a") == pytest.approx(M.LIGHTEST) and of("c d e a b") == 1 and of("e a b c a") == pytest.approx(1 - 0.1 / 10)
    assert made.weighed("x x")[1].tolist() == pytest.approx([M.LIGHTEST]) and made.weighed(None)[1].size == 0


def test_texts_said_many_times(spark, tmp_path):
    """A text and the same text said 2 to 256 times, some with an edit: no link by sets is lost, in the registered query."""
    from quern.llm import queries

    rng = random.Random(13)
    rows = []
    for g in range(120):
        base = words(rng, rng.choice([60, 100, 200]))
        times = 2 ** (1 + g % 8)
        again = base * times
        if g % 3 == 0:
            again[rng.randrange(len(base))] = "edited"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(again))]
    rows += [(1000 + i, " ".join([w] * n)) for i, (w, n) in enumerate([("na", 5), ("na", 500), ("ho", 6), ("ho", 40)])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_id for r in queries.op1_minhash_dedup(spark, str(tmp_path)).collect()}
    want = brute([t for _, t in rows])
    assert [got[i] for i, _ in rows] == [rows[g][0] for g in want]
    assert len(set(want)) < len(rows) - 110


def test_least_weighted_similarity():
    """The bound holds for any weights of shared and other shingles, and is met at its worst."""
    rng = np.random.default_rng(2)
    for _ in range(2000):
        common, rest = rng.integers(1, 50, 2)
        w = rng.uniform(M.LIGHTEST, 1, common + rest)
        assert w[:common].sum() / w.sum() >= M.least_weighted(common / (common + rest)) - 1e-12
    assert M.least_weighted(0.8) == pytest.approx(0.72 / 0.92)
    assert (1 - M.least_weighted(0.8) ** M.ROWS) ** M.BANDS < 5e-5


def test_recall_on_documents(spark):
    """Every pair of documents of the small table that is linked by brute force is in one class, and no other."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + i, t + " and a few more") for i, t in rows if t][:60]
    want = brute([t for _, t in rows])
    got = classes(spark, rows)
    first: dict = {}
    for (i, _), g in zip(rows, want):
        first[g] = min(i, first.get(g, i))
    assert all(got[i][0] == first[g] for (i, _), g in zip(rows, want)) and len(set(want)) < len(rows) - 40


def test_rows_of_one_id(spark):
    """A unique text is kept whatever copies share its id."""
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    df = spark.createDataFrame([(4, a), (5, a), (5, b)], "doc_id long, text string")
    got = {(r.doc_id, r.version): r.kept for r in M.near_duplicates(df).collect()}
    key = {r.text: r.v for r in df.select("text", M.version_of(df.text).alias("v")).collect()}
    assert got == {(4, key[a]): True, (5, key[a]): False, (5, key[b]): True}
