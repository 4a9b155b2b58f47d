"""Language model, toxicity, URL filter."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import lm, toxicity as T, urlfilter as U


# -- language model --------------------------------------------------------------


def base_scores(rows):
    counts, toks = Counter(), []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b""]
        toks.append(w)
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    d = math.log10(n + 0.1 * (v + 1))
    return n, [(len(w), sum(counts[x] > 0 for x in w), sum(math.log10(counts[x] + 0.1) - d for x in w)) for w in toks]


def test_lm_against_brute_force_and_held_out(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):  # two kinds of texts, each with its own words in pairs
        kind = rng.choice("ab")
        rows.append((i, " ".join(f"{kind}{k} {kind}{k}x" for k in (rng.randrange(30) for _ in range(300)))))
    rows += [(1000, None), (1001, ""), (1002, "Ünseen\x0bWORDS\x1ctab É"), (None, "a1 a1x"), (3, "b1 b1x"), (1003, "a2 a2x " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'t' as token", "2 as c", "3 as score")
    for head in (65_536, 20):  # the tail's join must give what the head gives
        got = sorted(lm.score(df, head=head, growth=0.05).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
        n, want = base_scores(rows)
        order = sorted(range(len(rows)), key=lambda j: (rows[j][0] is None, rows[j][0] or 0, want[j][0]))
        assert [r.n_tokens for r in got] == [want[j][0] for j in order] and [r.n_known for r in got] == [want[j][1] for j in order]
        assert all(r.train_tokens == n for r in got)
        assert np.allclose([r.base_score for r in got], [want[j][2] for j in order])
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)
    got = lm.score(df).collect()
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)  # log probabilities: less far below zero
    assert lm.score(df.limit(0)).count() == 0


def test_lm_score_is_an_exact_softmax(spark):
    """Scores recomputed token by token from the trained parameters, each level summed over all its outcomes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40").select("doc_id", "text")
    docs = docs.withColumn("id", docs.doc_id).withColumn("training", lm.training_fold("id")).withColumn("ord", docs.doc_id).withColumn("text", docs.text.cast("binary"))
    counts = lm.count_tokens(docs.where("training").select("text"))
    stats = lm.gather(counts, growth=16.0)
    encoded = lm.encode(docs, stats).cache()
    model = lm.train(encoded, stats, lm.Scratch(spark))
    lay, coder = model.layout, lm.Coder(stats)
    assert lay.coarse > 1 and lay.fine > lay.coarse and all(np.abs(getattr(model, x)[:, :-1]).max() > 0.1 for x in "pfq")

    def row(code):
        rows, spelt, second = lay.rows_of(np.array([code]))
        return model.r[rows][0].astype(float) + (model.r[second][0] if len(spelt) else 0)

    def share(table, among, outcome, h):
        among = np.flatnonzero(among)
        each = np.exp(table[among, :-1].astype(float) @ h + table[among, -1])
        return each[among == outcome][0] / each.sum()

    text = docs.where("doc_id = 3").first().text
    words = [*lm.tokens(bytes(text))[:60], b"neverseenbefore", b""]
    codes = coder.encode(words)[1]
    got = model.log_probabilities(codes, np.array([0]))
    assert any(c >= lay.v for c in codes) and any(lay.singles <= c < lay.v for c in codes) and any(c < lay.singles for c in codes)
    before = [-1, -1, *codes]
    for i, c in enumerate(codes):
        h = row(before[i]) * model.ab[0] + row(before[i + 1]) * model.ab[1]
        p = share(model.p, np.ones(lay.outcomes), lay.outcome_of(np.array([c]))[0], h)
        if lay.singles <= c < lay.v:
            word = c - lay.singles
            fine = lay.fine_of[word]
            p *= share(model.f, lay.coarse_of == lay.coarse_of[fine], fine, h) * share(model.q, lay.fine_of == fine, word, h)
        assert got[i] == pytest.approx(math.log(p), abs=1e-4)
    encoded.unpersist()


def test_lm_forgets_rare_words():
    """What a coder says of a word does not depend on what it has met, nor on how often it has forgotten."""
    stats = lm.Statistics({b"": 3, b"a": 5, b"b": 4, b"c": 1}, 13, 4, [b"", b"a"])
    few, many = lm.Coder(stats, most=2), lm.Coder(stats)
    rng = random.Random(1)
    for _ in range(50):
        words = [rng.choice([b"a", b"b", b"c", b"", *(b"w%d" % i for i in range(9))]) for _ in range(12)]
        (p, c), (q, d) = few.encode(words), many.encode(words)
        assert (c == d).all() and [few.words[i] for i in p] == [many.words[i] for i in q] == words
        assert c.tolist() == [[b"", b"a"].index(w) if w in (b"", b"a") else 2 + lm.spelling(w) for w in words] and ((p < few.first_rare) == [w in stats.head for w in words]).all()
    assert len(few.words) < 30


def test_lm_shares_of_spelt_tokens(spark):
    """Words of a class of spelt tokens, and one unseen token, share its probability."""
    docs = spark.createDataFrame([(1, "a b c d e f g a b"), (2, "a h i")], "doc_id long, text string")
    stats = lm.gather(lm.count_tokens(docs.select(docs.text.cast("binary"))))
    spelt = [w for w in stats.head if w not in stats.words]
    for g in range(lm.GROUPS):
        c = [stats.head[w] for w in spelt if lm.group_of(lm.spelling(w)) == g]
        assert stats.group_total[g] == sum(c) and stats.group_distinct[g] == len(c)


def test_lm_gain_whatever_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    gains = []
    for n in (1, 8, 32):
        held = lm.score(docs.repartition(n)).where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b", "sum(n_tokens) as n").first()
        gains.append((held.s - held.b) / held.n)
    assert min(gains) > 0.25 and max(gains) - min(gains) < 0.01, gains


# -- toxicity ----------------------------------------------------------------------


def brute_kernel(s, t, decay=T.DECAY):
    def features(x):
        out = Counter()
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, len(x)):
                    out[x[i], x[j], x[k]] += decay ** (k - i + 1)
        return out

    a, b = features(s), features(t)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    n = math.sqrt(dot(a, a) * dot(b, b))
    return dot(a, b) / n if n else 0.0


def test_kernel():
    k = T.SubsequenceKernel()
    some = ["idiot", "idixot", "thione", "aaaa", "ab", "abcabcabcabcab", "éàü", "ünï", "идиот", "дурак", "слова", "چرند", "愚か者だ", "idiоt"]
    tables, rows = k.features(some)
    got = k.project(some, tables, rows)
    for i, s in enumerate(some):
        for j, t in enumerate(some):
            assert got[i, j] == pytest.approx(brute_kernel(s, t), abs=1e-3)
    cyrillic = ["идиот", "дурак", "слова", "чисто"]
    tables, rows = k.features(cyrillic)
    assert (k.project(cyrillic, tables, rows) - np.eye(4) < 0.05).all()


def test_strings():
    assert T.strings("I-D-I-O-T! you i d i o t.") == {"idiot", "you"} and T.strings(None) == T.strings(" .") == set()
    assert T.strings("i - d - i . o ! t") == {"idiot"} and T.strings("so, what - now") == {"so", "what", "now"}
    assert all(len(s) <= T.WINDOW for s in T.strings("x" * 100 + " " + "ab" * 50))
    rng = random.Random(1)
    for n in range(15, 60):  # whatever has up to WINDOW - STEP + 1 characters is whole in some window
        w = "".join(rng.choice("abcdef") for _ in range(n))
        got = T.strings(w)
        assert all(any(w[i : i + 13] in s for s in got) for i in range(n - 12))


def test_table_is_the_sum_over_landmarks(spark):
    """What the machine says is alpha times the kernel with each landmark, plus the bias."""
    rows = corpus(random.Random(4), 300)
    rows = [(i, t.replace("idiot", "идиот"), y) for i, t, y in rows]
    m = T.fit([t for _, t, _ in rows], [y for *_, y in rows])
    k = T.SubsequenceKernel()
    words = ["moron", "морон", "идиот", "stupid", "stxupid", "thering", "scumbag", "aaa", "ab"]
    want = [sum(a * brute_kernel(w, x) for a, x in zip(m.alphas, m.landmarks)) + m.bias for w in words]
    assert np.allclose(m.margins(k, words), want, atol=5e-2 * np.abs(m.alphas).max())
    exact = [w for w in words if w.isascii()]
    assert np.allclose(m.margins(k, exact), [x for x, w in zip(want, words) if w.isascii()], atol=1e-6 * np.abs(m.alphas).sum())


def test_scripts_are_told_apart(spark):
    """Insults in a script of their own, gapped or not, among clean words of the same letters and lengths."""
    rng = random.Random(5)
    clean = ["".join(rng.choice("идотурмнкаеслб") for _ in range(rng.choice([5, 6]))) for _ in range(200)]
    rows = []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(12)]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(12)] = rng.choice(["идиот", "дурак"])
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, "тут и-д-и-о-т"), (1001, "тут идихот"), (1002, clean[0])], "doc_id long, text string")
    got = {r.doc_id: r for r in T.judge(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert all(p == y for p, y in held) and len(held) > 100
    assert got[1000].predicted == 1 and got[1001].score > got[1002].score and got[1002].predicted == 0


def test_what_is_fitted_on_is_bounded(spark):
    """An id with very many rows and very long texts gives one text, or none."""
    rows = [(2, "some clean words here"), *[(3, f"you moron {i}") for i in range(500)], (5, "x " * 40_000)]
    labels = [(2, 0), (3, 1), (3, 0), (5, 1), (8, 1)]
    fitted = []
    keep, T.fit = T.fit, lambda texts, y: fitted.append((texts, y))
    try:
        T.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    finally:
        T.fit = keep
    texts, y = fitted[0]
    folds = [i for i in (2, 3) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(texts) == len(folds) and y == [int(i == 3) for i in folds]


def corpus(rng, n):
    syllables = ["the", "on", "er", "ing", "at", "re", "st", "an", "ou", "nd", "ly", "ha", "ea", "or", "ti"]
    bad = ["moron", "idiot", "stupid", "scumbag"]
    rows = []
    for i in range(n):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_held_out(spark):
    rows = corpus(random.Random(8), 900)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "null id"), (2000, None), (2001, ""), (2002, "fine " * 50_000), (2003, "you m.o.r.o.n"), (2003, "you m.o.r.o.n")], "doc_id long, text string")
    docs = docs.selectExpr("*", "'l' as label", "1 as score", "2 as id")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (5000, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = T.judge(docs, labels).collect()
    assert len(got) == len(rows) + 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    held = [(by[i].predicted, y) for i, _, y in rows if by[i].held_out]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows) and len(held) > 200
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    wrong = sum(p for p, y in held if not y) / sum(1 - y for _, y in held)
    assert caught > 0.9 and wrong < 0.03
    assert by[2003].predicted == 1 and by[2002].predicted == by[2000].predicted == by[2001].predicted == 0
    assert T.judge(docs.limit(0), labels).count() == 0
    assert all(r.score == pytest.approx(1e-6) for r in T.judge(docs.limit(5), labels.limit(0)).collect())


# -- URL filter ----------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "", "no scheme/en/", "HTTP://WWW.Example.COM/en/7?x#y", "http://a.com/en/1", "http://example.com/en/71", "http://b.example.com/en/8", "http://x.net/de/1", "http://example.net/de/8", "http://notexample.net/de/8", "http://org/es/", "http://com", "http://a.com?q=/en/", "http://a.com#/en/", "x://y://z/en/", "http://É.COM/en/", "http://casino-win.example.org/en/12", "http://a.org/es" + "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'h' as host", "'v' as verdict", "0 as score")
    got = {r.page_id: r for r in U.judge(df).collect()}
    assert [(got[i].host, got[i].path) for i in range(len(urls) - 1)] == [U.split_url(u) for u in urls[:-1]]
    assert [got[i].rule for i in range(len(urls))] == [None, None, None, "example.com/en/7", "com/en/", "example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "net/de/", "org/es/", None, None, None, None, "com/en/", None, None]
    assert [got[i].verdict for i in (3, 4, 7, 8, 10)] == ["allow", "block", "allow", "block", "block"]
    assert got[15].host == "É.com" and got[16].verdict == "block" and got[0].verdict == "allow"
    assert U.judge(df.limit(0)).count() == 0
    several = spark.createDataFrame([(None, "http://a.com/en/1"), (7, "http://a.com/en/1"), (7, "http://x.net/de/1"), (7, None)], "page_id long, url string")
    assert sorted((r.page_id or 0, r.verdict, r.rule or "") for r in U.judge(several).collect()) == [(0, "block", "com/en/"), (7, "allow", ""), (7, "allow", "net/de/"), (7, "block", "com/en/")]


RULES_SQL = r"""
WITH s AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages),
r AS (SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM s),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS n
  FROM h JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN fits ON fits.page_id = h.page_id AND n = 1
"""


def test_rules_against_sql(spark):
    """Host, path, rule and the verdicts of rules over the whole table of pages."""
    import duckdb

    con = duckdb.connect()
    con.execute("create view pages as select * from read_parquet('/root/testdata/sf0.01/pages.parquet')")
    want = {r[0]: r[1:] for r in con.execute(RULES_SQL).fetchall()}
    got = U.judge(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert {r.page_id: (r.host, r.path, r.rule) for r in got} == {i: w[:3] for i, w in want.items()}
    assert all(r.verdict == want[r.page_id][3] for r in got if r.rule) and len({r.rule for r in got}) > 3
    model = U.UrlModel()
    assert all(r.verdict == ("block" if model.score(r.host, r.path) >= 0.5 else "allow") for r in got if not r.rule)


def test_scores_of_a_batch_are_those_of_each(spark):
    rng = random.Random(2)
    m = U.UrlModel()
    hosts = ["", "a", "casino.example.com", "é.org", "x" * 3000] + ["".join(rng.choice("abcdef.-") for _ in range(rng.randrange(30))) for _ in range(200)]
    paths = ["".join(rng.choice("/abc0-é") for _ in range(rng.randrange(20))) for _ in hosts]
    assert np.allclose(m.scores(hosts, paths), [m.score(h, p) for h, p in zip(hosts, paths)], atol=1e-12)




def test_url_model_held_out():
    m = U.UrlModel()
    right = sum((m.score(*U.split_url(u)) >= 0.5) == bool(y) for u, y in U.LABELLED)
    assert right == len(U.LABELLED)
    other = [("https://casino-online.example.org/fr/4", 1), ("http://www.cheap-pills.example.com/en/77", 1), ("https://adult-x.example.net/de/1", 1), ("http://m.spam-farm.example.net/en/5", 1), ("https://ads-track.example.com/es/3", 1)]
    other += [(f"https://{h}.example.com/en/{i}", 0) for i, h in enumerate(["ththre", "tionsh", "blog.therin", "m.thonth", "www.enthes", "history", "forest", "planet"])]
    assert sum((m.score(*U.split_url(u)) >= 0.5) == bool(y) for u, y in other) >= len(other) - 1
