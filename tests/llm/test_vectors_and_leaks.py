"""Embedding near-duplicates, benchmark decontamination, and the pipeline."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from quern.llm import decontaminate as D, embedding as E


def brute(rows, threshold=0.9):
    """Links and component of each id by comparing all distinct (id, vector)."""
    good = list({(i, tuple(v)): None for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    label, links = {i: i for i, _ in rows if i is not None}, {i: 0 for i, _ in rows if i is not None}
    pairs = []
    for a in range(len(good)):
        for b in range(a):
            x, y = np.array(good[a][1]), np.array(good[b][1])
            if good[a][0] != good[b][0] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                pairs.append((good[a][0], good[b][0]))
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    while True:
        old = dict(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if old == label:
            return {i: (links[i], label[i]) for i in label}


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_embeddings_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 12)), 15, 0) + rng.normal(size=(600, 12)) * 0.4
    x = np.concatenate([x, np.repeat(rng.normal(size=(1, 12)), 60, 0) + rng.normal(size=(60, 12)) * 0.01, x[:3]])
    if kind == "array<float>":
        x = x.astype(np.float32).astype(float)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9000, None), (9001, [0.0] * 12), (9002, [math.nan] + [1.0] * 11), (9003, [1.0, 2.0]), (9004, [2.0, 4.0]), (9005, []), (9006, [None] + [1.0] * 11), (9007, [math.inf] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").selectExpr("*", "1 as id", "2 as cell", "3 as label")
    want = brute(rows)
    for options in ({}, {"block": 32, "cells": 9, "spread": None}, {"block": 64, "cells": 9}):
        got = E.near_duplicates(df, **options).collect()
        assert len(got) == len(rows)
        assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_repeated_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, [0.0, 1.0]), (2, [0.001, 1.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.1]), (4, [-2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in E.near_duplicates(df).collect()}
    assert got == {(1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True)}
    assert {(i, *v) for i, v in brute(rows).items()} == {r[:3] for r in got}


def linked(rng, n, cosine, dim=64):
    """n unit vectors and for each another one at exactly this cosine, in a random direction."""
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, dim))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * y


def test_recall_right_at_the_threshold(spark):
    """Vectors in no clusters, which cells suit least, in many cells: pairs at 0.9001 to 0.99, a dense group, against brute force."""
    rng = np.random.default_rng(2)
    pairs = [linked(rng, 700, c) for c in (0.9001, 0.93, 0.97, 0.99)]
    group = rng.normal(size=(1, 64)) + rng.normal(size=(600, 64)) * 0.08
    x = np.concatenate([v for p in pairs for v in p] + [group])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in E.near_duplicates(df, cells=64, block=256).collect()}
    assert all(got[i] <= near[i].sum() for i in got)
    found = sum(got.values())
    assert found >= 0.9995 * near.sum()
    assert sum(got[i] for i in range(1400)) >= 0.997 * near[:1400].sum()  # those at 0.9001
    sure = {r.vec_id: r.n_links for r in E.near_duplicates(df, cells=64, spread=None).collect()}
    assert all(sure[i] == near[i].sum() for i in sure)


def test_leaks(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 60)))) for i in range(30)]
    story = "then Alice bought 12 kg of apples for 30 dollars and Alice gave 7 kg to her friend Bob on that day"
    items += [(100, story), (101, ""), (102, None), (103, "short one"), (103, "short one"), (None, story)]
    docs, want = [], set()
    for d in range(120):
        w = [word() for _ in range(rng.randrange(20, 90))]
        if d % 3 == 0:
            i, t = items[rng.randrange(30)]
            w[5:5] = t.split()
            want.add((d, i))
        docs.append((d, " ".join(w)))
    docs += [
        (500, "so, " + story.replace("Alice", "Maria").replace("12", "99").replace(" 7 ", " 3 ") + ", end"),
        (501, "so, " + story.replace("Alice bought", "Maria bought").replace("Alice gave", "Eve gave").replace("12 kg", "9 kg").replace("7 kg", "9 miles").replace("30", "9")),
        (502, "A SHORT, one!"), (503, None), (504, ""), (505, "filler " * 40_000 + story), (505, story), (None, story), (506, story[: len(story) // 3]),
        (507, f"{D.NAME} {D.NUMBER} " * 30),
    ]
    want |= {(500, 100), (505, 100), (502, 103)}
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'i' as item_id", "'d' as doc", "1 as n", "2 as h")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as width", "0 as doc_id")
    got = D.find_contamination(df, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {r.doc_id: r.kind for r in got}[500] == "parameterised" and {r.doc_id: r.kind for r in got}[505] == "verbatim"
    plan = D.find_contamination(df, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    left = D.remove_contaminated(df, b)
    assert left.columns == df.columns and left.count() == len(docs) - len({d for d, _ in want}) - 2  # 505 twice, and the row without an id
    assert D.find_contamination(df.limit(0), b).count() == 0 and D.find_contamination(df, b.limit(0)).count() == 0


def found(spark, items, docs):
    rows = D.find_contamination(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r.kind for r in rows}


def test_leaks_with_names_at_the_start_and_in_other_cases(spark):
    tom = "Tom has 3 apples. Tom buys 4 more apples. How many apples does Tom have now?"
    maria = "Maria sold 48 clips to Peter in April and then Maria sold half as many clips to Peter in May"
    got = found(spark, [tom, "What is the capital city of France?", maria], [
        tom.replace("Tom", "Anna").replace("3", "8").replace("4", "2"), "She asked, What is the capital city of France?", maria.lower(), maria.upper(),
        "Anna has a cat. Anna buys more food for the cat in May", "What a city! Who is the mayor of Rome?",
    ])
    assert got == {(0, 0): "parameterised", (1, 1): "verbatim", (2, 2): "verbatim", (3, 2): "verbatim"}


def test_leaks_in_part_and_with_one_edit(spark):
    rng = random.Random(4)
    text = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    long, short, eight, book = text(57), text(15), text(8), text(300)
    around = lambda words: " ".join(text(20) + words + text(20))
    docs = [around(long[10:40]), around(short[:7] + text(1) + short[8:]), around(short[:7] + text(1) + short[7:]), around(eight[:4] + text(1) + eight[5:]), around(book[100:113]), around(book[100:112]), around(short[:4])]
    got = found(spark, [" ".join(x) for x in (long, short, eight, book)], docs)
    assert set(got) == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 3)}


def test_leaks_after_a_look_alike(spark):
    item = "then Alice bought 12 kg of apples for 30 dollars and Alice gave 7 kg to her friend Bob on that day"
    unlike = item.replace("Alice bought", "Maria bought").replace("Alice gave", "Eve gave").replace("12 kg", "9 kg").replace("7 kg", "9 miles").replace("30", "9")
    other = item.replace("Alice", "Maria").replace("12", "5").replace(" 7 ", " 6 ")
    few = "a box holds 3 red balls and a bag holds 4 green balls so how many balls are there in all"
    got = found(spark, [item, few], [
        f"{unlike}. Next: {item}", f"{unlike}. Next: {other}", item.replace("bought 12", "bought him 12"), other.replace("bought 5", "bought him 5"),
        few.replace("3", "5").replace("4", "5"), unlike,
    ])
    assert got == {(0, 0): "verbatim", (1, 0): "parameterised", (2, 0): "verbatim", (3, 0): "parameterised", (4, 1): "parameterised"}


def brute_leaks(items, docs):
    """The findings by comparing every window of every item with every window of every document."""
    word, units, numbers = re.compile(r"\d+(?:[.,]\d+)*|[A-Za-z-]+"), set(D.UNITS.split("|")), set(D.NUMBER_WORDS.split("|"))

    def typed(words):
        out = []
        for i, w in enumerate(words):
            low = w.lower()
            before = words[i - 1] if i else ""
            if w[0].isdigit() or low in numbers:
                out.append(D.NUMBER)
            elif low in units and (before[:1].isdigit() or before.lower() in numbers):
                out.append(D.UNIT)
            elif len(w) > 1 and w[0].isupper() and w[1].isalpha():
                out.append(D.NAME)
            else:
                out.append(low)
        return out

    def found(item, doc):
        iw, dw = word.findall(item), word.findall(doc)
        n = len(iw)
        if not n:
            return False
        width = n if n < D.WHOLE else min((n + 1) // 3, D.WINDOW)
        windows = n - width + 1
        lower_i, lower_d = [w.lower() for w in iw], [w.lower() for w in dw]
        for reading, (a, b) in enumerate(((lower_i, lower_d), (typed(iw), typed(dw)))):
            offsets = []
            for i in range(windows):
                part = a[i : i + width]
                literal = sum(w not in (D.NAME, D.NUMBER, D.UNIT) for w in part)
                if reading and literal < width and literal < max(1, width // 2):
                    continue
                offsets += [(d - i, i) for d in range(len(b) - width + 1) if b[d : d + width] == part]
            bins = {}
            for o, i in offsets:
                for key in ((0, o // (2 * D.DRIFT)), (1, (o + D.DRIFT) // (2 * D.DRIFT)), (2, o)):
                    bins.setdefault(key, {}).setdefault(o, set()).add(i)
            for lines in bins.values():
                best = {}
                for o, at in lines.items():
                    for i in at:
                        best[i] = max(best.get(i, (0, -(10**9))), (len(at), -o))
                run = max(max(sum(1 for _ in g) for _, g in itertools.groupby(sorted(at), key=lambda x, c=itertools.count(): x - next(c))) for at in lines.values())
                if not (len(best) >= D.COVERAGE * windows or run + width - 1 >= D.RUN):
                    continue
                literals = [i for i, w in enumerate(typed(iw)) if w not in (D.NAME, D.NUMBER, D.UNIT)]
                covered = sum(any(i <= x < i + width for i in best) for x in literals)
                if covered < min(D.LITERAL, (len(literals) + 1) // 2) or not literals and (reading or len(best) < windows):
                    continue
                if not reading:
                    return True
                pairs = []
                for s in [i for i, w in enumerate(typed(iw)) if w in (D.NAME, D.NUMBER, D.UNIT)]:
                    over = [i for i in sorted(best) if i <= s < i + width]
                    if over and 0 <= s - best[over[0]][1] < len(dw):
                        pairs.append((lower_i[s], lower_d[s - best[over[0]][1]]))
                maps = set(pairs)
                sides = len({x for x, _ in maps}) + len({y for _, y in maps})
                if all(x == y for x, y in pairs) or 2 * len(maps) - sides <= 1 or sides >= D.CONSISTENT * 2 * len(maps):
                    return True
        return False

    return {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if found(item, doc)}


def test_numbers_are_no_leaks(spark):
    """Tables, dates and price lists next to questions with many numbers, against brute force and by hand."""
    rng = random.Random(14)
    n = lambda k=100: str(rng.randrange(1, k))
    items = [
        "Add 1 2 3 4 5 6 7 8 now",
        "What is the sum of 12 15 18 21 24 27 30 33 36 39",
        "Sort the list 9 4 7 1 8 2 and name the 3 largest values in it",
        "On 3 May 2019 Ann paid 4 euros and 50 cents for 2 kg of rice, on 7 May 2019 she paid 5 euros. How much more was it?",
        "1 2 3 4 5 6 7 8 9 10 11 12 13 14",
        "12 kg 15 kg 20 kg",
    ]
    docs = ["table 5 6 7 8 9 1 2 3", " ".join(map(str, range(1, 500))), "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "she said: Add 1 2 3 4 5 6 7 8 now", "Add 5 2 9 4 5 6 7 1 now", "so Sort the list 3 5 6 2 9 1 and name the 4 largest values in it"]
    docs += [" ".join(n() for _ in range(200)) for _ in range(10)]  # tables
    docs += [" ".join(f"{n(28)} May {2000 + rng.randrange(30)} {n()} euros and {n()} cents" for _ in range(40)) for _ in range(10)]  # dates and prices
    docs += [" ".join(f"{rng.choice(['rice', 'tea', 'salt'])} {n()} kg {n()}.{n()} dollars" for _ in range(60)) for _ in range(10)]
    docs += ["\n".join(f"Item {i} {n()} {n()} {n()} Total {n()} kg" for i in range(50)) for _ in range(5)]
    got = found(spark, items, docs)
    assert set(got) == brute_leaks(items, docs)
    assert got == {(2, 4): "verbatim", (3, 0): "verbatim", (5, 2): "parameterised", (1, 4): "verbatim"} | {k: v for k, v in got.items() if k == (4, 0)}


def test_long_documents_with_many_places(spark):
    """A worksheet of thousands of look-alikes with a copy far behind: places are judged stretch by stretch."""
    item = "then Alice bought 12 kg of apples for 30 dollars and Alice gave 7 kg to her friend Bob on that day"
    unlike = item.replace("Alice bought", "Maria bought").replace("Alice gave", "Eve gave").replace("12 kg", "9 kg").replace("7 kg", "9 miles").replace("30", "9")
    other = item.replace("Alice", "Maria").replace("12", "5").replace(" 7 ", " 6 ")
    sheet = (unlike + ". ") * 3000
    assert found(spark, [item], [sheet, sheet + item, other + ". " + sheet, sheet + other + ". " + sheet + item]) == {(1, 0): "verbatim", (2, 0): "parameterised", (3, 0): "verbatim"}


def test_leaks_against_brute_force(spark):
    """Questions of one mould with other names, numbers and units, edited, cut, in part and side by side."""
    rng = random.Random(11)
    names, things, units = ["Tom", "Ann", "Bob", "Eve", "Kim"], ["apples", "pens", "cars", "cups"], ["kg", "miles", "hours", "days"]

    def question(kind):
        a, b = rng.sample(names, 2)
        x, y, z = (str(rng.randrange(2, 60)) if rng.random() < 0.8 else rng.choice(["two", "seven", "Twelve"]) for _ in range(3))
        return [
            f"{a} has {x} {rng.choice(things)}. {a} buys {y} more and gives {z} to {b}. How many does {a} have now?",
            f"a train goes {x} {rng.choice(units)} and then {y} {rng.choice(units)} with {a} on board how far is it in all for {a} and {b}",
            f"{a} and {b} share {x}{rng.choice(units)} of rice",
            " ".join(rng.choice(["red", "blue", "green", "old", "new", "Big"]) for _ in range(rng.randrange(1, 40))),
        ][kind]

    items = [question(rng.randrange(4)) for _ in range(25)]
    docs = []
    for _ in range(260):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            t = (rng.choice(items) if rng.random() < 0.4 else question(rng.randrange(4))).split()
            if rng.random() < 0.3:
                t[rng.randrange(len(t))] = rng.choice(["word", "9", "Zoe"])
            if rng.random() < 0.2:
                t.insert(rng.randrange(len(t)), "extra")
            if rng.random() < 0.2:
                t = t[rng.randrange(len(t)) :] or t
            parts += t + ["and", "so"] * rng.randrange(3)
        docs.append(" ".join(parts))
    want, got = brute_leaks(items, docs), set(found(spark, items, docs))
    assert got == want, (sorted(got - want)[:3], sorted(want - got)[:3])
    assert 200 < len(want) < 0.5 * len(items) * len(docs)


def test_pipeline(spark, sf_dir):
    """Each stage against its operator, on its predecessor's rows; the rest of the columns untouched."""
    import corpus_pipeline as P
    from quern.llm import bpe, minhash, toxicity
    import public_tokenizers

    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = read("documents").cache()
    a = P.drop_toxic(spark, docs, sf_dir).cache()
    toxic = {r.doc_id for r in toxicity.judge(docs, read("labels")).collect() if r.predicted}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert a.columns == docs.columns and ids(a) == ids(docs) - toxic and len(toxic) < 40
    b = P.drop_near_duplicates(spark, a, sf_dir).cache()
    assert ids(b) == {r.doc_id for r in minhash.near_duplicates(a).collect() if r.kept} and b.columns == docs.columns
    c = P.drop_contaminated(spark, b, sf_dir).cache()
    assert ids(c) == ids(b) - {r.doc_id for r in D.find_contamination(b, read("benchmark")).collect()} and c.columns == docs.columns
    d = P.encode(spark, c, sf_dir).collect()
    assert {(r.doc_id, r.ids_sha256) for r in d} == {(r.doc_id, r.ids_sha256) for r in bpe.digests(c, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "bpe"]


def test_pipeline_cases(spark, tmp_path):
    """Null ids and texts, ids with several texts, clashing columns and empty tables through all stages."""
    import corpus_pipeline as P
    from test_text_models import corpus

    rng = random.Random(8)
    labelled = corpus(rng, 600)
    long = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    a, b, c, item, big = long(40), long(40), long(40), long(30), " ".join(t for _, t, y in labelled if not y) * 3
    rows = [(4000, a), (5000, a), (5000, b), (6000, None), (6001, ""), (None, c), (None, None), (7000, "you moron"), (7000, c + " only here"), (8000, "so " + item + " it ends"), (8000, long(50)), (None, item), (9000, big), (9000, big), (9001, big)]
    docs = spark.createDataFrame([r[:2] for r in labelled] + rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1 as n_chars", "'x' as _id", "2 as _version", "3 as _key", "4 as _found", "0.5 as score", "5 as kept", "6 as node")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in labelled] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, c)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = lambda df: sorted((str(r.doc_id), str(r.text)[:20]) for r in df.where("doc_id is null or doc_id >= 4000").collect())
    shown = lambda some: sorted((str(i), str(t)[:20]) for i, t in some)
    one = P.drop_toxic(spark, docs, sf)
    left = [r for r in rows if r != (7000, "you moron")]
    assert own(one) == shown(left) and one.columns == docs.columns
    two = P.drop_near_duplicates(spark, one, sf)
    left = [r for r in left if r not in ((5000, a), (9001, big))]
    assert own(two) == shown(left) and two.columns == docs.columns
    three = P.drop_contaminated(spark, two, sf)
    left = [r for r in left if not (r[1] and item in r[1])]
    assert own(three) == shown(left) and three.columns == docs.columns
    four = P.encode(spark, three, sf)
    assert four.count() == three.count() and {r.n_tokens for r in four.where("doc_id in (6000, 6001)").collect()} == {0}
    assert sorted(P.run(spark, sf).select("ids_sha256").collect()) == sorted(four.select("ids_sha256").collect())
    docs.limit(0).write.parquet(f"{sf}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{sf}/none/{t}.parquet")
    assert P.run(spark, f"{sf}/none").count() == 0
