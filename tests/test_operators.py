"""Literal cases of the core operators."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import scalars as C
from quern.functions.vectors import cosine, hamming64
from quern.operators import dedupe, graph, ingest, rank, search, state, textfilter


# -- rankers ---------------------------------------------------------------------


def greedy(relevance, sim, k, value):
    """Row by row: the best by ``value(relevance, largest similarity to the chosen)``; ties go to the first."""
    chosen = [max(range(len(relevance)), key=lambda i: (relevance[i], -i))]
    while len(chosen) < min(k, len(relevance)):
        rest = [i for i in range(len(relevance)) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (value(relevance[i], max(sim[i][j] for j in chosen)), -i)))
    return chosen


@pytest.mark.parametrize("weight", [0.0, 0.3, 0.7, 1.0])
def test_mmr_is_greedy(weight):
    rng = np.random.default_rng(int(weight * 10))
    v, q = rng.normal(size=(30, 6)), rng.normal(size=6)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim, rel = u @ u.T, u @ q / np.linalg.norm(q)
    assert rank.mmr(v, q, 12, weight) == greedy(rel, sim, 12, lambda r, near: weight * r - (1 - weight) * near)
    assert rank.mmr_discover(rel, u, 12, weight) == greedy(rel, sim, 12, lambda r, near: r - weight * near)
    assert rank.mmr_discover(rel, u, 30, weight) == list(range(30))


def test_mmr_refuses():
    assert rank.mmr([(1, 0), (0, 1)], (1, 0), 0, 0.5) == [] and rank.mmr([], (1, 0), 3, 0.5) == []
    for bad in ([(1, 0)], (1, 0), 1, -0.2), ([(1, 0)], (1, 0), 1, 1.2), ([(1, 0), (1, 0, 0)], (1, 0), 1, 0.5), ([(math.nan, 0)], (1, 0), 1, 0.5), ([(1, 0)], (1, 0, 0), 1, 0.5):
        with pytest.raises(ValueError):
            rank.mmr(*bad)


def test_a_copy_waits_behind_something_new():
    east, near_east, north = (5.0, 0.2), (5.0, 0.3), (3.0, 4.0)
    assert rank.mmr([east, near_east, north], (1, 0), 3, 0.4) == [0, 2, 1]
    assert rank.mmr([east, near_east, north], (1, 0), 3, 1.0) == [0, 1, 2]


def brute_collapse(relevance, sha, bits, distance):
    def read(b):
        b = (b or "").strip().lower()
        return b if 1 <= len(b) <= 16 and set(b) <= set("0123456789abcdef") else None

    def linked(i, j):
        x, y = read(bits[i]), read(bits[j])
        return bool(sha[i] and sha[i] == sha[j]) or bool(x and y and len(x) == len(y) and bin(int(x, 16) ^ int(y, 16)).count("1") <= distance)

    group = list(range(len(relevance)))
    for _ in group:
        group = [min([group[i], *(group[j] for j in range(len(group)) if linked(i, j))]) for i in range(len(group))]
    return sorted(min((i for i in range(len(group)) if group[i] == g), key=lambda i: (-relevance[i], i)) for g in set(group))


def test_collapse_against_brute_force():
    rng = np.random.default_rng(9)
    for distance in (0, 2, 10, 40):
        base = [int(x) for x in rng.integers(0, 2**62, 6)]
        bits = [f"{base[int(rng.integers(6))] ^ sum(1 << int(i) for i in rng.integers(0, 64, int(rng.integers(0, 7)))):016x}" for _ in range(40)]
        bits += ["ff", "FF ", "0f", "f0", "0x1f", "0_1f", "+f", "-f", "", None, " ", "1" * 17, "zz", "f", "0"]
        sha = [["", None, "p", "q", "r"][int(rng.integers(5))] if rng.random() < 0.3 else None for _ in bits]
        relevance = rng.integers(0, 5, len(bits)).astype(float)
        assert rank.collapse(relevance, sha, bits, distance) == brute_collapse(relevance, sha, bits, distance)
    assert rank.collapse([], [], [], 3) == []


def test_rank_diverse_tiers_and_statistics():
    v = [(1, 0, 0), (0.999, 0.04, 0), (0, 1, 0)]
    order, stats = rank.rank_diverse(v, (1, 0, 0), strength=0.88)
    assert order == [0, 1, 2] and stats["groups"] == 2  # the last is out of reach of the best and comes last
    order, _ = rank.rank_diverse(v, (1, 0, 0), strength=0.88, drop=2.0)
    assert order == [0, 2, 1]
    order, stats = rank.rank_diverse(v, (1, 0, 0), strength=0.0)
    assert order == [0, 1, 2] and stats["groups"] == 3


def test_modes_and_depths():
    assert rank.resolve_mode(None, True) == ("balanced", 0.5)
    assert rank.resolve_mode("low", True) == ("low", 0.25)
    assert [rank.resolve_depth("auto", m)[1] for m in ("low", "balanced", "high", "off")] == [500, 1000, 2000, 0]
    assert rank.resolve_depth("5000", "low")[1] == 5000
    assert [round(rank.relevance_drop(m), 2) for m in ("low", "balanced", "high")] == [0.06, 0.10, 0.18]
    with pytest.raises(ValueError):
        rank.resolve_mode("wild")


# -- vectors ---------------------------------------------------------------------


def test_blend_weights():
    east, north = [2.0, 0.0], [0.0, 2.0]
    assert search.blend([east, north], [8, 15]) == pytest.approx([8 / 17, 15 / 17])
    assert search.blend([east, north, north], [2]) == pytest.approx([2**-0.5, 2**-0.5])  # missing weights are 1
    assert search.blend([east, north], [1, 1, 50]) == pytest.approx([2**-0.5, 2**-0.5])  # surplus ones do not count
    for vs, w in (([], None), ([east, [1.0]], None), ([east, north], [0, 0]), ([east, [-2.0, 0.0]], None)):
        with pytest.raises(ValueError):
            search.blend(vs, w)


def test_weights_and_pages():
    assert search.parse_weights([], 2) is None
    assert search.parse_weights(["2"], 3) == [2, 2, 2]
    for raw in (["1", "2"], ["x"], ["0"]):
        with pytest.raises(ValueError):
            search.parse_weights(raw, 3)
    assert search.Page(200, 4900).rows == 100 and search.Page(10, 5000).rows == 0
    for limit, offset in ((0, 0), (201, 0), (5, -1)):
        with pytest.raises(ValueError):
            search.Page(limit, offset)


def test_prompts():
    assert search.normalise_prompts(" q ", ["Cat", " cat ", "", "x" * 513], ["Dog", "dog"]) == (["Cat", "q"], ["Dog"])
    pos, neg = search.normalise_prompts("", [str(i) for i in range(15)], ["a", "b", "c"])
    assert len(pos) == 15 and neg == ["a"]


def test_zero_vectors_score_nothing(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0])], "id long, vector array<double>")
    top = lambda q: [(r.id, r.score) for r in search.top(search.scored(df.where("id < 4"), q), 5).collect()]
    assert top([0.0, 0.0]) == [(1, 0.0), (2, 0.0)] and top([2.0, 0.0]) == [(2, 1.0), (1, 0.0)]
    assert {r.id: r.score for r in search.scored(df, [1.0, 0.0]).collect()} == {1: 0.0, 2: 1.0, 4: None, 5: None}


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_scores_in_batches(spark, kind):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(500, 33)), rng.normal(size=33)
    x[250:] = x[:250]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], f"id long, vector {kind}")
    got = {r.id: r.score for r in search.scored(df, q).collect()}
    want = x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    assert np.allclose([got[i] for i in range(500)], want, atol=1e-6) and all(got[i] == got[i + 250] for i in range(250))


def test_pages_say_whether_there_is_more(spark):
    df = spark.createDataFrame([(i, 1.0 - i / 100) for i in range(25)], "id long, score double")
    page = lambda *a: [(r.id, r.has_more) for r in search.page(df, *a).collect()]
    assert page(search.Page(10, 10)) == [(i, True) for i in range(10, 20)] and page(search.Page(10, 20)) == [(i, False) for i in range(20, 25)]
    assert page(search.Page(5, 20)) == [(i, True) for i in range(20, 25)] and page(search.Page(5, 20), "next") == [(i, False) for i in range(20, 25)]
    assert page(search.Page(5, 19), "next") == [(i, True) for i in range(19, 24)] and page(search.Page(10, 30)) == []


def test_similar_needs_the_point(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    with pytest.raises(LookupError):
        search.similar_to(df, 9)


def test_search_without_copies(spark):
    """Three times a page is fetched, copies of seeds go, and what is dropped is told."""
    rng = np.random.default_rng(6)
    seeds = rng.normal(size=(8, 16)) * 0.4 + 1
    others = rng.normal(size=(60, 16)) * 0.5 + 1
    rows = [(i, v) for i, v in enumerate(seeds)] + [(100 + i, v * 2) for i, v in enumerate(seeds)] + [(200 + i, v) for i, v in enumerate(others)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vector array<double>")
    liked = df.where("id < 8")
    unit = {i: v / np.linalg.norm(v) for i, v in rows}
    s = np.array([unit[i] for i in range(8)])
    d = np.sort((1 - s @ s.T)[np.triu_indices(8, 1)])
    least = d[math.ceil(0.01 * len(d)) - 1]
    mean = seeds.mean(0)
    for limit, offset in ((5, 0), (20, 0), (20, 10), (40, 30)):
        order = sorted((i for i in unit if i >= 8), key=lambda i: (-(unit[i] @ mean), i))[offset : offset + 3 * limit]
        kept = [i for i in order if 1 - (s @ unit[i]).max() + 1e-9 >= least]
        got = search.search_without_copies(df, liked, search.Page(limit, offset)).collect()
        assert [r.id for r in got] == kept[:limit] and all(r.has_more == (len(kept) < len(order) or len(kept) >= limit) for r in got)
    assert search.search_without_copies(df, liked.limit(0), 5).count() == 0


def test_seeds_beyond_what_is_at_hand(spark, monkeypatch):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([rng.normal(size=(60, 8)), rng.normal(size=(60, 8))]))], "id long, vector array<double>")
    seeds, cand = df.where("id < 60"), df.where("id >= 50")
    least = search.near_dup_threshold(seeds).first()[0]
    want = {r.id for r in search.near_dup_filter(cand, seeds, 0.3).collect()}
    monkeypatch.setattr(search, "SEEDS_AT_HAND", 20)
    assert search.near_dup_threshold(seeds).first()[0] == pytest.approx(least)
    assert {r.id for r in search.near_dup_filter(cand, seeds, 0.3).collect()} == want and 0 < len(want) < 70


def test_near_duplicates_of_seeds(spark):
    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), 0.0]
    seeds = spark.createDataFrame([(1, at(30)), (2, at(33)), (3, at(80))], "id long, vector array<double>")
    assert search.near_dup_threshold(seeds).first()[0] == pytest.approx(1 - math.cos(math.radians(3)))
    cand = spark.createDataFrame([(4, at(31)), (5, at(36.1)), (6, at(82)), (7, [0.0, 0.0, 5.0]), (8, at(77)), (9, [0.0] * 3)], "id long, vector array<double>")
    kept = search.near_dup_filter(cand, seeds, search.near_dup_threshold(seeds))
    assert sorted(r.id for r in kept.collect()) == [5, 7, 8, 9]
    none = seeds.limit(0)
    assert search.near_dup_threshold(none).first()[0] == 0.0
    assert search.near_dup_filter(cand, none, search.near_dup_threshold(none)).count() == 6


def test_means(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0, 0.0]), (4, "b", [-1.0, 0.0])], "id long, g string, vector array<double>")
    out = {r.g: (r.n, r.centroid) for r in search.mean_vectors(df, ["g"]).collect()}
    assert set(out) == {"a"} and out["a"][0] == 2 and out["a"][1] == pytest.approx([0.5**0.5] * 2)


def test_sums_of_groups_large_and_small(spark):
    rng = np.random.default_rng(8)
    rows = [(int(g), f"k{g % 3}", float(w), [float(x) for x in v]) for g, w, v in zip(np.where(rng.random(3000) < 0.4, 7, rng.integers(0, 400, 3000)), rng.uniform(0.1, 2, 3000), rng.normal(size=(3000, 5)))]
    df = spark.createDataFrame([*rows, (7, "k1", 1.0, None), (7, "k1", 1.0, [1.0, None, 0.0, 0.0, 0.0])], "g long, k string, w double, vector array<double>").repartition(5)
    want = {}
    for g, k, w, v in rows:
        n, t, s = want.get((g, k), (0, 0.0, np.zeros(5)))
        want[g, k] = n + 1, t + w, s + w * np.array(v)
    got = {(r.g, r.k): r for r in search.sum_vectors(df, ["g", "k"], "w").collect()}
    assert set(got) == set(want) and all(got[x].n == n and got[x].w == pytest.approx(t) and np.allclose(got[x].s, s) for x, (n, t, s) in want.items())
    whole = search.sum_vectors(df).collect()
    assert len(whole) == 1 and whole[0].n == 3000 and np.allclose(whole[0].s, np.sum([v for *_, v in rows], 0))
    assert search.sum_vectors(df.limit(0), ["g"]).count() == 0 and search.mean_vectors(df.limit(0)).count() == 0


def test_recommended_direction(spark):
    df = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 4.0]), (3, [6.0, 0.0]), (4, None)], "id long, vector array<double>")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    target = lambda p, n: search.recommend_vector(df, ids(*p), ids(*n))
    assert target((1, 3, 3, 4), (2,)) == pytest.approx([2**-0.5, -(2**-0.5)])
    assert target((2,), (99,)) == pytest.approx([0, 1]) and target((99,), (2,)) == pytest.approx([0, -1])
    assert target((99,), (98,)) is None and target((1,), (1,)) is None


# -- duplicates --------------------------------------------------------------------


def test_components_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (300, None)]
    got = {r.node: r.label for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[200] == 200 and 300 not in got


def test_components_of_chains_in_any_order(spark):
    n = 120
    rng = np.random.default_rng(5)
    chains = [[0, *range(n - 1, 0, -1)], [1000 + int(i) for i in rng.permutation(n)], [2000 + i for i in range(n)], [3000 + i for i in range(n - 1, -1, -1)]]
    edges = [(a, b) for c in chains for a, b in zip(c, c[1:])]
    got = {r.node: r.label for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: min(c) for c in chains for i in c}


@pytest.mark.parametrize("distance", [0, 3, 10, 16])
def test_hamming_pairs_against_brute_force(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    h = [int(np.int64(b) ^ np.int64(sum((1 << int(i)) for i in rng.choice(62, rng.integers(0, 14), replace=False)))) for b in base.repeat(6)] + [-1, -1, 0, 0, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(h)] + [(999, None)], "id long, bits long")
    rows = dedupe.hamming_pairs(df, distance).collect()
    got, want = {(r.a, r.b): r.distance for r in rows}, {}
    for i in range(len(h)):
        for j in range(i + 1, len(h)):
            n = bin((h[i] ^ h[j]) & (2**64 - 1)).count("1")
            if n <= distance:
                want[i, j] = n
    assert got == want and len(rows) == len(want)


def test_duplicate_groups_by_width(spark):
    hashes = ["00ff", "00fe", " 00FF ", "1234567890abcdef", "1234567890abcdee", "ffff", "0x1f", None, "f", "0", "1234567890abcde"]
    sha = ["x", None, None, None, "y", "x", None, "y", None, None, None]
    df = spark.createDataFrame([(i, h, s) for i, (h, s) in enumerate(zip(hashes, sha))], "id long, text string, content_sha256 string")
    df = df.withColumn("h", dedupe.hex_hash(F.col("text"))).select("id", "content_sha256", "h.bits", "h.width")
    got = {r.id: r.group for r in dedupe.duplicate_groups(df, 4, width="width").collect()}
    # 0 and 5 have one content; 3 and 4, 4 and 7; hashes of one digit are all within four bits of each other
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 0, 6: 6, 7: 3, 8: 8, 9: 8, 10: 10}


def test_copies_give_as_many_links_as_members(spark):
    """A third of all rows with one hash: the candidates stay in proportion."""
    df = spark.createDataFrame([(i, 77 if i % 3 else i * 2**40, None) for i in range(900)], "id long, bits long, content_sha256 string")
    got = {r.id: r.group for r in dedupe.duplicate_groups(df, 2).collect()}
    assert {got[i] for i in range(900) if i % 3} == {1}


def test_hamming64(spark):
    df = spark.createDataFrame([("f" * 16, "0" * 16), ("8" + "0" * 15, "0" * 16), ("xyz", "0" * 16), ("ff", "0" * 16)], "a string, b string")
    assert [r[0] for r in df.select(hamming64(F.col("a"), F.col("b"))).collect()] == [64, 1, None, None]


# -- state -----------------------------------------------------------------------


def test_membership_keeps_the_first_time_since_removal(spark):
    log = spark.createDataFrame([(1, 7, 1, True), (1, 7, 5, True), (2, 7, 1, True), (2, 7, 2, False), (2, 7, 3, True), (2, 7, 4, True), (3, 7, 1, True), (3, 7, 2, False)], "album_id long, photo_id long, at long, added boolean")
    assert {(r.album_id, r.added_at) for r in state.memberships(log).collect()} == {(1, 1), (2, 3)}


def album_log(spark, rows):
    return spark.createDataFrame([(o, at, i, k, a, n, d, c) for i, (o, at, k, a, n, d, c) in enumerate(rows)], "owner long, at long, seq long, kind string, album_id long, name string, description string, cover string").withColumn("at", F.timestamp_seconds("at").cast("timestamp_ntz"))


def test_albums(spark):
    log = album_log(spark, [
        (1, 1, "create", 1, " sea ", "blue", None), (1, 2, "create", 2, "hills", None, None), (1, 3, "rename", 2, "sea", "x", None),  # taken: refused, and so is its description
        (1, 4, "create", 3, "  ", None, None), (1, 5, "create", 4, "x", None, None), (1, 6, "delete", 4, None, None, None), (1, 7, "rename", 4, "z", None, None),  # gone: nothing happens
        (1, 8, "create", 5, "y", "d", None), (1, 9, "cover", 5, None, None, "p7"), (1, 10, "rename", 5, "w", None, None), (1, 11, "create", 6, "y", None, None),  # the old name is free
        (1, 12, "delete", 6, None, None, None), (1, 13, "create", 6, "again", None, None), (1, 14, "create", 6, "twice", None, None),
        (2, 1, "create", 1, "sea", None, None), (2, 2, "rename", 1, "sea", "kept name", None), (2, 3, "cover", 1, None, None, "p1"), (2, 4, "cover", 1, None, None, None),
    ])
    albums = state.live_albums(log.repartition(3))
    got = {(r.owner, r.album_id): (r.name, r.description, r.cover, r.created_at.second, r.updated_at.second) for r in albums.collect()}
    assert got == {(1, 1): ("sea", "blue", "", 1, 1), (1, 2): ("hills", "", "", 2, 2), (1, 5): ("w", "d", "p7", 8, 10), (1, 6): ("again", "", "", 13, 13), (2, 1): ("sea", "kept name", "", 1, 4)}
    mine = albums.where("owner = 1")
    members = spark.createDataFrame([(1, 9, 2), (1, 8, 1), (4, 1, 1)], "album_id long, photo_id long, added_at long")
    assert {tuple(r) for r in state.album_list(mine, members).collect()} == {(1, "sea", 2, "8"), (2, "hills", 0, ""), (5, "w", 0, ""), (6, "again", 0, "")}
    assert state.cascade(members, mine).count() == 2
    assert state.live_albums(log.limit(0)).count() == 0


def test_saved_searches(spark):
    rows = [
        (1, 1, 0, "create", 1, " a ", ["cat ", " ", None], None), (1, 2, 1, "create", 2, "a", ["x"], []), (1, 3, 2, "create", 3, "b" * 81, ["x"], []), (1, 4, 3, "create", 4, "c", [" "], None),
        (1, 5, 4, "create", 5, "d" * 80, [], [" dog"]), (1, 6, 5, "delete", 1, None, None, None), (1, 7, 6, "create", 6, "a", ["y"], None), (1, 8, 7, "create", 7, " ", ["y"], None), (2, 1, 8, "create", 1, "a", ["z"], None),
    ]
    log = spark.createDataFrame(rows, "owner long, at long, seq long, kind string, saved_id long, name string, positives array<string>, negatives array<string>").withColumn("at", F.timestamp_seconds("at").cast("timestamp_ntz"))
    got = {(r.owner, r.saved_id): (r.name, r.positives, r.negatives, r.created_at.second) for r in state.live_searches(log).collect()}
    assert got == {(1, 5): ("d" * 80, [], ["dog"], 5), (1, 6): ("a", ["y"], [], 7), (2, 1): ("a", ["z"], [], 1)}


def test_reset(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (2, 1, "c"), (3, 2, "d")], "who long, at long, what string")
    resets = spark.createDataFrame([(1, 2), (1, 4), (3, 2)], "who long, at long")
    assert {r.what for r in state.after_reset(log, resets, "who").collect()} == {"b", "c"}


def test_marks_and_upserts(spark):
    log = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True), (2, 3, True), (3, 1, True)], "id long, at long, mark boolean")
    images = spark.createDataFrame([(1,), (2,)], "id long")
    assert {tuple(r) for r in state.marked(log, images=images).collect()} == {(2, 3)}
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, x string, v long")
    new = spark.createDataFrame([(2, "c", 2, 5), (3, "d", 1, None)], "id long, x string, v long, w long")
    assert {(r.id, r.x, r.w) for r in state.upsert(base, new, ["id"], "v").collect()} == {(1, "a", None), (2, "c", 5), (3, "d", None)}


# -- text filter -----------------------------------------------------------------


def test_patterns():
    P = textfilter.Pattern.parse
    assert P("  ") is None and P(None) is None
    assert P("Lake*") == textfilter.Pattern("lake", True) and P('"Zoë"') == textfilter.Pattern("zoe", False)
    for bad in ("*side", "blue lake", "a:b", "*", "x-y", "f(g)", "01.png", "o*p"):
        with pytest.raises(ValueError):
            P(bad)


def test_token_matches(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(["/trips/alps/lakeside/01.png", "/trips/lakeside_dawn.png", "/home/Zoë/1.png", "/scans/1998/barn.png"])], "id int, path string")
    ids = lambda p: [r.id for r in df.where(textfilter.matches(F.col("path"), textfilter.Pattern.parse(p))).orderBy("id").collect()]
    assert ids("lakeside") == [0, 1] and ids("lake*") == [0, 1] and ids("side") == [] and ids("zoe") == [2]
    assert ids("lakeside_dawn") == [1] and ids("lakeside_da*") == [1] and ids("lakeside_da") == []
    more = spark.createDataFrame([("/Ελλάδα/x",), ("/Łódź-Ёлка/x",), ("/e\u0301te\u0301/x",), ("/İzmir/x",)], "path string")
    assert [r[0][0] for r in more.select(textfilter.tokens(F.col("path"))).collect()][:3] == [textfilter.fold("Ελλάδα"), textfilter.fold("Łódź"), "ete"]
    assert textfilter.guarded(df, textfilter.Pattern.parse("png")).count() == 4
    assert textfilter.guarded(df, textfilter.Pattern.parse("1998")).count() == 1
    assert textfilter.guarded(df, textfilter.Pattern.parse("nothing")).count() == 0


# -- ingestion -------------------------------------------------------------------


def test_reconcile_and_plan(spark):
    files = spark.createDataFrame([("/r/a", 1, 1), ("/r/b", 1, 1), ("/r/c", None, 1), ("/r/n", 1, 1)], "path string, mtime long, size long")
    index = spark.createDataFrame([("1", "/r/a", 1, 1), ("2", "/r/b", None, 1), ("3", "/r/c", None, 1), ("4", "/r/o", 1, 1), ("5", "/x/o", 1, 1), ("6", None, 1, 1)], "id string, path string, mtime long, size long")
    got = {r.path: r.state for r in ingest.reconcile(files, index, "/R/").collect()}
    assert got == {"/r/a": "same", "/r/b": "modified", "/r/c": "same", "/r/n": "new", "/r/o": "orphan", "/x/o": "outside", None: "no_path"}
    plan = {r.path: r.reason for r in ingest.sync_plan(files, index).collect()}
    assert plan == {"/r/a": "skip", "/r/b": "changed", "/r/c": "changed", "/r/n": "new"}


def test_backfill_in_part(spark):
    stored = spark.createDataFrame([(i, f"c{i % 2}", None if i == 4 else i) for i in range(8)], "id long, collection string, size long")
    computed = spark.createDataFrame([(i, 3) for i in range(8)], "id long, size long")
    ids = lambda *a: [r.id for r in ingest.backfill(stored, computed, "id", ["size"], *a).collect()]
    assert sorted(ids()) == [0, 1, 2, 4, 5, 6, 7] and sorted(ids(["c1"])) == [1, 5, 7] and ids(["c0"], 2) == [0, 2]


def test_paths(spark):
    df = spark.createDataFrame([("C:\\Photos\\x\\1.JPG",), ("c:/photos/.hidden.jpg",), ("/Photos2/y.jpg",), ("/a/Thumbs.db",), (r"\\nas\images\A\B\c.png",), ("/images/a/b.jpg",)], "path string")
    p = F.col("path")
    rows = df.select(ingest.is_image(p), ingest.under_root(p, "c:/photos"), ingest.canonical_path(p, "C:/Photos", "//nas/p"), ingest.source_of_path(p)).collect()
    assert [r[0] for r in rows] == [True, False, True, False, True, True]
    assert [r[1] for r in rows] == [True, True, False, False, False, False]
    assert rows[0][2] == "//nas/p/x/1.JPG" and rows[2][2] == "/Photos2/y.jpg"
    assert [r[3] for r in rows] == [None, None, None, None, "A/B", None]


def test_scalars(spark):
    df = spark.createDataFrame([("s", "/photos/a b.jpg", " 12 ", "a b!c"), ("", "/é/x.PNG", "x", "!!!"), (None, "noext", "", "ok")], "shard string, path string, n string, name string")
    out = df.select(C.point_id(F.col("shard"), F.col("path")), C.content_type(F.col("path")), C.optional_int(F.col("n")), C.album_slug(F.col("name"), F.lit("7")), C.zip_entry(F.lit("a/b"), F.col("path"))).collect()
    assert [r[0] for r in out] == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{s}::{p}")) for s, p in (("s", "/photos/a b.jpg"), ("", "/é/x.PNG"), ("", "noext"))]
    assert [r[1] for r in out] == ["image/jpeg", "image/png", "application/octet-stream"]
    assert [r[2] for r in out] == [12, None, None] and [r[3] for r in out] == ["a-b-c", "7", "ok"] and out[0][4] == "a_b__a b.jpg"
    px = [9, 8, 7, 6, 5, 4, 3, 2, 1] * 8
    assert spark.range(1).select(C.dhash(F.array(*map(F.lit, px)))).first()[0] == "f" * 16


def test_cosine(spark):
    assert spark.range(1).select(cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0)))).first()[0] == pytest.approx(0.96)


# -- streams and sessions ----------------------------------------------------------


def test_feedback_stream(spark, tmp_path):
    from quern.streaming.feedback import maintain, read_state

    schema = "photo_id long, kind string, at timestamp_ntz"
    src, out = str(tmp_path / "in"), str(tmp_path / "state")
    log = lambda rows: spark.createDataFrame(rows, "photo_id long, kind string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    batches = [
        [(1, "like", "2024-01-01 00:00:00"), (2, "like", "2024-01-01 00:00:00"), *((i, "like", "2024-01-01 00:00:00") for i in range(100, 300))],
        [(1, "dislike", "2024-01-02 00:00:00"), (2, "dislike", "2023-01-01 00:00:00")], [(3, "like", "2024-01-01 00:00:00")], [(3, "dislike", "2024-01-01 00:00:00")],
    ]
    assert read_state(spark, out).count() == 0
    for rows in batches:
        log(rows).coalesce(1).write.mode("append").parquet(src)
        q = maintain(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp"))
        q.awaitTermination(60)
        got = {r.photo_id: r.kind for r in read_state(spark, out).collect()}
    assert {i: k for i, k in got.items() if i < 100} == {1: "dislike", 2: "like", 3: "like"} and len(got) == 203
    left = [p for p in (tmp_path / "state").glob("v=*/bucket=*")]
    assert len(left) <= 64 + 4 and len(list((tmp_path / "state").glob("state-*"))) == 2  # versions that no longer count are gone


def test_discovery_replays_alike():
    from quern.operators.discover import replay

    rng = np.random.default_rng(0)
    m, ids = rng.normal(size=(80, 8)), np.arange(80)
    a = replay("s", [i % 2 for i in range(20)], ids, m)
    assert a == replay("s", [i % 2 for i in range(20)], ids, m) and a != replay("t", [i % 2 for i in range(20)], ids, m)
    assert len(a) == 21 and [x[3] for x in a[:10]] == ["seed"] * 10 and {x[3] for x in a[10:]} == {"burst"}
    assert len({i for x in a for i in x[1:3]}) == 42


def test_replay_takes_all_picks_and_all_vectors(spark, tmp_path):
    from quern.plans import registry

    rng = np.random.default_rng(8)
    spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(2200)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(e, e % 40, e // 40) for e in range(40 * 30)], "event_id long, user_id long, ts long").write.parquet(f"{tmp_path}/events.parquet")
    rows = registry.queries()["discover_replay"](spark, str(tmp_path)).toPandas()
    assert rows.groupby("user_id").size().tolist() == [31] * 40
    # every id can be shown: of 2200 ids the first pairs are those of the least keys over all
    from quern.operators.discover import draw_keys

    first = rows[rows["round"] == 1].set_index("user_id")
    for u in range(40):
        keys = draw_keys(str(u), 0, np.arange(2200))
        assert [first.left_id[u], first.right_id[u]] == sorted(range(2200), key=lambda i: keys[i])[:2]


def brute_replay(session, sides, ids, m):
    """A session by its rules alone: ten rounds of draws, then bursts of five rounds out of ten diverse recommendations."""
    from quern.operators.discover import draw_keys

    unit = {int(i): v / np.linalg.norm(v) for i, v in zip(ids, m)}
    liked, passed, seen, queue, out = [], [], set(), [], []
    for n, side in enumerate([*sides, None]):
        draw = lambda some: sorted(some, key=lambda i: (int(draw_keys(session, n, np.array([i]))[0]), i))  # noqa: E731, B023
        pair, source = [], "seed"
        if n >= 10 and liked:
            source = "burst"
            if (n - 10) % 5 == 0 or len(queue) < 2:
                target = np.mean([unit[i] for i in liked], 0) - (np.mean([unit[i] for i in passed], 0) if passed else 0)
                best = sorted((i for i in unit if i not in seen), key=lambda i: (-float(unit[i] @ target), i))[:200]
                queue = []
                if len(best) <= 10:
                    queue = list(best)
                elif best:
                    queue = [best[0]]
                    while len(queue) < 10:
                        rest = [i for i in best if i not in queue]
                        queue.append(max(rest, key=lambda i: (round(float(unit[i] @ target) - 0.5 * max(float(unit[i] @ unit[j]) for j in queue), 12), -best.index(i))))
            fresh = [i for i in queue if i not in seen]
            if len(fresh) >= 2:
                third = len(fresh) // 3
                pair = [draw(fresh[:third])[0], draw(fresh[-third:])[0]] if third and 2 * third < len(fresh) else draw(fresh)[:2]
                queue = [i for i in queue if i not in pair]
        if len(pair) < 2:
            source = "seed" if source == "seed" else "fallback"
            pair = draw([i for i in unit if i not in seen] or list(unit))[:2]
        seen.update(pair)
        out.append((n + 1, *pair, source))
        if side is not None:
            liked.append(pair[side])
            passed.append(pair[1 - side])
    return out


@pytest.mark.parametrize("n", [300, 70])
def test_replay_against_brute_force(n):
    from quern.operators.discover import replay

    rng = np.random.default_rng(n)
    m, ids = rng.normal(size=(n, 6)), rng.permutation(1000)[:n]
    order = np.argsort(ids)
    m, ids = m[order], ids[order]
    for session in ("a", "b"):
        sides = [int(x) for x in rng.integers(0, 2, 36)]
        assert replay(session, sides, ids, m) == brute_replay(session, sides, ids, m)


def test_feed_collapses_copies(spark, tmp_path):
    from quern.fixtures import LIKER
    from quern.plans import registry

    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 64))
    # ids 40 to 79 have the texts of 0 to 39 under other vectors, 80 to 119 their directions; 120 is liked
    v = [*base, *rng.normal(size=(40, 64)), *(base * 1.01), base[0] + base[1]]
    spark.createDataFrame([(i, [float(y) for y in x], 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"text {i % 40 if i < 80 else i}", "en", "s", 6) for i in range(121)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, LIKER, "purchase", '{"k": 120}', 1)], "event_id long, user_id long, event_type string, props string, ts long").write.parquet(f"{tmp_path}/events.parquet")
    got = [r.id for r in registry.queries()["for_you_feed"](spark, str(tmp_path)).orderBy("position").collect()]
    assert len(got) == 30 and len({i % 40 for i in got}) == 30


@pytest.mark.parametrize("n", [1, 2, 9, 30, 700, 5000])
def test_sessions_side_by_side_read_the_library_for_many_at_once(n, monkeypatch):
    """As one by one: libraries that are used up, near and equal vectors, long and short sessions, more of them than play at once."""
    from quern.operators import discover
    from quern.operators.rank import unit_rows

    monkeypatch.setattr(discover, "AT_ONCE", 7)
    monkeypatch.setattr(discover, "KEYS", 64)
    monkeypatch.setattr(discover, "BLOCK", 3 * n)
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, 6))
    m[n // 2 :] = m[: n - n // 2] + rng.choice([0.0, 1e-9], size=(n - n // 2, 1))
    ids = rng.permutation(10 * n)[:n] - 2
    hand = discover.AtHand(np.sort(ids), unit_rows(m))
    asked = []
    monkeypatch.setattr(hand, "queues", lambda t, h, real=hand.queues: asked.append(len(t)) or real(t, h))
    sessions = [(k, f"s{k}", rng.integers(0, 2, [0, 1, 12, 40][k % 4])) for k in range(24)]
    got = dict(discover.play_many(sessions, hand))
    assert got == {k: discover.play(discover.Session(name), sides, hand)[0] for k, name, sides in sessions}
    assert n < 30 or len(asked) < sum(asked)


def test_many_draws_and_queues_are_those_of_one_at_a_time(monkeypatch):
    """Negative ids and large ones, keys spread unevenly, vectors that are not finite, many copies, targets without length and nearly all rows hidden."""
    from quern.operators import discover
    from quern.operators.rank import unit_rows

    monkeypatch.setattr(discover, "KEYS", 2048)
    monkeypatch.setattr(discover, "BLOCK", 40_000)
    monkeypatch.setattr(discover, "SIDE", 3)
    rng = np.random.default_rng(5)
    n = 9001
    m = rng.normal(size=(n, 7))
    m[1000:2200] = m[5]  # more copies than a pool holds
    m[7], m[8, 2] = 0, np.inf
    ids = np.sort(np.concatenate([-1 - np.arange(2000), 2**62 + np.arange(n - 2000)]))
    with np.errstate(invalid="ignore"):
        hand = discover.AtHand(ids, unit_rows(m))
    seeds, wanted = [discover.draw_seed("s", k) for k in range(40)], [1 + 3 * k for k in range(39)] + [n + 5]
    for seed, w, got in zip(seeds, wanted, hand.draws(seeds, wanted)):
        assert got == ids[np.lexsort((ids, discover.keys_by(np.uint64(seed), ids)))][:w].tolist()
    targets = rng.normal(size=(20, 7)) * rng.choice([1e-3, 1.0, 50.0], size=(20, 1))
    targets[0], targets[1], targets[2] = 0, m[5], np.nan
    hidden = [rng.permutation(n)[: [0, 30, 4000, n - 3, n - 150, n][k % 6]] for k in range(20)]
    got = hand.queues(targets, hidden)
    for target, rows, queue in zip(targets, hidden, got):
        assert queue == hand._queue(target, np.isin(np.arange(n), rows))
        assert int(ids[8]) not in queue
    assert {len(q) for q in got} == {0, 3, 10}


def test_bursts_of_many_sessions_are_not_played_round_by_round(monkeypatch):
    """Only seeding rounds are played one by one; sessions that end amid a burst show no more than they have picks for."""
    from quern.operators import discover
    from quern.operators.rank import unit_rows

    rng = np.random.default_rng(11)
    hand = discover.AtHand(np.arange(3000), unit_rows(rng.normal(size=(3000, 8))))
    sessions = [(k, f"s{k}", rng.integers(0, 2, 40 + k)) for k in range(12)]
    want = {k: discover.play(discover.Session(name), sides, hand)[0] for k, name, sides in sessions}
    calls = []
    monkeypatch.setattr(discover, "next_pair", lambda s, library, real=discover.next_pair: calls.append(s.round) or real(s, library))
    assert dict(discover.play_many(sessions, hand)) == want
    assert len(calls) == 12 * (discover.SEED_ROUNDS + 1) and max(calls) == discover.SEED_ROUNDS
