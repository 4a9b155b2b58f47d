"""Many queries at once, and sessions replayed through them, against brute force."""

import numpy as np
import pytest

from quern.operators import manyquery as Q, replays
from quern.operators.discover import draw_keys, draw_seed, replay


def points_of(spark, ids, m):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m)], "id long, vector array<double>")


@pytest.mark.parametrize("held, scores", [(4_000_000, 2_000_000), (300, 500)])
def test_top_many(spark, monkeypatch, held, scores):
    """Ties, exclusions, other dimensions and vectors that are none, in one block and in many small ones."""
    monkeypatch.setattr(Q, "HELD", held)
    monkeypatch.setattr(Q, "SCORES", scores)
    rng = np.random.default_rng(1)
    m = rng.integers(-2, 3, size=(400, 6)).astype(float)
    m[10] = 0
    ids = rng.permutation(5000)[:400]
    q = rng.integers(-1, 2, size=(17, 6)).astype(float)
    hidden = [rng.choice(ids, 30).tolist() + [-1] for _ in q]
    wanted = [int(x) for x in rng.integers(1, 40, 17)]
    odd = spark.createDataFrame([(9001, [1.0]), (9002, None), (None, [1.0] * 6), (9003, [float("nan")] * 6)], "id long, vector array<double>")
    queries = spark.createDataFrame([(k, v.tolist(), w, h if k % 3 else None) for k, (v, w, h) in enumerate(zip(q, wanted, hidden))] + [(99, None, 3, None)], "qid long, vector array<double>, wanted long, excluded array<long>")
    got = {}
    for r in Q.top_many(queries, points_of(spark, ids, m).union(odd).repartition(5)).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.score))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.where(n > 0, m / np.maximum(n, 1e-12), 0)
    for k in range(len(q)):
        score = np.round(unit @ q[k], 12)
        want = sorted(((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if not (k % 3 and i in hidden[k])))[: wanted[k]]
        assert [i for i, _ in got[k]] == [i for _, i in want] and np.allclose([s for _, s in got[k]], [-s for s, _ in want])
    assert 99 not in got
    assert Q.top_many(queries.limit(0), points_of(spark, ids, m)).count() == 0


def test_draw_many(spark, monkeypatch):
    monkeypatch.setattr(Q, "SCORES", 700)
    ids = np.random.default_rng(2).permutation(3000)[:500]
    draws = spark.createDataFrame([(k, int(np.uint64(draw_seed("s", k)).view(np.int64)), 1 + k) for k in range(9)], "qid long, seed long, wanted long")
    got = {}
    for r in Q.draw_many(draws, points_of(spark, ids, np.ones((500, 2)))).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    for k in range(9):
        keys = draw_keys("s", k, ids)
        assert got[k] == ids[np.lexsort((ids, keys))][: 1 + k].tolist()


@pytest.mark.parametrize("n, at_hand", [(1, 0), (7, 0), (30, 0), (260, 0), (1, 10**6), (260, 10**6)])
def test_sessions_like_a_replay_at_hand(spark, monkeypatch, n, at_hand):
    """Libraries too small for a pair, for a burst and for the seeding rounds, and one beyond a pool."""
    monkeypatch.setattr(replays, "LIBRARY_NUMBERS", at_hand)
    rng = np.random.default_rng(n)
    ids = np.sort(rng.permutation(1000)[:n])
    m = rng.normal(size=(n, 5))
    m[0] = 0
    sides = {u: [int(x) for x in rng.integers(0, 2, k)] for u, k in ((1, 0), (2, 3), (3, 12), (4, 23 if n > 30 else 15))}
    sessions = spark.createDataFrame([(u, f"u{u}", s) for u, s in sides.items()], "qid long, name string, sides array<int>")
    got = {}
    for r in replays.replay_all(sessions, points_of(spark, ids, m)).orderBy("qid", "round").collect():
        got.setdefault(r.qid, []).append((r.round, r.left_id, r.right_id, r.source))
    for u, s in sides.items():
        assert got[u] == replay(f"u{u}", s, ids, m)
    assert replays.replay_all(sessions, points_of(spark, ids, m).limit(0)).count() == 0
    assert replays.replay_all(sessions.limit(0), points_of(spark, ids, m)).count() == 0
    assert sessions.count() == len(got)


@pytest.mark.parametrize("kinds", [[], ["error"], ["error", "purchase"]])
def test_feed_starts_cold_without_likes(spark, tmp_path, kinds):
    """No events and dislikes alone give a cold feed: all but the disliked, spread out; a like makes it warm."""
    from quern.fixtures import LIKER
    from quern.plans import registry

    rng = np.random.default_rng(9)
    m = rng.normal(size=(200, 64))
    m[100:] = m[:100] + rng.normal(size=(100, 64)) * 0.001  # near copies, which are not shown twice
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    events = [(i, LIKER, kind, f'{{"k": {3 + i}}}', i) for i, kind in enumerate(kinds)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string, ts long").write.parquet(f"{tmp_path}/events.parquet")
    got = [r.id for r in registry.queries()["for_you_feed"](spark, str(tmp_path)).orderBy("position").collect()]
    marked = {3 + i for i in range(len(kinds))}
    assert len(got) == len(set(got)) == 30 and not marked & set(got)
    if "purchase" not in kinds:
        # the pool is the first 120 ids that are left; relevance is the same for all, so the first leads
        assert got[0] == min(set(range(200)) - marked) and max(got) <= 120 + len(kinds) and len({i % 100 for i in got}) == 30
        assert set(r.id for r in registry.queries()["for_you_sample"](spark, str(tmp_path)).collect()) <= set(range(200)) - marked
    else:
        assert 104 in got  # the near copy of what is liked
