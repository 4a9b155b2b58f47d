import random
import zlib

import numpy as np
import pytest
from conftest import rows_of

from quern.llm import quarantine


def crc(x):
    return zlib.crc32(x.encode())


def naive(rows):
    """Turn by turn, attempt by attempt; rows are (conv, turn, text)."""
    turns = {}
    for c, t, text in rows:
        x = crc(text or "")
        old = turns.setdefault((c, t), [x, 0])
        old[0], old[1] = min(old[0], x), old[1] + 1
    out = []
    for conv in {c for c, _ in turns}:
        mine = sorted((t for c, t in turns if c == conv), key=lambda t: (t is not None, t))
        done = []
        for p, t in enumerate(mine):
            h = lambda k: crc(f"{k}:{'' if conv is None else conv}:{'' if t is None else t}")  # noqa: B023, E731
            back, at = h(0) % 5, 7 * p
            if back and back <= p:
                status, *_, last = done[p - back]
                if status != "delivered":
                    done.append(("blocked", 0, None, None))
                    continue
                at = max(at, last)
            first, faulty = at, h(1) % 101 < 50
            for a in range(1, 7):
                if not (faulty and (at < 7 * p + h(2) % 101 or h(a + 2) % 3 == 0)):
                    done.append(("delivered", a, first, at))
                    break
                last, at = at, at + 20 * 2 ** (a - 1)
            else:
                done.append(("dead", 6, first, last))
        state = 0
        order = {p: i + 1 for i, p in enumerate(sorted((p for p, d in enumerate(done) if d[0] == "delivered"), key=lambda p: (done[p][3], p)))}
        states = {}
        for p in sorted(order, key=order.get):
            state += order[p] * turns[conv, mine[p]][0]
            states[p] = (state + 2**63) % 2**64 - 2**63
        for p, t in enumerate(mine):
            out += [(conv, t, *done[p], order.get(p), states.get(p))] * turns[conv, t][1]
    return sorted(out, key=str)


def test_closed_form():
    """Every waiting time and every mask against trying."""
    waits, fails = (x.reshape(-1) for x in np.meshgrid(np.arange(-5, 102), np.arange(64)))
    got = quarantine.attempts_until_delivery(waits, fails)
    for w, f, g in zip(waits.tolist(), fails.tolist(), got.tolist()):
        want = next((a for a in range(1, 7) if 20 * (2 ** (a - 1) - 1) >= w and not f >> (a - 1) & 1), 7)
        assert g == want or (g > 6 and want == 7)


@pytest.mark.parametrize("fan", [4, 16, 1024])
def test_replay(spark, fan):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["", None, "text", "é🙂", "x" * 50])) for c in range(40) for t in range(rng.randrange(1, 30))]
    rows += [(100, t, "long") for t in range({4: 60, 16: 500}.get(fan, 3000))] + [(101, t * fan * 3, "sparse") for t in range(-15, 15)] + [(102, -(2**63), "least"), (102, 2**63 - 1, "most")] * (fan == 1024)
    rows += [(None, t, "null") for t in range(10)] + [(103, None, "before"), (103, 0, "after"), (103, 0, "after"), (103, 0, None)] + [(104, 5, "again")] * 50
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "'a' as conv", "1 as p", "2 as n", "'b' as status", "3 as block")
    got = quarantine.replay(df.repartition(5), fan=fan)
    assert got.columns == ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]
    assert sorted(map(tuple, got.collect()), key=str) == naive(rows)


def test_short_conversations_and_empty_tables(spark):
    rows = [(c, t, f"{c}.{t}") for c in range(300) for t in range(c % 9)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn int, text string")
    got = quarantine.replay(df).collect()
    assert sorted(map(tuple, got), key=str) == naive(rows)
    assert {r.status for r in got} == {"delivered", "dead", "blocked"}
    assert quarantine.replay(df.limit(0)).count() == 0
    assert quarantine.replay(df.where("conv_id is null")).count() == 3


def test_sums_wrap(spark):
    """A state beyond 64 bits, put together from blocks."""
    rows = [(1, t, "a") for t in range(130_000)]
    got = quarantine.replay(spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    last = got.orderBy("release_no", ascending=False).first()
    n = last.release_no
    assert last.state == (n * (n + 1) // 2 * crc("a") + 2**63) % 2**64 - 2**63 and n * (n + 1) // 2 * crc("a") > 2**63


def test_oracle(spark, duck, sf_dir):
    got = quarantine.replay(spark.read.parquet(f"{sf_dir}/conversations.parquet")).toPandas()
    want = duck.execute(quarantine.ORACLE).df()
    whole = {c: "Int64" for c in ("first_at", "last_at", "release_no", "state")}
    assert rows_of(got.astype(whole)) == rows_of(want.astype(whole))
