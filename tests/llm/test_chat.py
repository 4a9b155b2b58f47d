import hashlib
import random

from conftest import rows_of
from quern.llm import chat
from pyspark.sql import functions as F


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip(spark):
    rng = random.Random(3)
    pieces = ["\\", "###", "#", "####", "</turn>", "<\\/turn>", "</turn", ">", ": ", "### user: ", "\n", "\n### assistant: ", "é🙂", "text", " ", "\\#", "\\\\"]
    roles = ["user", "assistant", "system", "a:b", "### x", "", "assistant", "Assistant", "</turn>"]
    rows = [(c, t, rng.choice(roles), "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 9)))) for c in range(120) for t in range(rng.randrange(1, 7))]
    rows += [(900, 0, None, None), (900, 1, "assistant", None), (None, 0, "user", "x"), (901, 1, "user", "same"), (901, 1, "user", "same"), (902, None, "assistant", "z" * 300_000), (902, 2, "assistant", "end")]
    rows += [(903, t, rng.choice(roles), rng.choice(pieces) * rng.randrange(3)) for t in range(1500)] + [(904, t, "assistant", "a") for t in range(64)] + [(905, t, "user", "a") for t in range(65)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "'q' as formatted", "2 as parts")
    f = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(f).collect()}
    texts = {r.conv_id: r for r in f.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), "formatted", "loss_spans").collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        assert [tuple(x) for x in texts[c].t] == turns
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
        assert g.formatted_chars == len(texts[c].formatted) and len(texts[c].loss_spans) == sum(r == "assistant" for r, _ in turns)
    assert texts[901].formatted == "### user: same</turn>same</turn>\n"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_oracle_and_plan(spark, duck, sf_dir):
    df = chat.digests(chat.format_conversations(chat.with_extra(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    assert rows_of(df.toPandas()) == rows_of(duck.execute(chat.ORACLE).df())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
