r"""Chat formatting by Spark expressions alone.

The turns of a conversation are collected as structs, sorted, merged where adjacent turns
have the same role, and concatenated:

    ### user: first text</turn>second text</turn>
    ### assistant: answer</turn>

One header opens a run of turns of one role, every turn's text ends with ``</turn>``, and
a line break follows the run.  Control strings in texts are escaped reversibly with a
backslash: ``\`` becomes ``\\``, ``###`` becomes ``\###`` and ``</turn>`` becomes
``<\/turn>``; in roles also ``:`` becomes ``\:``.  Dropping the backslash before every
escaped character gives the text back, so the conversation can be read from the output,
turn by turn, though runs are merged.  The loss mask is an array of spans, in code points
of the formatted text, that cover each assistant text and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

END = "</turn>"
OPEN = "### "
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("###"), F.lit("\\###"))
    return F.replace(out, F.lit(END), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_col, formatted string, loss_spans array<struct<start,length>>) of each conversation.

    Turns are sorted by turn, then role, then text (nulls first), so ties and repeated rows
    have one order; repeated rows are repeated turns.  Null texts and roles are empty ones.
    Rows with a null conversation id form one conversation of that id.  An empty table gives
    an empty result; other columns are not read.  ``start`` counts from 0.

    A conversation becomes one row of the output, so its turns meet in one task by the
    nature of the result; a conversation must fit a row.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chats = df.groupBy(F.col(conv_col).alias("_conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # each turn with whether it opens and whether it closes a run of its role
    marked = chats.select(
        "_conv",
        F.transform(
            "turns",
            lambda t, i: F.struct(
                F.when(i.eqNullSafe(0) | (t.getField("role") != F.get("turns", i - 1).getField("role")), F.concat(F.lit(OPEN), escape_role(t.getField("role")), F.lit(": "))).otherwise("").alias("head"),
                escape(t.getField("text")).alias("text"),
                F.when(F.get("turns", i + 1).isNull() | (t.getField("role") != F.get("turns", i + 1).getField("role")), F.lit(END + "\n")).otherwise(END).alias("tail"),
                (t.getField("role") == loss_role).alias("loss"),
            ),
        ).alias("parts"),
    )
    return marked.select(
        F.col("_conv").alias(conv_col),
        F.array_join(F.transform("parts", lambda p: F.concat(p.getField("head"), p.getField("text"), p.getField("tail"))), "").alias("formatted"),
        _let(F.transform("parts", lambda p: F.struct(*[F.length(p.getField(c)).cast("long").alias(c) for c in ("head", "text", "tail")], p.getField("loss").alias("loss"))), _spans).alias("loss_spans"),
    )


#: Turns whose spans are appended one by one; runs of so many turns are put together at once, so that time hardly grows faster than a conversation.
CHUNK = 64


def _let(value: Column, body) -> Column:
    """body(value) with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _chunks(items: Column) -> Column:
    """An array in runs of CHUNK; an empty one is one empty run."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(items) > 0, runs).otherwise(F.array(items))


def _spans(sizes: Column) -> Column:
    """Spans of the texts under the mask, from the lengths of heads, texts and tails."""
    long = lambda x: F.lit(x).cast("long")
    whole = lambda p: p.getField("head") + p.getField("text") + p.getField("tail")

    def step(acc, p):
        start = acc.getField("at") + p.getField("head")
        span = F.struct(start.alias("start"), p.getField("text").alias("length"))
        spans = F.when(p.getField("loss"), F.concat(acc.getField("spans"), F.array(span))).otherwise(acc.getField("spans"))
        return F.struct((acc.getField("at") + whole(p)).alias("at"), spans.alias("spans"))

    def inside(run, start):
        zero = F.struct(start.alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))
        return F.aggregate(run, zero, step, lambda acc: acc.getField("spans"))

    def put(runs):
        lengths = F.transform(runs, lambda run: F.aggregate(run, long(0), lambda n, p: n + whole(p)))
        zero = F.struct(long(0).alias("at"), F.expr("cast(array() as array<bigint>)").alias("all"))
        starts = F.aggregate(lengths, zero, lambda acc, n: F.struct((acc.getField("at") + n).alias("at"), F.concat(acc.getField("all"), F.array(acc.getField("at"))).alias("all")), lambda acc: acc.getField("all"))
        return _let(starts, lambda at: F.flatten(F.transform(runs, lambda run, i: inside(run, F.get(at, i)))))

    return _let(_chunks(sizes), put)


def read_turns(formatted: Column) -> Column:
    """The turns, array<struct<role,text>>, of a formatted conversation."""
    runs = F.split(formatted, r"(?<=</turn>)\n(?=### |$)")
    runs = F.filter(runs, lambda r: r != "")
    head = r"(?s)^### ((?:[^:\\]|\\.)*): "

    def turns(run):
        role = unescape(F.regexp_extract(run, head, 1))
        texts = F.split(F.regexp_replace(run, head, ""), END)
        texts = F.slice(texts, 1, F.size(texts) - 1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped: runs of spans are cut out first, spans from those."""
    end = lambda s: s.getField("start") + s.getField("length")

    def run_text(run):
        first = F.get(run, 0).getField("start")
        part = F.substring(formatted, (first + 1).cast("int"), (end(F.element_at(run, -1)) - first).cast("int"))
        return _let(part, lambda x: F.array_join(F.transform(run, lambda s: unescape(F.substring(x, (s.getField("start") - first + 1).cast("int"), s.getField("length").cast("int")))), ""))

    return F.when(F.size(spans) > 0, F.array_join(F.transform(_chunks(spans), run_text), "")).otherwise("")


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations, as digests."""
    out = formatted.select(conv_col, read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    each = F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n")))
    return out.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The conversation that the query adds: control strings in both roles' texts.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"

ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>') AS esc,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>'), ':', '\:') AS esc_role,
    CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS opens
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + 7 + opens * (4 + length(esc_role) + 2 + 1)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def with_extra(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
