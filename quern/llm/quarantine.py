"""Replay of a quarantine: faulty turns are retried, and deliveries release what waits for them.

Turn p of a conversation arrives at second ``7 * p`` and may wait for one of the few turns
before it.  Its attempts follow a fixed schedule, so how often it is tried has a closed form:

* attempt a comes ``20 * (2 ** (a - 1) - 1)`` seconds after the first, hence the first one at or
  after the repair is one more than the integer logarithm (bit length) of the waiting time in
  units of 20 seconds, rounded up;
* which of the attempts fail by chance is a bit mask; shifted by the attempts before the
  repair, its lowest zero, found from the trailing zeros of its complement, is the one that delivers.

Turns are evaluated in topological order, a whole depth at a time over all conversations of a
batch.  Nothing needs a conversation in one task: turns are numbered by a tree of counts over
blocks of turn numbers, chunks of ``fan`` turns are evaluated independently, turns whose
ancestors lie in an earlier chunk are evaluated again with the last turns of that chunk, and
releases are numbered and summed up by the same tree over blocks of time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.scratch import Scratch

#: Seconds between arrivals; unit of the waiting times; attempts; how far back a parent may be.
EVERY, UNIT, ATTEMPTS, BACK = 7, 20, 6, 4
#: Turns of a chunk and of a block, and children of a node of the tree of counts (a power of two).
FAN = 1024
#: Repeats of a turn that are made at once.
REPEATS = 100_000
OPEN, DELIVERED, DEAD, BLOCKED = 0, 1, 2, 3
NAMES = ["open", "delivered", "dead", "blocked"]
WIDE = "decimal(38,0)"


def attempts_until_delivery(waits: np.ndarray, fails: np.ndarray) -> np.ndarray:
    """The attempt that delivers, or a number above ATTEMPTS.

    ``waits`` are the seconds from the first attempt to the repair (0 or less: repaired);
    bit a - 1 of ``fails`` says that attempt a fails even if repaired.
    """
    units = (np.maximum(waits, 0) + UNIT - 1) // UNIT
    before = np.frexp(units.astype(np.float64))[1].astype(np.int64)  # bit length: attempts before the repair
    good = ~(fails.astype(np.int64) >> before)
    return before + np.frexp((good & -good).astype(np.float64))[1]  # one more than the trailing zeros


def evaluate(group: np.ndarray, at: np.ndarray, p: np.ndarray, back: np.ndarray, repair: np.ndarray, fails: np.ndarray, known: np.ndarray, delivered: np.ndarray) -> tuple[np.ndarray, ...]:
    """status, attempts, first_at, last_at of turns, evaluated depth by depth.

    Turns are sorted by group and by ``at``, their place in it (from 0; the turns of a group
    need not be all there).  ``known`` turns have a status already, and come with the second
    of their delivery in ``delivered`` (below 0: none).  A turn whose parent is not here, or
    is not evaluated, stays open.
    """
    n, width = len(p), int(at.max(initial=0)) + 1
    key = group * width + at
    wants = (back > 0) & (back <= p)
    parent = np.minimum(np.searchsorted(key, key - back), max(n - 1, 0))
    here = wants & (back <= at) & (key[parent] == key - back)
    status, tries, first, last = np.where(known, DELIVERED, OPEN), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.where(known, delivered, -1)
    arrival = EVERY * p
    ready = np.flatnonzero((~wants | (here & known[parent])) & ~known)
    waiting = np.flatnonzero(here & ~known & ~known[parent])
    while len(ready):
        of = parent[ready]
        child = wants[ready]
        blocked = child & (last[of] < 0)
        start = np.maximum(arrival[ready], np.where(child, last[of], 0))
        needed = attempts_until_delivery(arrival[ready] + repair[ready] - start, fails[ready])
        done = np.minimum(needed, ATTEMPTS)
        status[ready] = np.where(blocked, BLOCKED, np.where(needed > ATTEMPTS, DEAD, DELIVERED))
        tries[ready] = np.where(blocked, 0, done)
        first[ready] = np.where(blocked, -1, start)
        # until all are evaluated, last is the second of the delivery; a dead turn has none
        last[ready] = np.where(status[ready] == DELIVERED, start + UNIT * ((1 << (done - 1)) - 1), -1)
        now = status[parent[waiting]] != OPEN
        ready, waiting = waiting[now], waiting[~now]
    dead = status == DEAD
    last[dead] = first[dead] + UNIT * ((1 << (ATTEMPTS - 1)) - 1)
    return status, tries, first, last


_IN = ["conv", "turn", "n", "crc", "p", "back", "repair", "fails"]


def _settle(rows: DataFrame, fan: int) -> DataFrame:
    """Turns of which those of one conversation and chunk follow each other, evaluated; known ones are left out."""
    kind = dict(rows.dtypes)["conv"]
    schema = f"conv {kind}, turn long, n long, crc long, p long, back int, repair int, fails int, status int, attempts int, first_at long, last_at long"

    def solve(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        get = lambda c, blank=0: pc.fill_null(table.column(c).combine_chunks(), blank).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(starts) - 1
        p, chunk, delivered = get("p"), get("chunk"), get("delivered_at", -2)
        known = delivered >= -1
        out = evaluate(group, p - chunk * fan + BACK, p, get("back"), get("repair"), get("fails"), known, delivered)
        keep = np.flatnonzero(~known)
        status, tries, first, last = (x[keep] for x in out)
        named = table.select(_IN).take(pa.array(keep)).combine_chunks()
        columns = [named.column(c) for c in _IN] + [pa.array(status.astype(np.int32)), pa.array(tries.astype(np.int32)), pa.array(first, mask=first < 0), pa.array(last, mask=last < 0)]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.record_batch(columns, [*_IN, "status", "attempts", "first_at", "last_at"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            starts = _starts(held)
            end = int(np.flatnonzero(starts)[-1]) if held.num_rows else 0  # the last group may go on in the next batch
            if end:
                yield solve(held.slice(0, end), starts[:end])
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield solve(held, _starts(held))

    return rows.mapInArrow(run, schema)


def _starts(table: pa.Table) -> np.ndarray:
    """Whether a row is the first of its conversation and chunk."""
    out = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        changes = np.zeros(table.num_rows - 1, bool)
        for c in ("conv", "chunk"):
            x = table.column(c).combine_chunks()
            a, b = x.slice(0, len(x) - 1), x.slice(1)
            differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            changes |= differs.to_numpy(zero_copy_only=False)
        out[1:] = changes
    return out


def _before(totals: DataFrame, most: int, fan: int, scratch: Scratch) -> DataFrame:
    """(conv, block, n0, s0): rows of earlier blocks of the conversation, and their sum of place x weight.

    ``totals`` has (conv, block, n, w, s) of blocks 0 to ``most``: rows, weights, and places
    within the block x weights.  Blocks of one parent are summed up by a window of at most ``fan`` rows; the
    parents themselves in the same way, as long as they are more than one.  Each level is
    written, being read twice: once for its parents and once with what comes before them.
    """
    bits = fan.bit_length() - 1
    local = totals.withColumn("parent", F.shiftright("block", bits))
    w = Window.partitionBy("conv", "parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(WIDE)
    local = local.withColumns({"n0": F.coalesce(F.sum("n").over(w), zero).cast(WIDE), "w0": F.coalesce(F.sum("w").over(w), zero).cast(WIDE)})
    local = local.withColumn("full", (F.col("s") + F.col("n0") * F.col("w")).cast(WIDE))
    local = local.withColumn("s0", F.coalesce(F.sum("full").over(w), zero).cast(WIDE))
    if not most >> bits:
        return local.select("conv", "block", "n0", "s0")
    local = scratch.keep(local, "replay-level")
    parents = local.groupBy("conv", F.col("parent").alias("block")).agg(*[F.sum(a).cast(WIDE).alias(b) for a, b in (("n", "n"), ("w", "w"), ("full", "s"))])
    up = _before(parents, most >> bits, fan, scratch).select(F.col("conv").alias("_conv"), F.col("block").alias("_parent"), F.col("n0").alias("_n0"), F.col("s0").alias("_s0"))
    both = local.join(up, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("parent") == F.col("_parent")))
    return both.select("conv", "block", (F.col("n0") + F.col("_n0")).cast(WIDE).alias("n0"), (F.col("s0") + F.col("_s0") + F.col("_n0") * F.col("w0")).cast(WIDE).alias("s0"))


def _with_before(rows: DataFrame, before: DataFrame) -> DataFrame:
    b = before.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "n0", "s0")
    return rows.join(b, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).drop("_conv", "_block")


def _wrapped(x: Column) -> Column:
    """A whole number as a long, modulo 2 ** 64 beyond its range."""
    half, full = F.lit(str(1 << 63)).cast(WIDE), F.lit(str(1 << 64)).cast(WIDE)
    return (F.pmod(x.cast(WIDE) + half, full) - half).cast("long")


def _hash(k: int) -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.crc32(F.concat(F.lit(f"{k}:"), text("conv"), F.lit(":"), text("turn")))


def replay(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """(conv_col, turn_col, status, attempts, first_at, last_at, release_no, state) of every row.

    A null text is an empty one.  Rows with a null conversation are one conversation of that
    id, and a null turn is a turn of its own before all others; in hashes both are empty.
    Rows that repeat conversation and turn are one turn, whose text is the one of least
    checksum, and each gets that turn's result.  ``state`` is a 64-bit sum, which wraps
    around beyond its range.  An empty table gives an empty result; texts of any length are
    read once, for their checksums; other columns are not read.

    ``fan`` (a power of two, at least 4) bounds the turns that meet in one task; it changes
    no result.  A turn whose chain of parents leaves its chunk waits for another round, of
    which there are as many as the chunks that the longest chain touches, less one.
    """
    if fan < BACK or fan & (fan - 1):
        raise ValueError("fan must be a power of two, and hold a turn's possible parents")
    spark, scratch, bits = df.sparkSession, Scratch(df.sparkSession), fan.bit_length() - 1
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("crc"))
    least, most = rows.agg(F.min("turn"), F.max("turn")).first()
    least, most = (0, 0) if least is None else (least, most)
    small = most - least < fan - 1  # then every conversation has less than fan turns, one of them null at most
    turns = rows.groupBy("conv", "turn").agg(F.min("crc").alias("crc"), F.count("*").alias("n"))
    faulty = _hash(1) % 101 < 50
    fails = F.lit(0)
    for a in range(1, ATTEMPTS + 1):
        fails = fails + F.when(faulty & (_hash(a + 2) % 3 == 0), 1 << (a - 1)).otherwise(0)
    turns = turns.select("*", (_hash(0) % 5).cast("int").alias("back"), F.when(faulty, _hash(2) % 101).otherwise(0).cast("int").alias("repair"), fails.cast("int").alias("fails"))
    by_turn = Window.orderBy("turn")
    if small:
        turns = turns.select("*", (F.row_number().over(by_turn.partitionBy("conv")) - 1).cast("long").alias("p"), F.lit(0).cast("long").alias("chunk"), F.lit(None).cast("long").alias("delivered_at"))
        done = _settle(turns, fan)
    else:
        first = (least >> bits) - 1  # the block of null turns; blocks are numbered from it, so that they all have one ancestor
        turns = scratch.keep(turns.select("*", F.coalesce(F.shiftright("turn", bits) - first, F.lit(0)).cast("long").alias("block")), "replay-turns")
        zero = F.lit(0).cast(WIDE)
        totals = turns.groupBy("conv", "block").agg(F.count("*").cast(WIDE).alias("n"), F.max(zero).alias("w"), F.max(zero).alias("s"))
        turns = _with_before(turns, _before(totals, (most >> bits) - first, fan, scratch))
        p = F.col("n0").cast("long") + F.row_number().over(by_turn.partitionBy("conv", "block")) - 1
        numbered = turns.select(*_IN[:4], p.alias("p"), *_IN[5:]).select("*", F.shiftright("p", bits).alias("chunk"), F.lit(None).cast("long").alias("delivered_at"))
        done = _in_rounds(numbered, fan, scratch)
    delivered = done.where(F.col("status") == DELIVERED)
    if small:
        w = Window.partitionBy("conv").orderBy("last_at", "turn")
        out = delivered.withColumn("release_no", F.row_number().over(w).cast("long"))
        out = out.withColumn("state", F.sum(F.col("release_no") * F.col("crc")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        out = _released(delivered, fan, scratch)
    out = out.select("conv", "turn", "n", "status", "attempts", "first_at", "last_at", "release_no", "state")
    rest = done.where(F.col("status") != DELIVERED).select("conv", "turn", "n", "status", "attempts", "first_at", "last_at", F.lit(None).cast("long").alias("release_no"), F.lit(None).cast("long").alias("state"))
    out = out.union(rest)
    # one row for each row of the turn; a turn that is repeated very often is made in steps
    out = out.withColumn("_step", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / REPEATS))))
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1), F.least(F.lit(REPEATS), F.col("n") - F.col("_step") * REPEATS))))
    status = F.element_at(F.array(*map(F.lit, NAMES)), F.col("status") + 1)
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), status.alias("status"), "attempts", "first_at", "last_at", "release_no", "state")


def _in_rounds(numbered: DataFrame, fan: int, scratch: Scratch) -> DataFrame:
    """All turns, evaluated chunk by chunk; open ones again with the last turns of the chunk before."""
    made = []
    rows = numbered
    while True:
        near = rows.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "p")
        made.append(scratch.keep(_settle(near, fan), "replay-round"))
        still = made[-1].where(F.col("status") == OPEN)
        if still.isEmpty():
            break
        chunk = F.shiftright("p", fan.bit_length() - 1)
        ends = None
        for t in made:
            some = t.where((F.col("status") != OPEN) & (F.col("p") % fan >= fan - BACK))
            ends = some if ends is None else ends.union(some)
        second = F.when(F.col("status") == DELIVERED, F.col("last_at")).otherwise(-1)
        rows = still.select(*_IN, chunk.alias("chunk"), F.lit(None).cast("long").alias("delivered_at")).union(ends.select(*_IN, (chunk + 1).alias("chunk"), second.alias("delivered_at")))
    out = None
    for t in made:
        some = t.where(F.col("status") != OPEN)
        out = some if out is None else out.union(some)
    return out


def _released(delivered: DataFrame, fan: int, scratch: Scratch) -> DataFrame:
    """release_no and state of delivered turns, by blocks of time in which about ``fan`` turns arrive at most."""
    bits = (fan * EVERY).bit_length() - 1
    rows = delivered.withColumn("block", F.shiftright("last_at", bits))
    w = Window.partitionBy("conv", "block").orderBy("last_at", "turn")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("i", F.row_number().over(w).cast("long"))
    rows = rows.withColumns({"c": F.sum(F.col("crc").cast(WIDE)).over(upto).cast(WIDE), "v": F.sum((F.col("i") * F.col("crc")).cast(WIDE)).over(upto).cast(WIDE)})
    totals = rows.groupBy("conv", "block").agg(F.count("*").cast(WIDE).alias("n"), F.sum(F.col("crc").cast(WIDE)).cast(WIDE).alias("w"), F.sum((F.col("i") * F.col("crc")).cast(WIDE)).cast(WIDE).alias("s"))
    most = delivered.agg(F.max("last_at")).first()[0] or 0
    rows = _with_before(rows, _before(totals, most >> bits, fan, scratch))
    return rows.withColumns({"release_no": F.col("n0").cast("long") + F.col("i"), "state": _wrapped(F.col("s0") + F.col("n0") * F.col("c") + F.col("v"))})


def _crc_sql(digits: str) -> str:
    """CRC-32 of the bytes that a string of hexadecimal digits names; ``remainders`` is the table of 256."""
    byte = f"16 * (strpos('0123456789ABCDEF', {digits}[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', {digits}[2 * i + 2]) - 1"
    data = f"list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length({digits}) // 2), lambda i: CAST({byte} AS BIGINT)))"
    return f"xor(4294967295, list_reduce({data}, lambda x, b: xor(x // 256, remainders[xor(x % 256, b) + 1])))"


#: Turn by turn and attempt by attempt, without the closed forms.
ORACLE = f"""
WITH RECURSIVE c AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS remainders
), t AS (
  SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS p, hex(encode(coalesce(text, ''))) AS digits FROM conversations
), k AS (
  SELECT conv_id, turn, k, hex(encode(CAST(k AS VARCHAR) || ':' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR))) AS name FROM t, (SELECT unnest(range(9)) AS k)
), h AS (
  SELECT conv_id, turn, list({_crc_sql('name')} ORDER BY k) AS h FROM k, c GROUP BY conv_id, turn
), x AS MATERIALIZED (
  SELECT t.conv_id, t.turn, p, {_crc_sql('digits')} AS crc, h, h[2] % 101 < 50 AS faulty, 7 * p + h[3] % 101 AS repaired,
    CASE WHEN h[1] % 5 BETWEEN 1 AND p THEN p - h[1] % 5 END AS parent
  FROM t JOIN h ON h.conv_id = t.conv_id AND h.turn = t.turn, c
), r AS (
  SELECT conv_id, CAST(-1 AS BIGINT) AS p, CAST(NULL AS BIGINT) AS first, CAST(NULL AS BIGINT) AS needed, CAST([] AS BIGINT[]) AS delivered FROM x GROUP BY conv_id
  UNION ALL
  SELECT conv_id, p, first, needed, list_append(delivered, CASE WHEN needed <= 6 THEN first + 20 * (CAST(power(2, needed - 1) AS BIGINT) - 1) END) FROM (
    SELECT conv_id, p, delivered, first, CASE WHEN first IS NOT NULL THEN coalesce(list_filter(range(1, 7),
      lambda a: NOT (faulty AND (first + 20 * (CAST(power(2, a - 1) AS BIGINT) - 1) < repaired OR h[a + 3] % 3 = 0)))[1], 7) END AS needed
    FROM (
      SELECT x.conv_id, x.p, delivered, faulty, repaired, h, CASE WHEN parent IS NULL THEN 7 * x.p ELSE greatest(7 * x.p, CASE WHEN delivered[parent + 1] IS NULL THEN NULL ELSE delivered[parent + 1] END) END AS maybe,
        CASE WHEN parent IS NULL OR delivered[parent + 1] IS NOT NULL THEN maybe END AS first
      FROM r JOIN x ON x.conv_id = r.conv_id AND x.p = r.p + 1
    )
  )
), s AS (
  SELECT x.conv_id, x.turn, x.crc, CASE WHEN first IS NULL THEN 'blocked' WHEN needed > 6 THEN 'dead' ELSE 'delivered' END AS status,
    CAST(CASE WHEN first IS NULL THEN 0 ELSE least(needed, 6) END AS INTEGER) AS attempts, first AS first_at, first + 20 * (CAST(power(2, least(needed, 6) - 1) AS BIGINT) - 1) AS last_at
  FROM r JOIN x ON x.conv_id = r.conv_id AND x.p = r.p
), n AS (
  SELECT *, CASE WHEN status = 'delivered' THEN row_number() OVER (PARTITION BY conv_id, status ORDER BY last_at, turn) END AS release_no FROM s
)
SELECT conv_id, turn, status, attempts, first_at, last_at, release_no,
  CASE WHEN status = 'delivered' THEN CAST(sum(release_no * crc) OVER (PARTITION BY conv_id, status ORDER BY release_no ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS state
FROM n
"""
