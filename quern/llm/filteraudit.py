"""What each order of a set of filters keeps, removes and loses, for every part of a corpus.

A document is reduced to a mask: bit i is set if it fails filter i.  Everything that is asked
about orders of filters depends on masks alone, so a part is three histograms over the
``2 ** n`` masks (all documents, the good ones, the toxic ones).  The histograms of many parts
are stacked as rows of one integer matrix and multiplied by incidence matrices with a column
for each order and step: a mask is kept after that step, removed by it, fails it but is gone
already, or fails nothing else.  Five filters have 120 orders of 5 steps: 32 x 600 matrices.

Masks are Spark expressions, and histograms are counts that combine before every shuffle;
only they, at most ``2 ** n`` numbers a part, reach the matrix products.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.scratch import Scratch

#: White space as the filters mean it.
SPACE = r"[\x20\x09-\x0D]+"
#: Filters whose orders can all be looked at: ``n! * n`` columns.
MOST_FILTERS = 6


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space."""
    return F.array_remove(F.split(text, SPACE), "")


#: The failure conditions that a text alone decides, from its text and its words, by letter.
CONDITIONS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
#: The letter of the filter that fails a text which a document of smaller id has, too.
COPY = "E"


@functools.lru_cache(maxsize=4)
def incidence(n: int) -> tuple[list[tuple[int, ...]], np.ndarray, dict[str, np.ndarray]]:
    """All orders of n filters, the filter of each column, and for each outcome a matrix of masks x (order, step)."""
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters can be audited")
    orders = list(itertools.permutations(range(n)))
    own = 1 << np.array(orders, np.int64)  # order x step: the filter's bit
    earlier = np.cumsum(own, axis=1) - own  # bits of the filters before it
    mask = np.arange(1 << n, dtype=np.int64)[:, None]
    own, earlier = own.reshape(1, -1), earlier.reshape(1, -1)
    fails, gone = (mask & own) != 0, (mask & earlier) != 0
    outcome = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own}
    return orders, np.array(orders).reshape(-1), {k: v.astype(np.int64) for k, v in outcome.items()}


def outcomes(histograms: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Counts of parts x (order, step) from histograms of parts x (all, good, toxic) x masks."""
    _, filters, by = incidence(n)
    parts = len(histograms)
    rows = histograms.reshape(parts * 3, 1 << n)
    made = {k: (rows @ m).reshape(parts, 3, -1) for k, m in by.items()}
    out = {k: v[:, 0] for k, v in made.items()}
    out["good_lost"], out["toxic_lost"] = made["removed"][:, 1], made["removed"][:, 2]
    total = np.stack([out["removed"][:, filters == f].sum(axis=1) for f in range(n)], axis=1)
    out["shapley"] = total[:, filters]
    return out


def failures(docs: DataFrame, conditions: dict = CONDITIONS, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, part, mask, digest) of each row: the bits of the conditions that its text fails, and a SHA-256 of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("*", words(F.col("text")).alias("words"))  # a column of its own: it is split once
    mask = F.lit(0)
    for i, fails in enumerate(conditions.values()):
        mask = mask + F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0)
    return rows.select("id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def histograms(docs: DataFrame, labels: DataFrame, conditions: dict = CONDITIONS, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, copies included.

    Copies of one text in one part with the same labels become one row before texts meet, so
    that a text which a third of all documents have is a few rows a task.  The least id of
    each text is joined, not gathered: a text in very many parts is split like any hot key.
    """
    scratch = Scratch(docs.sparkSession)
    told = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failures(docs, conditions, id_col, part_col, text_col)
    rows = rows.join(told, rows["id"] == told["_id"], "left").select("id", "part", "mask", "digest", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    # rows of one id and text first: how many have the least id must be known
    same = ["digest", "part", "mask", "good", "toxic"]
    counted = rows.groupBy("id", *same).agg(F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    texts = counted.groupBy(*same).agg(F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("with_id"), F.min(F.when(known, F.struct("id", "n"))).alias("first"))
    texts = scratch.keep(texts, "audit-texts")
    least = texts.groupBy(F.col("digest").alias("_digest")).agg(F.min("first.id").alias("least"))
    texts_ = texts.join(least, texts["digest"] == least["_digest"])
    copies = F.col("with_id") - F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    bit = 1 << len(conditions)
    split = texts_.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + bit).alias("mask"), copies.alias("n")))))
    counts = split.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    out = scratch.keep(counts, "audit-counts")
    scratch.drop(texts)
    return out


def audit(docs: DataFrame, labels: DataFrame, conditions: dict = CONDITIONS, copy: str = COPY, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part, order of the filters and step (from 1; its filter is that letter of
    the order), zeros included.  ``conditions`` are the filters that a text decides, by letter;
    ``copy`` is the letter of the one more that fails rows whose text some row of smaller id
    has, wherever and whether removed or not.  ``shapley`` is what the step's filter removes,
    summed over all orders.

    A null text is an empty one and a null part is the part ''.  A row with a null id is no
    copy, and nobody's first; rows that repeat the least id of a text are all first.  A
    document is good (toxic) if any of its label rows has quality (toxic) 1.  Very long texts
    are read whole.  A part without rows has no rows here, so an empty table gives an empty
    result; columns beyond those named are not read.
    """
    letters = [*conditions, copy]
    if len(set(letters)) != len(letters) or any(len(x) != 1 for x in letters):
        raise ValueError("filters need different letters")
    n = len(letters)
    counts = histograms(docs, labels, conditions, id_col, part_col, text_col)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("bins"))  # at most 2 ** n bins
    measures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches):
        orders, _, _ = incidence(n)
        names = ["".join(letters[f] for f in o) for o in orders]
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                some = batch.slice(a, 64)
                lists = some.column("bins")
                owner = np.repeat(np.arange(some.num_rows), np.diff(lists.offsets.to_numpy()))
                bins = lists.flatten()
                grid = np.zeros((some.num_rows, 3, 1 << n), np.int64)
                for k, name in enumerate(("n", "good", "toxic")):
                    grid[owner, k, bins.field("mask").to_numpy()] = bins.field(name).to_numpy()
                made = outcomes(grid, n)
                columns = [some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), len(names) * n)))]
                columns += [pa.array(np.tile(np.repeat(names, n), some.num_rows), pa.string()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), some.num_rows * len(names)))]
                columns += [pa.array(made[m].reshape(-1)) for m in measures]
                yield pa.record_batch(columns, ["part", "filter_order", "step", *measures])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in measures))


_BITS = "CASE f WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 16 END"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN min(d.doc_id) OVER (PARTITION BY t) < d.doc_id THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), h AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), b AS (SELECT f, {_BITS} AS bit FROM f),
o AS (
  SELECT [b1.f, b2.f, b3.f, b4.f, b5.f] AS letters, [b1.bit, b2.bit, b3.bit, b4.bit, b5.bit] AS bits
  FROM b b1, b b2, b b3, b b4, b b5 WHERE b1.bit + b2.bit + b3.bit + b4.bit + b5.bit = 31
    AND len(list_distinct([b1.f, b2.f, b3.f, b4.f, b5.f])) = 5
), s AS (
  SELECT array_to_string(letters, '') AS filter_order, CAST(k AS INTEGER) AS step, letters[k] AS letter, bits[k] AS bit, coalesce(list_sum(bits[1 : k - 1]), 0)::BIGINT AS earlier
  FROM o, (SELECT unnest(range(1, 6)) AS k)
), r AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
