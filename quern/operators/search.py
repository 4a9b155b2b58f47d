"""Vector retrieval: exact filtered cosine top-k and everything that is composed from it."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from quern.functions.kernels import cosine_to, matrices, unit_rows
from quern.functions.vectors import TINY, l2_normalise

# fixed values: limits of the search interface
MOST_LIMIT = 200
MOST_ROWS = 5000
MOST_PROMPTS = 16
MOST_PROMPT_CHARS = 512


@dataclass(frozen=True)
class Page:
    """A validated page: ``limit`` within 1..MOST_LIMIT, and nothing beyond MOST_ROWS in all."""

    limit: int
    offset: int = 0

    def __post_init__(self):
        if not 1 <= self.limit <= MOST_LIMIT:
            raise ValueError(f"limit must be from 1 to {MOST_LIMIT}")
        if self.offset < 0:
            raise ValueError("offset must not be negative")

    @property
    def rows(self) -> int:
        return max(0, min(self.limit, MOST_ROWS - self.offset))


def filtered(points: DataFrame, collections: Sequence[str] | None = None, allowed: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Points of the collections (none named: all), among the allowed and not among the excluded ids.

    ``allowed`` and ``excluded`` are tables with a column ``id``; an empty allowed table allows nothing.
    """
    if collections:
        points = points.where(F.col("collection").isin(list(collections)))
    if allowed is not None:
        points = points.join(allowed.select("id"), "id", "left_semi")
    if excluded is not None:
        points = points.join(excluded.select("id"), "id", "left_anti")
    return points


def scored(points: DataFrame, query: Sequence[float]) -> DataFrame:
    """Cosine of each point with the query as ``score``; points without a vector are left out."""
    return points.where(F.col("vector").isNotNull()).withColumn("score", cosine_to(query)("vector"))


def top(points: DataFrame, page: Page | int) -> DataFrame:
    """Best first, ties by id: a top-k per partition and one merge, never a full sort."""
    page = page if isinstance(page, Page) else Page(page)
    out = points.orderBy(F.col("score").desc(), "id")
    return (out.offset(page.offset) if page.offset else out).limit(page.rows)


def best(points: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` best, at most MOST_ROWS: the pool of whatever ranks or filters them further."""
    return points.orderBy(F.col("score").desc(), "id").limit(min(rows, MOST_ROWS))


def one_vector(query: DataFrame) -> list[float] | None:
    """The vector in ``query`` (column ``q``), a table of a single row; None if there is none."""
    row = query.select("q").limit(1).collect()
    return list(row[0].q) if row and row[0].q is not None else None


def against(points: DataFrame, query: DataFrame) -> DataFrame:
    """Score points with the one vector in ``query``; without it every score is 0, and without a row there are no points."""
    row = query.select("q").limit(1).collect()
    if not row:
        return points.limit(0).withColumn("score", F.lit(0.0))
    return scored(points, row[0].q) if row[0].q is not None else points.where(F.col("vector").isNotNull()).withColumn("score", F.lit(0.0))


def page(points: DataFrame, page: Page | int, more: str = "filled") -> DataFrame:
    """A page of the best with ``has_more``: by ``filled`` whether the page is full, by ``next`` whether another row follows."""
    page = page if isinstance(page, Page) else Page(page)
    out = points.orderBy(F.col("score").desc(), "id")
    out = (out.offset(page.offset) if page.offset else out).limit(page.rows + (more == "next"))
    # a window over the one bounded page
    counted = out.withColumn("_n", F.count("*").over(W.partitionBy(F.lit(0)))).withColumn("_i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "id")))
    has = F.col("_n") > page.rows if more == "next" else F.col("_n") >= page.limit
    return counted.where(F.col("_i") <= page.rows).withColumn("has_more", has).drop("_n", "_i")


def recommend_vector(points: DataFrame, positive: DataFrame, negative: DataFrame) -> list[float] | None:
    """``recommend_target`` as a vector at hand."""
    return one_vector(recommend_target(points, positive, negative))


def vector_of(points: DataFrame, point_id: int) -> DataFrame:
    return points.where(F.col("id") == point_id).select(F.col("vector").alias("q"))


def similar_to(points: DataFrame, point_id: int) -> DataFrame:
    """Points scored by a point's vector, itself excluded; a point that is not there is an error."""
    q = one_vector(vector_of(points, point_id))
    if q is None:
        raise LookupError(f"there is no point {point_id}")
    return scored(points.where(F.col("id") != point_id), q)


def _key_type(rows: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{c}` {dict(rows.dtypes)[c]}, " for c in by)


def sum_vectors(rows: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, n, w, s): number, weight and weighted sum of the vectors of each group.

    Every task adds up matrices of its rows, so a group of any size costs it one row; the
    sums meet in one shuffle and are added as a sorted stream.  Vectors of a group must have
    one dimension; rows without a vector, or with a null component, do not count.
    """
    by, k = list(by), len(list(by))
    out = _key_type(rows, by) + "n long, w double, s array<double>"
    names = [*by, "n", "w", "s"]

    def table(keys, n, w, s):
        columns = [pa.array([key[i] for key in keys]) for i in range(k)]
        return columns, [pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(s, pa.list_(pa.float64()))]

    def grouped(batch) -> tuple[list, np.ndarray]:
        if not k:
            return [()], np.zeros(batch.num_rows, int)
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(k))))
        number: dict = {}
        group = np.fromiter((number.setdefault(x, len(number)) for x in keys), int, len(keys))
        return list(number), group

    def part(batches):
        for batch in batches:
            vectors = batch.column(k + 1)
            lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            keys, group = grouped(batch)
            weights = batch.column(k).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]):
                n, w, s = np.zeros(len(keys), int), np.zeros(len(keys)), np.zeros((len(keys), dim))
                for a, fits, m in matrices(vectors, int(dim)):
                    g, x = group[a : a + len(m)][fits], weights[a : a + len(m)][fits]
                    order = np.argsort(g, kind="stable")
                    cuts = np.flatnonzero(np.diff(g[order], prepend=-1))
                    if len(cuts):
                        at = g[order][cuts]
                        s[at] += np.add.reduceat(m[fits][order] * x[order][:, None], cuts, axis=0)
                        w[at] += np.add.reduceat(x[order], cuts)
                        n[at] += np.diff(np.append(cuts, len(g)))
                on = np.flatnonzero(n)
                if len(on):
                    columns, sums = table([keys[i] for i in on], n[on], w[on], list(s[on]))
                    yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(columns, batch.schema)), *sums], names)

    def whole(batches):
        key, n, w, s, kinds = None, 0, 0.0, None, None

        def done():
            columns, sums = table([key], [n], [w], [s])
            return pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(columns, kinds)), *sums], names)

        for batch in batches:
            kinds = batch.schema
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(k)))) if k else [()] * batch.num_rows
            for x, a, b, v in zip(keys, batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), batch.column(k + 2)):
                v = v.values.to_numpy(zero_copy_only=False)
                if x == key:
                    n, w, s = n + a, w + b, s + v
                else:
                    if key is not None:
                        yield done()
                    key, n, w, s = x, a, b, v
        if key is not None:
            yield done()

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    parts = rows.where(F.col("vector").isNotNull()).select(*by, w.alias("_w"), "vector").mapInArrow(part, out)
    parts = parts.repartition(*by).sortWithinPartitions(*by) if by else parts.coalesce(1)
    return parts.mapInArrow(whole, out)


def mean_vectors(rows: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Normalised (weighted) mean of ``vector`` per group, as ``centroid`` with ``n``; groups whose mean has no length are left out."""
    sums = sum_vectors(rows, by, weight)
    out = sums.withColumn("centroid", l2_normalise(F.transform("s", lambda x: x / F.col("w"))))
    return out.where(F.col("centroid").isNotNull()).select(*by, "n", "centroid")


def recommend_target(points: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """One row ``q``: the mean of the liked vectors minus the mean of the disliked, normalised, and ``liked``, whether any is.

    One pass over the points adds up both sides; a side without examples is left out.  An id
    on both sides counts for both.
    """
    signs = positive.select("id", F.lit(1).alias("side")).union(negative.select("id", F.lit(-1))).distinct()
    sums = sum_vectors(points.select("id", "vector").join(signs, "id"), ["side"])
    each = sums.select("side", F.transform("s", lambda x: F.col("side") * x / F.col("w")).alias("m"))
    both = each.agg(F.collect_list("m").alias("m"), F.coalesce(F.max("side") > 0, F.lit(False)).alias("liked"))  # two rows at most
    total = F.when(F.size("m") == 2, F.zip_with(F.get("m", F.lit(0)), F.get("m", F.lit(1)), lambda x, y: x + y)).otherwise(F.get("m", F.lit(0)))
    return both.select(l2_normalise(total).alias("q"), "liked")


def recommend(points: DataFrame, positive: DataFrame, negative: DataFrame, rows: int, target: Sequence[float] | None = None) -> DataFrame:
    """Nearest to the target (worked out here unless it is given); the examples themselves are excluded."""
    rest = filtered(points, excluded=positive.select("id").union(negative.select("id")))
    target = target if target is not None else recommend_vector(points, positive, negative)
    if target is None:
        return best(rest.where(F.col("vector").isNotNull()).withColumn("score", F.lit(0.0)), rows)
    return best(scored(rest, target), rows)


def feed(points: DataFrame, positive: DataFrame, negative: DataFrame, rows: int) -> tuple[DataFrame, list[float] | None]:
    """The pool of a feed, and what it was recommended by.

    Without a like (that has a vector) nothing can be recommended, whatever is disliked: the
    feed starts cold, with all that is neither liked nor disliked at a score of 0, by id.
    """
    found = recommend_target(points, positive, negative).first()
    if found.liked and found.q is not None:
        return recommend(points, positive, negative, rows, list(found.q)), list(found.q)
    rest = filtered(points, excluded=positive.select("id").union(negative.select("id")))
    return best(rest.where(F.col("vector").isNotNull()).withColumn("score", F.lit(0.0)), rows), None


def blend(vectors: Sequence[Sequence[float]], weights: Sequence[float] | None = None) -> list[float]:
    """Weighted sum, normalised; missing weights are 1, surplus ones ignored."""
    if not vectors:
        raise ValueError("no vector to blend")
    dims = {len(v) for v in vectors}
    if len(dims) != 1:
        raise ValueError("vectors of different dimensions")
    w = [float(x) for x in weights or []][: len(vectors)]
    w += [1.0] * (len(vectors) - len(w))
    if sum(w) <= 0:
        raise ValueError("the weights must have a positive sum")
    out = [sum(a * v[i] for a, v in zip(w, vectors)) for i in range(dims.pop())]
    length = sum(x * x for x in out) ** 0.5
    if length <= TINY:
        raise ValueError("the blend has no direction")
    return [x / length for x in out]


def parse_weights(raw: Sequence[str], n: int) -> list[float] | None:
    """Positive numbers, as many as vectors, or one for all; None if there are none."""
    if not raw:
        return None
    try:
        out = [float(x) for x in raw]
    except ValueError as e:
        raise ValueError("weights must be numbers") from e
    if any(not x > 0 or x == float("inf") for x in out):
        raise ValueError("weights must be positive")
    if len(out) == 1:
        return out * n
    if len(out) != n:
        raise ValueError("as many weights as vectors are needed")
    return out


def compose(positive: Sequence[Sequence[float]], negative: Sequence[Sequence[float]]) -> list[float]:
    """Mean of the positive minus mean of the negative prompts' vectors, normalised."""
    if not positive:
        raise ValueError("at least one positive prompt is needed")
    dim = len(positive[0])
    mean = lambda vs: [sum(v[i] for v in vs) / len(vs) for i in range(dim)] if vs else [0.0] * dim
    return blend([[a - b for a, b in zip(mean(positive), mean(negative))]])


def canonical_prompt(text: str) -> str:
    """A prompt as the encoder gets it: trimmed and in lower case, so that spellings share a vector."""
    return text.strip().lower()


def normalise_prompts(q: str, positive: Sequence[str], negative: Sequence[str]) -> tuple[list[str], list[str]]:
    """Trimmed, without blank, overlong and (whatever the case) repeated prompts; q comes last; MOST_PROMPTS in all."""

    def clean(items):
        seen, out = set(), []
        for x in (i.strip() for i in items):
            if x and len(x) <= MOST_PROMPT_CHARS and x.lower() not in seen:
                seen.add(x.lower())
                out.append(x)
        return out

    pos = clean([*positive, q])[:MOST_PROMPTS]
    return pos, clean(negative)[: MOST_PROMPTS - len(pos)]


def with_flags(rows: DataFrame, favorites: DataFrame, dislikes: DataFrame) -> DataFrame:
    """Whether each row is liked and disliked."""
    f = favorites.select("id", F.lit(True).alias("is_favorite"))
    d = dislikes.select("id", F.lit(True).alias("is_disliked"))
    return rows.join(f, "id", "left").join(d, "id", "left").fillna(False, ["is_favorite", "is_disliked"])


#: Seeds whose vectors are brought together in one matrix at most; larger sets stay distributed.
SEEDS_AT_HAND = 2048


def _at_hand(rows: DataFrame) -> tuple[list, np.ndarray] | None:
    """Ids and unit vectors (those with length) of a set, or None where it is too large to be brought here."""
    rows = rows.where(F.col("vector").isNotNull())
    got = rows.select("id", "vector").limit(SEEDS_AT_HAND + 1).toArrow()
    if got.num_rows > SEEDS_AT_HAND:
        return None
    v = unit_rows(np.array([np.asarray(x, float) for x in got["vector"].to_pylist()], float)) if got.num_rows else np.zeros((0, 1))
    on = v.any(1)
    return [i for i, x in zip(got["id"].to_pylist(), on) if x], v[on]


def _lower_percentile(distances: np.ndarray) -> float:
    return float(np.quantile(distances, 0.01, method="inverted_cdf")) if len(distances) else 0.0


def near_dup_threshold(seeds: DataFrame) -> DataFrame:
    """One row ``threshold``: first percentile (lower) of the cosine distances among seeds; 0 for fewer than two.

    All pairs of the set count.  Sets of up to SEEDS_AT_HAND seeds are compared by one matrix
    product, larger ones part by part.  Seeds without length are left out.
    """
    held = _at_hand(seeds)
    if held is not None:
        v = held[1]
        return seeds.sparkSession.createDataFrame([(_lower_percentile((1 - v @ v.T)[np.triu_indices(len(v), 1)]),)], "threshold double")
    return seeds.sparkSession.createDataFrame([(_percentile_by_blocks(seeds),)], "threshold double")


def _blocks(seeds: DataFrame) -> list[DataFrame]:
    """Seeds with a vector in parts of about SEEDS_AT_HAND / 2, by a hash of the id."""
    numbered = seeds.where(F.col("vector").isNotNull()).select("id", "vector")
    n = math.ceil(2 * numbered.count() / SEEDS_AT_HAND) + 1
    return [numbered.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i) for i in range(n)]


def _percentile_by_blocks(seeds: DataFrame, bins: int = 4096) -> float:
    """The first percentile (lower) of all pairs' distances, found by counting them in ever finer bins.

    Each part of the seeds goes to the tasks in turn and meets all seeds as they pass by, so
    nothing but counts comes back; four passes settle a double's digits.
    """
    spark, held = seeds.sparkSession, seeds.where(F.col("vector").isNotNull()).select("id", "vector")
    low, width, below, rank = -1e-9, (2 + 2e-9) / bins, 0, None
    for _ in range(4):
        counts = np.zeros(bins + 2, np.int64)  # what lies below, in each bin, above
        for block in _blocks(seeds):
            got = block.toArrow()
            if not got.num_rows:
                continue
            v = unit_rows(np.array([np.asarray(x, float) for x in got["vector"].to_pylist()]))
            on = v.any(1)
            shared = spark.sparkContext.broadcast((np.array(got["id"].to_pylist())[on], v[on], low, width))

            def run(batches, shared=shared):
                ids, part, low, width = shared.value
                total = np.zeros(bins + 2, np.int64)
                for batch in batches:
                    own = np.array(batch.column(0).to_pylist())
                    for a, fits, m in matrices(batch.column(1), part.shape[1]):
                        u = unit_rows(m)
                        fits = fits & u.any(1)
                        pairs = (own[a : a + len(m)][:, None] < ids[None, :]) & fits[:, None]
                        at = np.floor((1 - u @ part.T - low) / width)[pairs]
                        total += np.bincount(np.clip(at, -1, bins).astype(int) + 1, minlength=bins + 2)
                yield pa.record_batch([pa.array(np.arange(bins + 2)), pa.array(total)], ["bin", "n"])

            for r in held.mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
                counts[r.bin] += r.n
        if rank is None:
            rank = max(1, math.ceil(0.01 * counts.sum()))
            if not counts.sum():
                return 0.0
        upto = np.cumsum(counts)
        at = int(np.searchsorted(upto, rank))
        low, width = low + (at - 1) * width, width / bins
    return low


def near_dup_filter(candidates: DataFrame, seeds: DataFrame, threshold: DataFrame | float) -> DataFrame:
    """Candidates whose distance to every seed is at least the threshold; all of them without seeds.

    Seeds that fit are sent to the tasks as a matrix and candidates pass by in batches;
    larger sets of seeds come as blocks, each of which takes a share of the seeds.
    """
    least = threshold if isinstance(threshold, float) else float(threshold.first()[0])
    held = _at_hand(seeds)
    spark = candidates.sparkSession
    if held is not None:
        shared = spark.sparkContext.broadcast(held[1])
        seen = _nearest(shared)
        return candidates.where(~F.coalesce(seen("vector") > 1 - least + 1e-9, F.lit(False)))
    left = candidates
    for block in _blocks(seeds):  # each part is a pass; a candidate that is dropped is not seen again
        left = near_dup_filter(left, block, least)
    return left


def _nearest(shared):
    """A function of a vector column: the largest cosine with any of the shared unit vectors, null without any."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = shared.value
        for part in parts:
            out, ok = np.zeros(len(part)), np.zeros(len(part), bool)
            if len(s):
                for a, fits, m in matrices(part, s.shape[1]):
                    u, most = unit_rows(m), np.full(len(m), -np.inf)
                    for b in range(0, len(s), 1024):
                        most = np.maximum(most, (u @ s[b : b + 1024].T).max(1))
                    out[a : a + len(m)], ok[a : a + len(m)] = most, fits & u.any(1)
            yield pa.array(out, mask=~ok)

    return F.arrow_udf(run, "double")


def search_without_copies(points: DataFrame, seeds: DataFrame, page: Page | int) -> DataFrame:
    """A page of points near the mean of the seeds, neither seeds nor near-duplicates of one: (id, score, has_more).

    Three times as many rows as the page has are fetched (within MOST_ROWS), so that the page is
    full after copies are dropped.  ``has_more`` is true if something was dropped, if more
    was kept than fits, or if the page is full.
    """
    page = page if isinstance(page, Page) else Page(page)
    spark = points.sparkSession
    centroid = one_vector(mean_vectors(seeds).select(F.col("centroid").alias("q")))
    if centroid is None:
        return points.limit(0).select("id", F.lit(0.0).alias("score"), F.lit(False).alias("has_more"))
    rest = scored(filtered(points, excluded=seeds), centroid).orderBy(F.col("score").desc(), "id")
    fetched = (rest.offset(page.offset) if page.offset else rest).limit(max(0, min(3 * page.rows, MOST_ROWS - page.offset)))
    fetched = fetched.select("id", "score", "vector").toArrow()  # a few pages
    rows = spark.createDataFrame(fetched) if fetched.num_rows else None
    if rows is None:
        return points.limit(0).select("id", F.lit(0.0).alias("score"), F.lit(False).alias("has_more"))
    kept = near_dup_filter(rows, seeds, near_dup_threshold(seeds)).orderBy(F.col("score").desc(), "id").select("id", "score").collect()
    more = len(kept) < fetched.num_rows or len(kept) >= page.rows
    return spark.createDataFrame([(r.id, r.score, more) for r in kept[: page.rows]], "id long, score double, has_more boolean")
