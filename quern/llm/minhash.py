"""MinHash near-duplicate detection with DartMinHash signatures.

A document is the set (or, on demand, the multiset) of its five-word shingles.  In a set
each shingle has a weight of its own, which is the same in every document: one that says
a word again weighs a little less, ``LIGHTEST`` at least.  Every element
owns a strip of the plane: its weight on one axis, rank on the other.  Darts fall
on a strip as a Poisson process that depends on the element alone; a dart counts
if it lies below the element's weight and below a rank limit chosen so that a
document expects ``k ln k + 2 k`` darts in all.  Each dart hits one of the ``k``
coordinates, and a coordinate keeps its earliest dart.  Two documents agree on a
coordinate with probability equal to their weighted Jaccard similarity, and the
cost is the number of elements plus the number of darts, not their product.  Weights
between ``LIGHTEST`` and 1 lower the similarity of a set by a known amount at most
(``least_weighted``), and bands and filters by signatures are set for that bound, so a
link by plain sets is not lost to them.

Candidates come from joining bands of the signature; every pair is then checked
exactly on whole texts.  Exact copies (equal shingle sets) are one node from the
start.  Buckets of up to ``SMALL`` nodes are compared in full, so a row meets a
bounded number of partners.  The nodes of larger buckets are compared with two
leaders of the bucket.  Nodes that are not in the bucket's largest component then are
open; while there are many, some of them lead in turn and meet those of the bucket that they are not
yet connected with, which closes most.  The signatures of the rest meet those of all
nodes of the bucket in blocks of ``SIGNATURES``, and what they do not rule out is checked exactly.
Pairs of blocks with too many candidates for that compare the texts of these nodes in blocks of
``BLOCK_SHINGLES``, by exact counts of common shingles, and give a forest of their links, not the links.  No link is given up,
no group is gathered in one task, and rows grow in proportion to the input.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quern.llm.hashing import WordHashes, mix, salted, unit
from quern.operators.graph import connected_components
from quern.scratch import Scratch

WORD = re.compile(r"\w+")
SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
#: Words of text that are hashed in one go; bounds the memory of a worker.
CHUNK_WORDS = 200_000
#: The least weight of a shingle, that of one word said over and over; the greatest is 1.
LIGHTEST = 0.9
_P = np.uint64(0x9FB21C651E98DF25)


class Shingler:
    """Texts to hashed shingles: lower-cased runs of word characters, ``width`` at a time.

    A text with fewer words has one shingle of all its words; one without words has none.
    """

    def __init__(self, width: int = SHINGLE_WORDS):
        self.width = width
        self.hashes = WordHashes()

    def _words(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def _windows(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        if not n:
            return np.empty(0, np.uint64)
        width = min(self.width, n)
        out = h[: n - width + 1].copy()
        for i in range(1, width):
            out = out * _P + h[i : n - width + 1 + i]
        return mix(out)

    def shingles(self, text: str | None) -> np.ndarray:
        return self._windows(self._words(text))

    def unique(self, text: str | None) -> np.ndarray:
        return np.unique(self.shingles(text))

    def weighed(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles and their weights: 1, less the share of equal pairs among a shingle's words times 1 - LIGHTEST."""
        h = self._words(text)
        out, first = np.unique(self._windows(h), return_index=True)
        width = min(self.width, len(h))
        again = np.zeros(max(len(h) - width + 1, 0))
        for step in range(1, width):
            same = h[step:] == h[:-step]
            if same.any():
                for i in range(width - step):
                    again += same[i : i + len(again)]
        return out, 1 - (1 - LIGHTEST) * again[first] / max(1, width * (width - 1) // 2)


class DartMinHash:
    """Sparse weighted signatures of ``k`` 64-bit coordinates."""

    def __init__(self, k: int = BANDS * ROWS, seed: int = 1):
        self.k, self.seed = k, seed
        self.darts = k * math.log(k) + 2 * k

    def signatures(self, elements: list[np.ndarray], weights: list[np.ndarray] | None = None) -> np.ndarray:
        """One row per document; documents without weight get zeros.

        ``elements`` are distinct 64-bit hashes; ``weights`` positive numbers, 1 each if absent.
        """
        out = np.zeros((len(elements), self.k), np.uint64)
        todo = [i for i, e in enumerate(elements) if len(e)]
        factor = 1.0
        while todo:
            sig, full = self._throw([elements[i] for i in todo], [weights[i] for i in todo] if weights else None, factor)
            at = np.asarray(todo)
            out[at[full]] = sig[full]
            todo = list(at[~full])
            factor *= 2  # the dart streams stay the same, so a higher limit only fills the gaps
        return out

    def _throw(self, elements, weights, factor):
        docs, k = len(elements), self.k
        sizes = np.fromiter(map(len, elements), np.int64, docs)
        owner = np.repeat(np.arange(docs), sizes)
        element = np.concatenate(elements)
        if weights is None:
            strip, weight, total = element, None, sizes.astype(np.float64)
        else:
            # a strip of weight w is cut into slabs of height one, the last of which may be lower
            w = np.concatenate(weights).astype(np.float64)
            slabs = np.ceil(w).astype(np.int64)
            level = np.arange(slabs.sum()) - np.repeat(np.cumsum(slabs) - slabs, slabs)
            total = np.bincount(owner, w, docs)
            weight = np.minimum(1.0, np.repeat(w, slabs) - level)
            strip = mix(np.repeat(element, slabs) + level.astype(np.uint64) * _P)
            owner = np.repeat(owner, slabs)
        limit = factor * self.darts / np.maximum(total, 1e-12)
        best = np.full(docs * k, np.inf)
        sig = np.zeros(docs * k, np.uint64)
        rank, turn = np.zeros(len(strip)), 0
        while len(strip):
            turn += 1
            dart = salted(strip, self.seed * 1_000_003 + turn)
            rank = rank - np.log(unit(dart))
            on = rank < limit[owner]
            strip, owner, rank, dart = strip[on], owner[on], rank[on], dart[on]
            if weight is not None:
                weight = weight[on]
            ident = mix(dart ^ _P)
            slot = owner * k + (ident % np.uint64(k)).astype(np.int64)
            use = slice(None) if weight is None else unit(mix(ident)) <= weight
            s, r, d = slot[use], rank[use], ident[use]
            np.minimum.at(best, s, r)
            won = best[s] == r
            sig[s[won]] = d[won]
        return sig.reshape(docs, k), np.isfinite(best).reshape(docs, k).all(1)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, as signed integers."""
    part = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), (len(sig), bands)).copy()
    for i in range(rows):
        key = mix(key * _P + part[:, :, i])
    return key.view(np.int64)


def chunks(texts: list, limit: int):
    """Runs of texts with about ``limit`` words together, or a single longer text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        words = len(t or "") // 6 + 1
        if size and size + words > limit:
            yield start, i
            start, size = i, 0
        size += words
    if start < len(texts):
        yield start, len(texts)


def least_weighted(similarity: float) -> float:
    """The weighted similarity that two sets of this similarity have at least, whatever shingles they share.

    Least is what is shared if that has the least weight and all the rest the greatest.
    """
    return similarity * LIGHTEST / (similarity * LIGHTEST + 1 - similarity)


def version_of(text):
    """What tells rows of one id apart: a hash of the text."""
    return F.xxhash64(text.cast("string"))


def sketch(df: DataFrame, id_col: str, text_col: str, weighted: bool = False, bands: int = BANDS, rows: int = ROWS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(node, version, n_shingles, h1, h2, sig, bands) of each row: hashes of its text and of the exact
    shingle set, a byte of each coordinate, and band keys.  Texts without words have null hashes and no bands."""

    def run(batches):
        shingler, dart = Shingler(shingle_words), DartMinHash(bands * rows)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts, CHUNK_WORDS):
                sets, weights = [], []
                for t in texts[a:b]:
                    u, w = np.unique(shingler.shingles(t), return_counts=True) if weighted else shingler.weighed(t)
                    sets.append(u)
                    weights.append(w)
                sig = dart.signatures(sets, weights)
                keys = band_keys(sig, bands, rows)
                hashed = [xxhash.xxh3_128_intdigest(u.tobytes() + (c.tobytes() if weighted else b"")) if len(u) else None for u, c in zip(sets, weights)]
                low = (sig & np.uint64(255)).astype(np.uint8)
                yield pa.record_batch(
                    [
                        ids.slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array([len(u) for u in sets], pa.int64()),
                        pa.array([None if h is None else (h >> 64) - 2**63 for h in hashed], pa.int64()),
                        pa.array([None if h is None else (h & (2**64 - 1)) - 2**63 for h in hashed], pa.int64()),
                        pa.array([low[i].tobytes() if len(u) else None for i, u in enumerate(sets)], pa.binary()),
                        pa.array([keys[i] if len(u) else [] for i, u in enumerate(sets)], pa.list_(pa.int64())),
                    ],
                    ["node", "version", "n_shingles", "h1", "h2", "sig", "bands"],
                )

    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long"), text, version_of(text)).mapInArrow(run, "node long, version long, n_shingles long, h1 long, h2 long, sig binary, bands array<long>")


def exact_jaccard(pairs: DataFrame, texts: DataFrame, weighted: bool = False, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Exact (weighted) Jaccard similarity of (a, b) pairs on the whole texts (node, text).

    The pairs are joined with one text and then with the other; both joins are plain
    equi-joins, so that a node with very many partners is split over tasks.
    """

    def run(batches):
        shingler, last, held = Shingler(shingle_words), None, None
        for batch in batches:
            a, ta, tb = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out = []
            for x, s, t in zip(a, ta, tb):
                if last is None or x != last[0] or s != last[1]:
                    last, held = (x, s), np.unique(shingler.shingles(s), return_counts=True)
                u, c = np.unique(shingler.shingles(t), return_counts=True)
                _, i, j = np.intersect1d(held[0], u, assume_unique=True, return_indices=True)
                if weighted:
                    common, whole = np.minimum(held[1][i], c[j]).sum(), held[1].sum() + c.sum()
                else:
                    common, whole = len(i), len(held[0]) + len(u)
                out.append(float(common / (whole - common)) if whole > common else 0.0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    left = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    both = pairs.select("a", "b").join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b")
    # repeated rows of an id are versions of one document: the most similar versions count
    return both.mapInArrow(run, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def prefilter(pairs: DataFrame, sigs: DataFrame, least: float, k: int) -> DataFrame:
    """Drop pairs whose signatures agree on so few coordinates that a similarity of
    ``least`` is out of the question (five standard deviations below it)."""
    floor = least - 5 * math.sqrt(least * (1 - least) / k)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, k)
            y = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, k)
            on = (x == y).mean(1) >= floor
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(on))

    joined = pairs.select("a", "b").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


#: Buckets of up to so many nodes are compared in full.
SMALL = 32
#: Texts of a block, two of which meet in a task, and their shingles at most (or a single longer text's).
BLOCK, BLOCK_SHINGLES = 256, 50_000
#: Rounds in which open nodes lead, how many of them in a bucket, and open nodes of a bucket beyond which they do.
PEELS, LEADERS, MANY = 4, 8, 4096
#: Ids that are broadcast at most, to read only the texts that are compared.
BROADCAST_IDS = 2_000_000


def texts_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(node, text) of the documents whose id is in the column ``node`` of ``ids``, n distinct ones."""
    return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "node", "left_semi")


def common_counts(sets: list[np.ndarray], numbers: int = 4_000_000) -> np.ndarray:
    """How many elements each two sets share, by products of matrices of so many numbers."""
    n = len(sets)
    columns = max(64, numbers // n)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # an element of one set alone counts for nothing
    place = np.cumsum(shared) - 1
    on = shared[at]
    owner, at = owner[on], place[at[on]]
    out = np.zeros((n, n), np.float32)
    for start in range(0, int(shared.sum()), columns):
        here = (at >= start) & (at < start + columns)
        m = np.zeros((n, columns), np.float32)
        m[owner[here], at[here] - start] = 1
        out += m @ m.T
    out[np.arange(n), np.arange(n)] = [len(x) for x in sets]
    return out.round().astype(np.int32)


def _block_links(state: DataFrame, texts: DataFrame, threshold: float, weighted: bool, shingle_words: int) -> DataFrame:
    """Links (a, b) between nodes of large buckets in different components, as forests.

    ``state`` has (bucket, node, own, open): open nodes are compared with all of their bucket.
    """
    tasks = _blocked(state, BLOCK, BLOCK_SHINGLES).join(texts, "node")

    def compare(table: pa.Table) -> pa.Table:
        shingler = Shingler(shingle_words)
        node, side = table["node"].to_numpy(), table["side"].to_numpy()
        found = [np.unique(shingler.shingles(t), return_counts=True) for t in table["text"].to_pylist()]
        if weighted:  # the i-th repetition of a shingle is an element of its own
            sets = [mix(np.repeat(u, c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64) * _P) for u, c in found]
        else:
            sets = [u for u, _ in found]
        common = common_counts(sets)
        size = np.diag(common).copy()
        whole = size[:, None] + size[None, :] - common
        linked = (common >= threshold * whole) & (whole > 0) & (side[:, None] == 0) & (side[None, :] == 1) & (node[:, None] != node[None, :])
        row, col = np.nonzero(linked)
        label = node.copy()
        while len(row):
            new = label.copy()
            np.minimum.at(new, row, label[col])
            np.minimum.at(new, col, label[row])
            if (new == label).all():
                break
            label = new
        on = label != node
        return pa.table({"a": label[on], "b": node[on]})

    return tasks.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


#: Nodes of a block whose signatures are compared, and candidates per node beyond which a pair of blocks is compared by its texts.
SIGNATURES, MOST_CANDIDATES = 1024, 16


def _blocked(state: DataFrame, size: int, shingles: int | None = None) -> DataFrame:
    """(bucket, node, own, side, i, j): each node in the pairs of blocks that it is in, open nodes against all of their bucket.

    Blocks have about ``size`` nodes, and no more than so many shingles together, if that is
    given.  Side 0: as one of the open nodes, against each block of all; side 1: as one of all,
    against each block of open ones.
    """
    weight = F.lit(1 / size) if shingles is None else F.greatest(F.lit(1 / size), F.col("n_shingles") / shingles)
    blocks = lambda w: F.ceil(F.sum(w)).cast("long")
    sizes = state.groupBy("bucket").agg(blocks(weight).alias("n"), blocks(F.when(F.col("open"), weight)).alias("u")).where("u > 0")
    rows = state.join(sizes, "bucket")
    h = F.xxhash64("node")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    first = F.when(F.col("open"), F.transform(upto("n"), lambda j: F.struct(F.pmod(h, "u").alias("i"), j.alias("j"), F.lit(0).alias("side")))).otherwise(F.expr("cast(array() as array<struct<i:bigint,j:bigint,side:int>>)"))
    second = F.transform(upto("u"), lambda i: F.struct(i.alias("i"), F.pmod(h, "n").alias("j"), F.lit(1).alias("side")))
    return rows.select("bucket", "node", "own", F.explode(F.concat(first, second)).alias("t")).select("bucket", "node", "own", "t.*")


def _candidates(state: DataFrame, sigs: DataFrame, least: float, k: int) -> DataFrame:
    """(bucket, a, b) of nodes in different components whose signatures do not rule a link out, an open one and any.

    A pair of blocks with more than MOST_CANDIDATES of them per node gives its nodes instead: (bucket, a, null).
    """
    floor = least - 5 * math.sqrt(least * (1 - least) / k)

    def compare(table: pa.Table) -> pa.Table:
        node, own, side = (table[c].to_numpy() for c in ("node", "own", "side"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, k)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = np.zeros((len(x), len(y)), np.int16)
        for c in range(k):
            near += sig[x, c][:, None] == sig[y, c][None, :]
        near = (near >= floor * k) & (own[x][:, None] != own[y][None, :])
        i, j = np.nonzero(near)
        bucket = table["bucket"][0].as_py()
        if len(i) > MOST_CANDIDATES * (len(x) + len(y)):
            both = np.unique(np.concatenate([node[x[np.unique(i)]], node[y[np.unique(j)]]]))
            return pa.table({"bucket": np.full(len(both), bucket), "a": both, "b": pa.nulls(len(both), pa.int64())})
        a, b = node[x[i]], node[y[j]]
        return pa.table({"bucket": np.full(len(a), bucket), "a": np.minimum(a, b), "b": np.maximum(a, b)})

    return _blocked(state, SIGNATURES).join(sigs, "node").groupBy("bucket", "i", "j").applyInArrow(compare, "bucket long, a long, b long")


def _state(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, own, open) of members (bucket, node): the node's component, and whether it is not the bucket's largest."""
    of_node = labels.select("node", F.col("label").alias("own"))
    each = members.join(of_node, "node", "left").select("bucket", "node", F.coalesce("own", "node").alias("own"))
    sizes = each.groupBy("bucket", "own").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "own")).getField("own").alias("main"))
    return each.join(main, "bucket").select("bucket", "node", "own", (F.col("own") != F.col("main")).alias("open"))


def _pairs_within(groups: DataFrame) -> DataFrame:
    """All pairs a < b of each short sorted array ``g``."""
    first = groups.select(F.posexplode("g").alias("i", "a"), "g")
    return first.select("a", F.explode(F.slice("g", F.col("i") + 2, F.greatest(F.size("g") - F.col("i") - 1, F.lit(0)))).alias("b"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    weighted: bool = False,
    bands: int = BANDS,
    rows: int = ROWS,
    shingle_words: int = SHINGLE_WORDS,
) -> DataFrame:
    """One row per input row: (id_col, class_id, kept, n_shingles, version).

    ``class_id`` is the least id reachable by links, a link being a pair of documents
    whose five-word shingles have a Jaccard similarity of at least ``threshold``, as sets, or
    if ``weighted`` by their counts (sum of the smaller over sum of the larger ones); ``kept`` marks the document of that id.
    How often a shingle occurs plays no part in the first case, in signatures or links, so a
    text and the same text said many times are near-duplicates.

    * Null, empty or wordless texts have nothing to compare: own class, kept.
    * A null id has a null class and is kept.  Rows that repeat an id are versions of
      one document; each has the class of its own version, and linked versions unite.
      ``version`` is a hash of the text, which tells them apart.  A version is kept if
      its class has no smaller id, so a unique text stays whatever else has its id.
    * Texts of fewer than five words are one shingle, so equal word runs are copies.
    * Equal similarities need no tie rule: the class is a minimum.  An empty table
      gives an empty result; columns other than the two named are not read.
    """
    scratch, k = Scratch(docs.sparkSession), bands * rows
    # what signatures of a link agree in, on average, at least; links of nodes are by the same measure, or bounded by it
    least = threshold if weighted else least_weighted(threshold)
    docs = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    sk = scratch.keep(sketch(docs, "node", "text", weighted, bands, rows, shingle_words), "minhash-sketch")
    known = sk.where("node is not null and h1 is not null")
    nodes = scratch.keep(known.groupBy("h1", "h2").agg(F.min(F.struct("node", "n_shingles", "sig", "bands")).alias("r")).select("h1", "h2", "r.node", "r.n_shingles", "r.sig", "r.bands"), "minhash-nodes")
    sigs = nodes.select("node", "sig")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = scratch.keep(prefilter(pairs, sigs, least, k), "minhash-pairs")
        ids = scratch.keep(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "minhash-ids")
        found = exact_jaccard(pairs, texts_of(docs, ids, ids.count()), weighted, shingle_words).where(F.col("similarity") >= threshold)
        found = scratch.keep(found, "minhash-links")
        scratch.drop(pairs, ids)
        return found

    buckets = nodes.select(F.explode("bands").alias("key"), "node")
    # the first leader of a bucket is its least node, so that the buckets of a group share it; the second the least by a hash
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("l1"), F.min_by("node", F.xxhash64("node")).alias("l2")).where("n > 1")
    shared = scratch.keep(buckets.join(sizes, "key"), "minhash-buckets")
    groups = shared.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("g"))
    within = _pairs_within(groups.groupBy("g").agg(F.count("*").alias("times")))
    large = shared.where(F.col("n") > SMALL)
    led = large.select(F.col("l1").alias("a"), F.col("node").alias("b")).union(large.select(F.col("l2").alias("a"), F.col("node").alias("b"))).where("a <> b")
    pairs = within.union(led).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("times"))
    links = verified(pairs)
    edges = links.select("a", "b")
    labels = connected_components(edges, "a", "b")
    if large.limit(1).count():
        members = large.select(F.col("l1").alias("bucket"), "node").union(large.select(F.col("l1").alias("bucket"), "l1")).groupBy("bucket", "node").agg(F.count("*").alias("times"))
        state = scratch.keep(_state(members.select("bucket", "node"), labels), "minhash-state")
        more = [links]
        for turn in range(PEELS):
            many = state.where("open").groupBy("bucket").agg(F.count("*").alias("u")).where(F.col("u") > MANY)
            if not many.limit(1).count():
                break
            # nodes by a hash that changes from round to round, the least of each slot
            h = F.xxhash64("node", F.lit(turn))
            led = state.where("open").join(many, "bucket").groupBy("bucket", F.pmod(h, F.lit(LEADERS)).alias("slot")).agg(F.min_by(F.struct(F.col("node").alias("leader"), F.col("own").alias("of")), h).alias("r")).select("bucket", "r.*")
            meet = state.join(led, "bucket").where("own <> of").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).groupBy("a", "b").agg(F.count("*").alias("times"))
            more.append(verified(meet))
            if not more[-1].limit(1).count():
                break
            edges = edges.union(more[-1].select("a", "b"))
            labels = connected_components(edges, "a", "b")
            before, state = state, scratch.keep(_state(state.select("bucket", "node"), labels), "minhash-state")
            scratch.drop(before)
        close = scratch.keep(_candidates(state, sigs, least, k), "minhash-close")
        rest = []  # most often there is nothing left to do
        if close.where("b is not null").limit(1).count():
            rest.append(verified(close.where("b is not null").select("a", "b").distinct()))
        if close.where("b is null").limit(1).count():
            dense = state.join(close.where("b is null").select("bucket", F.col("a").alias("node")).distinct(), ["bucket", "node"], "left_semi").join(nodes.select("node", "n_shingles"), "node")
            ids = scratch.keep(dense.select("node").distinct(), "minhash-ids")
            rest.append(scratch.keep(_block_links(dense, texts_of(docs, ids, ids.count()), threshold, weighted, shingle_words), "minhash-forest"))
            scratch.drop(ids)
        rest = [x for x in rest if x.limit(1).count()]
        if rest:
            for x in rest:
                edges = edges.union(x.select("a", "b"))
            labels = connected_components(edges, "a", "b")
        more += rest
        scratch.drop(close, state, *more[1:])
    scratch.drop(shared, links)
    classes = nodes.select("h1", "h2", "node").join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("class_id"))
    out = sk.select("node", "version", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left")
    of = F.when(F.col("node").isNotNull(), F.coalesce("class_id", "node"))
    return out.select(F.col("node").alias(id_col), of.alias("class_id"), F.coalesce(of == F.col("node"), F.lit(True)).alias("kept"), "n_shingles", "version")
