"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Tokens are words between white space, lower-cased in A-Z, then one end per text.  Counts of
all training tokens are gathered by an ordinary aggregate.

**Vocabulary.**  It grows with the corpus: the ``GROWTH * sqrt(N)`` most frequent of the
tokens seen at least ``MIN_COUNT`` times have vectors of their own, up to ``MOST_WORDS``, which
bounds a worker's memory.  Every other token, seen or not, is spelt out: as a context its
vector is the sum of those of two hashed character n-grams (its beginning and its end), and
as an outcome it belongs to the group of its ending.

**Three levels.**  The first level's outcomes are the ``SINGLES`` most frequent words, ``COARSE``
bins of all other words of the vocabulary, and ``GROUPS`` groups of spelt tokens.  A coarse
bin has fine bins (of words of like frequency and of equal mass), a fine bin words, and at each
level the neural model decides, given the two tokens before.  Within a group the smoothed
counts of all training texts decide.  Every level is normalised exactly, by batched matrix
products, so a token's probability is the product of two or three exact softmaxes.

**Training.**  The model predicts ``A r[u] + B r[v]`` from the vectors of the tokens before
(A, B diagonal) and scores an outcome by the product with its output vector, plus a bias.
Noise-contrastive estimation trains all levels without normalising: real outcomes against the
unigram distribution among the outcomes of the same parent, by draws, and at the first level
against what draws give in expectation.  The training texts are dealt to shards of about
``SHARD_TOKENS`` tokens by a hash of id and text, and to ``ROUNDS`` slices; in each round every
shard trains a copy over its slice, in the order of that hash, from the average of the last
round.  Shards, slices and order depend on the rows alone, so the model does not depend on
how the input is partitioned.  A vector's average is weighted by how often a copy has
trained it.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.scratch import Scratch

DIM = 8
#: Words that are outcomes of the first level, coarse bins of the others, fine bins in a coarse one, groups of spelt tokens.
SINGLES, COARSE, FINE, GROUPS = 16, 8, 64, 16
#: Hashed beginnings and endings of words without a vector of their own; a power of two.
NGRAMS = 1024
GROWTH, MIN_COUNT, MOST_WORDS = 6.0, 2, 1 << 18
#: Draws for each token at the lower levels.
NOISE = 1
RATE = 0.15
BATCH = 4096
#: Tokens in a row that stay together in a batch, so that a context vector is looked up once.
RUN = 64
#: Tokens that a copy holds and goes over in random order.
BUFFER = 400_000
#: Tokens that are scored together, so that the bins have many of them each.
CHUNK = 120_000
ROUNDS = 3
#: Tokens of a shard; beyond MOST_SHARDS shards become longer.
SHARD_TOKENS, MOST_SHARDS = 4_000_000, 4096
#: Small corpora are gone over several times, until about so many tokens have been seen by the model.
ENOUGH, MOST_PASSES = 3_000_000, 8
ALPHA = 0.1
#: The most frequent tokens, whose counts workers get directly; the others meet theirs in a join.
HEAD = 200_000
#: Rows that are taken from a batch at a time, and rows of a parameter matrix that travel together.
ROWS = 1024
END = b""
LN10 = math.log(10.0)


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: exactly the white space of ASCII splits them, exactly A-Z is lowered."""
    return text.lower().split() if text else []


class _Hashes(dict):
    """Spark's xxhash64 of bytes modulo NGRAMS; remembers what it has met, up to a bound."""

    def __missing__(self, part: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        out = self[part] = xxhash.xxh64_intdigest(part, 42) % NGRAMS
        return out


_hash = _Hashes()


def spelling(word: bytes) -> int:
    """Hashed n-grams of a word's ending and beginning, as one number below NGRAMS**2."""
    return _hash[word[-3:]] * NGRAMS + _hash[word[:4]]


def group_of(spelt):
    """Class of a spelt token: by its ending."""
    return spelt // NGRAMS % GROUPS


@dataclass
class Statistics:
    """Counts that workers get: of the head's tokens one each, of all spelt tokens by class."""

    head: dict = field(repr=False)
    total: int = 0
    distinct: int = 0
    words: list = field(default_factory=list, repr=False)
    group_total: np.ndarray = field(default_factory=lambda: np.zeros(GROUPS))
    group_distinct: np.ndarray = field(default_factory=lambda: np.zeros(GROUPS))


def training_fold(id_col: str):
    """Whether a row is for training: crc32 of the id as text modulo 10 is not 0.  A null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(10)) != 0, F.lit(False))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token binary, c long) of all texts in UTF-8; each task adds up what it can before the shuffle."""

    def run(batches):
        held: Counter[bytes] = Counter()

        def flush():
            out = pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "c"])
            held.clear()
            return out

        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                for t in batch.column(0).slice(a, ROWS).to_pylist():
                    held.update(tokens(t))
                    held[END] += 1
                    if len(held) > 250_000:
                        yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def gather(counts: DataFrame, head: int = HEAD, growth: float = GROWTH) -> Statistics:
    """Bring to the driver the bounded part of the counts: the head and sums by group of spelt tokens."""
    group = F.pmod(F.pmod(F.xxhash64(F.expr("right_bytes")), F.lit(NGRAMS)), F.lit(GROUPS))
    is_end = F.octet_length("token") == 0
    ending = F.expr("substring(token, greatest(octet_length(token) - 2, 1), 3) as right_bytes")
    sums = counts.where(~is_end).select("c", ending).groupBy(group.alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.count_if(F.col("c") >= MIN_COUNT).alias("often")).collect()
    ends = counts.where(is_end).select("c").collect()
    end = ends[0].c if ends else 0
    total = sum(r.c for r in sums) + end
    size = min(sum(r.often for r in sums), round(growth * math.sqrt(total)), MOST_WORDS)
    top = counts.where(~is_end).orderBy(F.col("c").desc(), "token").limit(max(head, size)).select("token", "c").toArrow()
    first = dict(zip(top["token"].to_pylist(), top["c"].to_pylist()))
    ranked = sorted(first, key=lambda w: (-first[w], w))[:size]
    out = Statistics(first | {END: end}, total, sum(r.n for r in sums) + len(ends), [END, *ranked])
    for r in sums:
        out.group_total[r.g], out.group_distinct[r.g] = r.c, r.n
    for w in ranked:  # those with vectors of their own leave their group
        g = group_of(spelling(w))
        out.group_total[g] -= first[w]
        out.group_distinct[g] -= 1
    return out


class Layout:
    """Numbers of words, outcomes and context rows.

    Codes of tokens: words from 0 (the end), then ``V + spelling``.  The first level's outcomes:
    singles, coarse bins, groups of spelt tokens.  The second level's: fine bins.  The third's: words.
    """

    def __init__(self, stats: Statistics):
        c = np.array([stats.head[w] for w in stats.words], float)
        self.v = v = len(c)
        self.singles = s = min(SINGLES, v)
        # words by frequency in fine bins of equal mass, fine bins in coarse ones
        fine = min(COARSE * FINE, max(1, (v - s) // 8)) if v > s else 0
        mass = np.cumsum(c[s:])
        cut = np.minimum((mass - c[s:]) / max(mass[-1], 1) * fine, fine - 1).astype(np.int32) if fine else np.empty(0, np.int32)
        _, self.fine_of = np.unique(cut, return_inverse=True)
        self.fine = int(self.fine_of.max()) + 1 if fine else 0
        self.word_start = s + np.searchsorted(self.fine_of, np.arange(self.fine + 1))
        self.coarse_of = np.arange(self.fine) * COARSE // max(self.fine, 1)
        _, self.coarse_of = np.unique(self.coarse_of, return_inverse=True)
        self.coarse = int(self.coarse_of.max()) + 1 if fine else 0
        self.fine_start = np.searchsorted(self.coarse_of, np.arange(self.coarse + 1))
        self.outcomes = s + self.coarse + GROUPS
        self.word_outcome = np.concatenate([np.arange(s), s + self.coarse_of[self.fine_of]]).astype(np.int32)
        self.word_counts = c[s:]
        self.fine_counts = np.bincount(self.fine_of, c[s:], self.fine)
        self.outcome_counts = np.concatenate([np.bincount(self.word_outcome, c, s + self.coarse), np.maximum(stats.group_total, 0)])
        self.endings, self.beginnings = v, v + NGRAMS
        self.start = v + 2 * NGRAMS
        self.contexts = self.start + 1

    def levels(self):
        """Counts of each level's outcomes, and what they are divided among: all, the coarse bin, the fine bin."""
        return (self.outcome_counts, np.zeros(self.outcomes, int)), (self.fine_counts, self.coarse_of), (self.word_counts, self.fine_of)

    def outcome_of(self, codes: np.ndarray) -> np.ndarray:
        word = codes < self.v
        return np.where(word, self.word_outcome[np.where(word, codes, 0)], self.singles + self.coarse + group_of(np.maximum(codes - self.v, 0)))

    def rows_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The context row of each code (-1: the start), which of them are spelt, and the second rows of those."""
        spelt = np.flatnonzero(codes >= self.v)
        rows = np.where(codes < 0, self.start, codes)
        number = codes[spelt] - self.v
        rows[spelt] = self.endings + number // NGRAMS
        return rows, spelt, self.beginnings + number % NGRAMS


def _shares(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Smoothed share of each outcome among those of its parent."""
    c = counts + ALPHA
    return c / np.bincount(of, c)[of] if len(c) else c


def laid_out(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end with two starts (-1) before each, and where the tokens are: what is before a token is its context."""
    text = np.zeros(len(codes), np.int64)
    text[starts] = 1
    at = np.arange(len(codes)) + 2 * np.cumsum(text)
    out = np.full(len(codes) + 2 * len(starts), -1)
    out[at] = codes
    return out, at


class LogBilinear:
    """Parameters, training step and exact scores.

    ``r`` are the context vectors, ``ab`` the diagonals; ``p``, ``f`` and ``q`` the outputs of the
    three levels, with the bias as their last column.
    """

    NAMES = ("r", "p", "f", "q", "ab")

    def __init__(self, layout: Layout, dim: int = DIM, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.layout, self.dim = layout, dim
        self.r = rng.normal(0, 0.3, (layout.contexts, dim)).astype(np.float32)

        def outputs(counts, of):  # at first nothing but the unigram distribution
            out = np.zeros((len(counts), dim + 1), np.float32)
            out[:, -1] = np.log(_shares(counts, of))
            return out

        self.p, self.f, self.q = (outputs(c, of) for c, of in layout.levels())
        self.ab = np.ones((2, dim), np.float32) * np.float32(0.7)

    def copy(self) -> LogBilinear:
        out = copy.copy(self)
        for x in self.NAMES:
            setattr(out, x, getattr(self, x).copy())
        return out

    def prepare(self, seed: int, rate: float = RATE, noise: int = NOISE) -> LogBilinear:
        self.rng, self.rate, self.k = np.random.default_rng(seed), np.float32(rate), noise
        self.grown = {x: np.full(len(getattr(self, x)), 0.1, np.float32) for x in self.NAMES}
        self.times = {x: np.zeros(len(getattr(self, x)), np.float32) for x in self.NAMES}
        self.noise = {}
        for x, (counts, of) in zip("pfq", self.layout.levels()):
            if len(counts):
                share = _shares(counts, of)
                ends = np.cumsum(share)  # each parent's outcomes take one unit of the line
                self.noise[x] = ends, np.log(share * noise).astype(np.float32), of
        return self

    def _step(self, name: str, at: np.ndarray, gradient: np.ndarray) -> None:
        """Adagrad, with one rate a row, on the rows ``at`` (each may occur often)."""
        # one sort of (row, place) packed in a number: stable, and much faster than a stable argsort
        packed = np.sort((at.astype(np.uint64) << np.uint64(32)) | np.arange(len(at), dtype=np.uint64))
        s, order = (packed >> np.uint64(32)).astype(np.int64), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        times = np.diff(np.append(first, len(s)))
        g = gradient[order[first]]
        often = np.flatnonzero(times > 1)
        if len(often):  # the rest of rows that occur more than once
            rest = np.ones(len(s), bool)
            rest[first] = False
            more = times[often] - 1
            g[often] += np.add.reduceat(gradient[order[rest]], np.cumsum(more) - more, axis=0)
        self._apply(name, s[first], g, times)

    def _apply(self, name: str, rows: np.ndarray, g: np.ndarray, times: np.ndarray) -> None:
        grown = self.grown[name]
        new = grown[rows] + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
        grown[rows] = new
        getattr(self, name)[rows] += (self.rate / np.sqrt(new))[:, None] * g
        self.times[name][rows] += times

    def _contrast_all(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """A step of the first level, against what draws give in expectation; the gradient of the hidden vectors.

        ``h`` has ones as its last column, for the biases.
        """
        out, (_, log_noise, _) = self.p, self.noise["p"]
        s = h @ out.T
        s -= log_noise
        np.clip(s, -30, 30, out=s)
        gr = 1 / (1 + np.exp(s[np.arange(len(s)), target]))  # 1 - sigmoid
        np.negative(s, out=s)
        np.exp(s, out=s)
        s += 1
        g = np.divide(-np.exp(log_noise), s, out=s)
        g[np.arange(len(s)), target] += gr
        gh = g @ out
        self._apply("p", np.arange(len(out)), g.T @ h, np.bincount(target, minlength=len(out)).astype(np.float32))
        return gh

    def _contrast(self, name: str, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """A step of a lower level against ``k`` draws for each token among the outcomes of the same parent."""
        out, (ends, log_noise, of) = getattr(self, name), self.noise[name]
        n, k = len(target), self.k
        draw = np.searchsorted(ends, (of[target][:, None] + self.rng.random((n, k))).ravel())
        np.minimum(draw, len(ends) - 1, out=draw)
        rows = np.concatenate([target, draw])
        x = out[rows]
        s = np.concatenate([np.einsum("ij,ij->i", x[:n], h), np.einsum("ikj,ij->ik", x[n:].reshape(n, k, -1), h).ravel()]) - log_noise[rows]
        np.clip(s, -30, 30, out=s)
        g = np.concatenate([1 / (1 + np.exp(s[:n])), -1 / (1 + np.exp(-s[n:]))])
        x *= g[:, None]
        gh = x[:n] + x[n:].reshape(n, k, -1).sum(1)
        self._step(name, rows, np.concatenate([h, np.repeat(h, k, 0)]) * g[:, None])
        return gh

    def vectors(self, codes: np.ndarray):
        """Context vectors of codes, with the rows that they are made of."""
        rows, spelt, second = self.layout.rows_of(codes)
        c = self.r[rows]
        c[spelt] += self.r[second]
        return c, rows, spelt, second

    def hidden(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Hidden vectors (a last column of ones) of the context vectors two before and one before."""
        out = np.ones((*two.shape[:-1], self.dim + 1), np.float32)
        np.multiply(two, self.ab[0], out=out[..., :-1])
        out[..., :-1] += one * self.ab[1]
        return out

    def update(self, window: np.ndarray) -> None:
        """One step on runs of codes, a row each: their first two are contexts, all others outcomes, too, but for starts."""
        lay, (n, width) = self.layout, window.shape
        c, rows, spelt, second = self.vectors(window[:, :-1].ravel())
        c = c.reshape(n, width - 1, -1)
        u, v = c[:, :-1], c[:, 1:]
        w = window[:, 2:].ravel()
        real = np.flatnonzero(w >= 0)
        h, w = self.hidden(u, v).reshape(len(w), -1)[real], w[real]
        gh = self._contrast_all(h, lay.outcome_of(w))
        inner = np.flatnonzero((w >= lay.singles) & (w < lay.v))
        if len(inner):
            hi, wi = h[inner], w[inner] - lay.singles
            gi = self._contrast("f", hi, lay.fine_of[wi])
            gi += self._contrast("q", hi, wi)
            gh[inner] += gi
        g = np.zeros((n * (width - 2), self.dim), np.float32)
        g[real] = gh[:, :-1]
        g = g.reshape(n, width - 2, -1)
        # a token is one before its next and two before the one after that: its gradients meet before they are scattered
        gc = np.zeros_like(c)
        np.multiply(g, self.ab[0], out=gc[:, :-1])
        gc[:, 1:] += g * self.ab[1]
        ab = np.stack([np.einsum("ijk,ijk->k", g, u), np.einsum("ijk,ijk->k", g, v)]) / np.float32(max(1, len(w)))
        gc = gc.reshape(len(rows), -1)
        self._step("r", np.concatenate([rows, second]), np.concatenate([gc, gc[spelt]]))
        self._apply("ab", np.arange(2), ab, 1)

    def learn(self, codes: np.ndarray, starts: np.ndarray, batch: int = BATCH) -> None:
        """Go over texts in batches of runs of RUN tokens, in random order."""
        laid = laid_out(codes, starts)[0]
        runs = -(-(len(laid) - 2) // RUN)
        laid = np.concatenate([laid, np.full(2 + runs * RUN - len(laid), -1)])
        first = self.rng.permutation(runs) * RUN
        for i in range(0, runs, batch // RUN):
            self.update(laid[first[i : i + batch // RUN, None] + np.arange(RUN + 2)])

    def log_probabilities(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log of the exactly normalised probability of each word, and of the class of each spelt token."""
        lay, out = self.layout, np.zeros(len(codes))
        laid, place = laid_out(codes, starts)
        pt = np.ascontiguousarray(self.p.T)
        for a in range(0, len(codes), CHUNK):
            w, at = codes[a : a + CHUNK], place[a : a + CHUNK]
            low = at[0] - 2
            c = self.vectors(laid[low : at[-1]])[0]
            h = self.hidden(c[at - 2 - low], c[at - 1 - low])
            here, k = out[a : a + CHUNK], lay.outcome_of(w)
            for b in range(0, len(w), 4096):
                here[b : b + 4096] = _log_softmax_at(h[b : b + 4096] @ pt, k[b : b + 4096])
            inner = np.flatnonzero((w >= lay.singles) & (w < lay.v))
            inner = inner[np.argsort(w[inner], kind="stable")]
            h, words = h[inner], w[inner] - lay.singles
            gain = np.zeros(len(inner))
            for level, at, starts_ in (("f", lay.fine_of[words], lay.fine_start), ("q", words, lay.word_start - lay.singles)):
                table, cuts = getattr(self, level), np.searchsorted(at, starts_)
                for j in np.flatnonzero(np.diff(cuts)):
                    low, high = starts_[j], starts_[j + 1]
                    if high - low > 1:
                        t = table[low:high].T
                        for b in range(cuts[j], cuts[j + 1], 4096):
                            e = min(b + 4096, cuts[j + 1])
                            gain[b:e] += _log_softmax_at(h[b:e] @ t, at[b:e] - low)
            here[inner] += gain
        return out


def _log_softmax_at(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = s[np.arange(len(s)), at].astype(np.float64)
    # scores far beyond what single precision can sum are rare, and then the largest is taken off first
    if s.max() > 60:
        top = s.max(1, keepdims=True)
        s -= top
        own -= top[:, 0]
    np.exp(s, out=s)
    return own - np.log(np.einsum("ij->i", s))


class Coder:
    """Texts to codes: words of the vocabulary by number, others by their spelling; remembers what it has met."""

    def __init__(self, stats: Statistics, most: int = 150_000):
        self.v, self.most, head = len(stats.words), most, stats.head
        number = set(stats.words)
        self.words = [*stats.words, *(w for w in head if w not in number)]
        self.codes = [*range(self.v), *(self.v + spelling(w) for w in self.words[self.v :])]
        self.logs = np.log10(np.array([head[w] for w in self.words], float) + ALPHA)
        self.first_rare, coder = len(self.words), self

        class Places(dict):
            def __missing__(self, w):
                at = self[w] = len(coder.words)
                coder.words.append(w)
                coder.codes.append(coder.v + spelling(w))
                return at

        self.places = Places(zip(self.words, range(len(self.words))))
        self._array = np.array(self.codes, np.int64)

    def forget(self) -> None:
        """Forget the words outside the head."""
        for w in self.words[self.first_rare :]:
            del self.places[w]
        del self.words[self.first_rare :], self.codes[self.first_rare :]
        self._array = self._array[: self.first_rare]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places, codes); a place below ``first_rare`` has its count in ``logs``, others their word in ``words``."""
        if len(self.words) > self.first_rare + self.most:
            self.forget()
        places = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        if len(self._array) < len(self.codes):
            self._array = np.concatenate([self._array, np.array(self.codes[len(self._array) :], np.int64)])
        return places, self._array[places]


def encode(docs: DataFrame, stats: Statistics) -> DataFrame:
    """(id, ord, training, n, known, base, within, codes, rare, times) of each row of (id, text in UTF-8, ord, training).

    ``base`` and ``within`` (the log10 share of spelt tokens in their groups) lack the tokens
    outside the head, which ``rare`` names with their ``times``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(stats)
    kind = dict(docs.dtypes)["id"]

    def run(batches):
        s = shared.value
        coder = Coder(s)
        denominator = math.log10(s.total + ALPHA * (s.distinct + 1))
        share = np.log10(np.maximum(s.group_total, 0) + ALPHA * (np.maximum(s.group_distinct, 0) + 1))
        no_end = s.head[END] == 0

        def table(part, words, n):
            places, codes = coder.encode(words)
            starts = np.cumsum(n) - n
            total = lambda x: np.add.reduceat(x, starts)
            rare, spelt = places >= coder.first_rare, codes >= coder.v
            logs = np.where(rare, 0.0, coder.logs[np.where(rare, 0, places)])
            within = np.where(spelt, logs - share[group_of(np.maximum(codes - coder.v, 0))], 0.0)
            row = np.repeat(np.arange(len(n)), n)[rare]
            named, times = np.unique(row.astype(np.int64) << 32 | places[rare], return_counts=True)
            names = pa.array([coder.words[i] for i in (named & 0xFFFFFFFF).tolist()], pa.binary())
            cuts = pa.array(np.searchsorted(named >> 32, np.arange(len(n) + 1)), pa.int32())
            columns = [
                part.column(0), part.column(2), part.column(3), pa.array(n), pa.array(n - total(rare.astype(np.int64)) - no_end),
                pa.array(total(logs) - n * denominator), pa.array(total(within)),
                pa.ListArray.from_arrays(pa.array(np.append(starts, len(codes)), pa.int32()), pa.array(codes, pa.int32())),
                pa.ListArray.from_arrays(cuts, names), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["id", "ord", "training", "n", "known", "base", "within", "codes", "rare", "times"])

        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                words, n, first = [], [], 0
                for i, text in enumerate(part.column(1).to_pylist()):
                    w = tokens(text)
                    words += w
                    words.append(END)
                    n.append(len(w) + 1)
                    if len(words) > 200_000 or i + 1 == part.num_rows:
                        yield table(part.slice(first, len(n)), words, np.array(n))
                        words, n, first = [], [], i + 1

    schema = f"id {kind}, ord long, training boolean, n long, known long, base double, within double, codes array<int>, rare array<binary>, times array<long>"
    return docs.select("id", "text", "ord", "training").mapInArrow(run, schema)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists end to end, and where each list starts and the last ends."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _runs(batches, column: int, limit: int):
    """(batch, first row, codes end to end, starts) of runs of rows with about ``limit`` tokens together."""
    for batch in batches:
        flat, cuts = _flat(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(cuts, cuts[row] + limit)))
            end = min(end, batch.num_rows)
            yield batch, row, flat[cuts[row] : cuts[end]].astype(np.int64), cuts[row:end] - cuts[row]
            row = end


def train(encoded: DataFrame, stats: Statistics, scratch: Scratch) -> LogBilinear:
    """Rounds of copies, one a shard, and their average."""
    spark = encoded.sparkSession
    shards = max(1, min(MOST_SHARDS, math.ceil(stats.total / SHARD_TOKENS)))
    passes = max(1, min(MOST_PASSES, math.ceil(ENOUGH / max(1, stats.total))))
    # a task adds up the copies of its shards, so that as many copies are written as there are tasks
    tasks = min(shards, 8 * spark.sparkContext.defaultParallelism)
    model = LogBilinear(Layout(stats))
    rows = encoded.where("training").select("ord", "codes", F.pmod("ord", F.lit(shards)).alias("shard"), F.pmod(F.shiftright("ord", 24), F.lit(ROUNDS)).alias("slice"))
    for turn in range(ROUNDS if stats.total else 0):
        start = spark.sparkContext.broadcast(model)

        def run(batches, turn=turn, start=start):
            base, sums, trained, shard, held, size = start.value, None, None, None, [], 0

            def learn():
                nonlocal held, size
                codes = np.concatenate([c for c, _ in held]).astype(np.int64)
                at, starts = 0, []
                for c, s in held:
                    starts.append(s + at)
                    at += len(c)
                starts = np.concatenate(starts)
                for _ in range(passes):
                    trained.learn(codes, starts)
                held, size = [], 0

            def close():
                nonlocal sums
                if held:
                    learn()
                sums = sums or {x: np.zeros((len(getattr(base, x)), getattr(base, x).shape[1] + 1), np.float32) for x in base.NAMES}
                for x in base.NAMES:
                    t = trained.times[x]
                    on = np.flatnonzero(t)
                    sums[x][on, :-1] += t[on, None] * (getattr(trained, x)[on] - getattr(base, x)[on])
                    sums[x][on, -1] += t[on]

            for batch in batches:
                numbers = batch.column(0).to_numpy()
                cuts = np.flatnonzero(np.diff(numbers)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(numbers)]):
                    if b == a:
                        continue
                    if numbers[a] != shard:
                        if trained is not None:
                            close()
                        shard, trained = numbers[a], base.copy().prepare(int(numbers[a]) * ROUNDS + turn)
                    flat, cuts = _flat(batch.column(1).slice(a, b - a))
                    row = 0
                    while row < b - a:  # buffers end at the same rows however rows come in batches
                        end = min(b - a, int(np.searchsorted(cuts, cuts[row] + BUFFER - size)))
                        held.append((flat[cuts[row] : cuts[end]], cuts[row:end] - cuts[row]))
                        size += cuts[end] - cuts[row]
                        row = end
                        if size >= BUFFER:
                            learn()
            if trained is not None:
                close()
                for name, m in sums.items():
                    for i in range(0, len(m), ROWS):
                        part = m[i : i + ROWS]
                        if part[:, -1].any():
                            yield pa.record_batch([pa.array([name]), pa.array([i], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["name", "at", "part"])

        dealt = rows.where(F.col("slice") == turn).repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "ord", "codes")
        copies = scratch.keep(dealt.select("shard", "codes").mapInArrow(run, "name string, at long, part binary"), "lm-copies")
        added = copies.repartition("name", "at").sortWithinPartitions("name", "at").mapInArrow(_add_up, "name string, at long, part binary").toArrow()
        model = model.copy()
        for name, at, part in zip(*(added[c].to_pylist() for c in ("name", "at", "part"))):
            m = getattr(model, name)
            x = np.frombuffer(part, np.float32).reshape(-1, m.shape[1] + 1)
            m[at : at + ROWS] += x[:, :-1] / np.maximum(x[:, -1:], 1)
        scratch.drop(copies)
    return model


def _add_up(batches):
    """Sums of parts of one name and place, which come one after another; memory holds one sum."""
    key, total = None, None

    def out():
        return pa.record_batch([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["name", "at", "part"])

    for batch in batches:
        for name, at, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
            x = np.frombuffer(part, np.float32)
            if (name, at) == key:
                total = total + x
            else:
                if key is not None:
                    yield out()
                key, total = (name, at), x
    if key is not None:
        yield out()


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Batches of so many rows for what is run inside, so that texts of any length take less memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, growth: float = GROWTH) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row's whole text.

    * Null texts are empty ones: their only token is the end.
    * Rows with a null id are not for training and are scored like others; rows that
      repeat an id are scored each on its own, and each counts in training.
    * Without training rows every count is 0, and base and model share the mass evenly.
    * The result does not depend on how the rows are partitioned or ordered, but for
      rounding in single precision.
    * An empty table gives an empty result; only the two columns are read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("training", training_fold("id")).withColumn("ord", F.xxhash64(F.col("id").cast("string"), "text"))
    docs = docs.withColumn("text", F.col("text").cast("binary"))  # UTF-8, which needs no decoding on the way to Python
    with batches_of(spark, 4 * ROWS):
        counts = scratch.keep(count_tokens(docs.where("training").select("text")), "lm-counts")
        stats = gather(counts, head, growth)
        encoded = scratch.keep(encode(docs, stats).withColumn("row", F.monotonically_increasing_id()), "lm-encoded")
        shared = spark.sparkContext.broadcast(train(encoded, stats, scratch))
    kind = dict(encoded.dtypes)["id"]

    def run(batches):
        model = shared.value
        for batch, row, codes, starts in _runs(batches, 6, CHUNK):
            z = np.add.reduceat(model.log_probabilities(codes, starts), starts) / LN10
            part = batch.slice(row, len(starts))
            score = part.column(5).to_numpy() + z
            yield pa.record_batch([*part.columns[:5], pa.array(score)], ["row", "id", "n", "known", "base", "score"])

    scored = encoded.select("row", "id", "n", "known", "base", "within", "codes").mapInArrow(run, f"row long, id {kind}, n long, known long, base double, score double")
    # the tokens outside the head find their counts in a join; none of them is frequent, so none is hot
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    tail = rare.join(counts.select("token", "c"), "token", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ALPHA))).alias("logs"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"),
    )
    held = ~training_fold("id") & F.col("id").isNotNull()
    return scored.join(tail, "row", "left").select(
        F.col("id").alias(id_col),
        held.alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(stats.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )
