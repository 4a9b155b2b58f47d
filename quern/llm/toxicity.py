"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel of two strings counts common subsequences of three characters, gaps allowed,
each occurrence weighted by DECAY to the power of the span it covers, and is normalised by
the strings' kernels with themselves.  An insult with inserted characters keeps most of its
subsequences and so most of its similarity.

A text is a bag of short strings: its words without punctuation, runs of single characters
joined (``i d i o t``), long words cut into overlapping windows.  Only texts have labels;
a text is
as toxic as its worst string.  Training alternates (multiple-instance learning)
between picking the string that speaks most for each toxic text and fitting a linear
machine, by hinge loss, on Nyström features: kernels with a few landmark strings, whitened
by the landmarks' own kernel matrix.

The decision function is ``sum_j alpha_j k(x, landmark_j)``.  As the kernel is a product of
explicit subsequence features, the landmarks collapse into one table of weights with a
place for every triple of characters, and a string is scored by visiting its own triples:
exactly the same value, at a cost that does not depend on the number of landmarks.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

DECAY = 0.75
#: Long strings are read through windows of so many characters; a string of up to WINDOW - STEP + 1 is whole in one.
WINDOW, STEP = 14, 2
LANDMARKS = 128
#: Labelled texts that the machine is fitted on at most, of each label.
MOST_TOXIC, MOST_CLEAN = 1500, 3000
#: Characters of a text that it is fitted on at most; longer ones are not fitted on, and scored whole like any other.
LONGEST = 50_000
THRESHOLD = 0.7
#: So many strings of a text count, the worst, none with a larger margin than TOP.
POOLED, TOP = 1, 4.0
#: How clearly a string must be more frequent in toxic texts (about standard deviations) to be taken for the reason.
SPEAKS = 2.0
#: Share of the texts with a string that must be toxic for that.
PRECISE = 0.9
MOST_STRINGS = 250_000

WORD = re.compile(r"\S+")
NOT_LETTERS = re.compile(r"[\W_]+")
#: Letters a-z and digits have places of their own, and so has each triple of them.
_CODES = 37
_EXACT = _CODES**3
#: Triples with any other character share so many places, by a hash of the three.
_HASHED = 1 << 18
_PLACES = _EXACT + _HASHED


def _code(c: str) -> int:
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    if 48 <= o <= 57:
        return 27 + (o - 48)
    return _CODES + o  # every character of every script has a code of its own


def strings(text: str | None) -> set[str]:
    """The distinct strings of a text."""
    out: set[str] = set()
    if not text:
        return out
    single = ""
    for w in set_runs(text):
        if len(w) < 2:  # punctuation alone does not end a run of single characters
            single += w
            continue
        if len(single) > 2:
            out.update(_windows(single))
        single = ""
        out.update((w,) if len(w) <= WINDOW else _windows(w))
    if len(single) > 2:
        out.update(_windows(single))
    return out


def set_runs(text: str) -> list[str]:
    """Words of a text, lower-cased, without punctuation, in order."""
    return [NOT_LETTERS.sub("", w) if not w.isalnum() else w for w in text.lower().split()]


def _windows(w: str) -> list[str]:
    if len(w) <= WINDOW:
        return [w]
    return [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW + STEP, STEP)]


class SubsequenceKernel:
    """Kernels of strings of up to WINDOW characters, by their triples."""

    def __init__(self, decay: float = DECAY):
        self.decay = decay
        i, j, k = np.meshgrid(*[np.arange(WINDOW)] * 3, indexing="ij")
        on = (i < j) & (j < k)
        order = np.argsort(k[on], kind="stable")  # triples within the first n characters come first
        self.i, self.j, self.k = (x[on][order] for x in (i, j, k))
        self.weight = decay ** (self.k - self.i + 1.0)
        self.upto = np.searchsorted(self.k, np.arange(WINDOW + 1))
        self.codes: dict[str, int] = {}

    def encode(self, words: list[str]) -> np.ndarray:
        """Characters as codes, -1 after the end."""
        out = np.full((len(words), WINDOW), -1, np.int64)
        codes = self.codes
        for r, w in enumerate(words):
            for c, x in enumerate(w[:WINDOW]):
                v = codes.get(x)
                if v is None:
                    v = codes[x] = _code(x)
                out[r, c] = v
        return out

    def triples(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and weight of each triple of strings of one length."""
        n = self.upto[length]
        i, j, k = codes[:, self.i[:n]], codes[:, self.j[:n]], codes[:, self.k[:n]]
        place = (i * _CODES + j) * _CODES + k
        other = np.flatnonzero((codes[:, :length] >= _CODES).any(1))
        if len(other):
            x, y, z = (c[other].astype(np.uint64) for c in (i, j, k))
            h = (x * np.uint64(0x9E3779B97F4A7C15) + y) * np.uint64(0xBF58476D1CE4E5B9) + z
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            some = (i[other] >= _CODES) | (j[other] >= _CODES) | (k[other] >= _CODES)
            place[other] = np.where(some, _EXACT + (h >> np.uint64(46)).astype(np.int64), place[other])
        return place, self.weight[:n]

    def by_length(self, words: list[str]):
        lengths = np.array([min(len(w), WINDOW) for w in words])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            for a in range(0, len(at), 20_000):
                part = at[a : a + 20_000]
                yield part, int(n), self.encode([words[i] for i in part])

    def norms(self, codes: np.ndarray, length: int) -> np.ndarray:
        """Square root of each string's kernel with itself; 1 for strings without triples."""
        if length < 3:
            return np.ones(len(codes))
        place, weight = self.triples(codes, length)
        order = np.argsort(place, axis=1, kind="stable")
        sorted_ = np.take_along_axis(place, order, 1)
        w = weight[order]
        total = np.cumsum(w, 1)
        # sum of squares of the weights added up over equal triples
        new = np.ones(sorted_.shape, bool)
        new[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
        last = np.ones(sorted_.shape, bool)
        last[:, :-1] = new[:, 1:]
        row, col = np.nonzero(last)
        ends = total[row, col]
        before = np.concatenate([[0.0], ends[:-1]])
        before[np.concatenate([[True], row[1:] != row[:-1]])] = 0.0
        return np.sqrt(np.bincount(row, (ends - before) ** 2, len(codes)))

    def project(self, words: list[str], table: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Inner product of each string's normalised features with a table of weights.

        Or with several, as columns of a table that has only the places that ``rows`` maps to
        its rows (the last row stands for all others).
        """
        out = np.zeros((len(words), *table.shape[1:]))
        for at, n, codes in self.by_length(words):
            if n < 3:
                continue
            place, weight = self.triples(codes, n)
            if rows is None:
                out[at] = (table[place] @ weight) / self.norms(codes, n)
            else:
                for a in range(0, len(at), 500):
                    out[at[a : a + 500]] = np.einsum("wtm,t->wm", table[rows[place[a : a + 500]]], weight) / self.norms(codes[a : a + 500], n)[:, None]
        return out

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised features of a few strings as columns, one row for each place they use and one of zeros; and the row of each place."""
        found = [(at, *self.triples(codes, n), self.norms(codes, n)) for at, n, codes in self.by_length(words) if n >= 3]
        used = np.unique(np.concatenate([p.ravel() for _, p, _, _ in found])) if found else np.empty(0, int)
        rows = np.full(_PLACES, len(used))
        rows[used] = np.arange(len(used))
        out = np.zeros((len(used) + 1, len(words)))
        for at, place, weight, norm in found:
            for r, c in enumerate(at):
                np.add.at(out[:, c], rows[place[r]], weight / norm[r])
        return out, rows


@dataclass
class Machine:
    """Weights of all triples, bias, and the map from a text's largest margins to a probability."""

    table: np.ndarray = field(repr=False)
    bias: float
    slopes: tuple
    shift: float
    decay: float = DECAY
    #: The landmarks and their weights: the table is the sum of their features times these.
    landmarks: list = field(default_factory=list, repr=False)
    alphas: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)

    def margins(self, kernel: SubsequenceKernel, words: list[str]) -> np.ndarray:
        return kernel.project(words, self.table) + self.bias

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ np.array(self.slopes) + self.shift, -30, 30)))


def pool(margins: list[float], bias: float) -> list[float]:
    """The largest margins of a text's strings, held between the bias, which stands for none, and TOP."""
    top = heapq.nlargest(POOLED, margins)
    return [min(max(m, bias), TOP) for m in top] + [bias] * (POOLED - len(top))


def _insert(word: str, rng: np.random.Generator) -> str:
    """The word with one or two characters put in between."""
    out = list(word)
    for _ in range(int(rng.integers(1, 3))):
        out.insert(int(rng.integers(1, len(out))), "abcdefghijklmnopqrstuvwxyz0123456789"[int(rng.integers(36))])
    return "".join(out)[:WINDOW]


def hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, l2: float = 1e-5, steps: int = 700) -> tuple[np.ndarray, float]:
    """Linear machine by full-batch descent on the squared hinge loss (accelerated), weights c."""
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w.copy(), b
    c = c / c.sum()
    rate = 1 / (2 * (np.linalg.norm(x * np.sqrt(c)[:, None], 2) ** 2 + 1) + l2)
    for t in range(steps):
        miss = np.maximum(0, 1 - y * (x @ vw + vb))
        g = -2 * c * y * miss
        nw, nb = vw - rate * (x.T @ g + l2 * vw), vb - rate * g.sum()
        m = t / (t + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, float(b)


def fit(texts: list[str | None], labels: list[int], landmarks: int = LANDMARKS, decay: float = DECAY, seed: int = 5) -> Machine:
    """Fit on whole labelled texts.  Without both labels the machine says the share of label 1 for all."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, int)
    kernel = SubsequenceKernel(decay)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Machine(np.zeros(_PLACES), 0.0, (0.0,) * POOLED, float(np.log(share / (1 - share))), decay)
    bags = [sorted(strings(t)) for t in texts]
    # how much more often a string is in toxic texts than in clean ones
    seen: dict[str, list[int]] = {}
    for bag, label in zip(bags, y):
        for s in bag:
            seen.setdefault(s, [0, 0])[label] += 1
    n1, n0 = int(y.sum()), int(len(y) - y.sum())

    def speaks(s):
        a, b = seen[s][1], seen[s][0]
        return (a - n1 * (a + b) / (n1 + n0)) / np.sqrt(a + b + 1)

    words = sorted((s for s in seen if len(s) >= 3), key=lambda s: (-speaks(s), s))
    half = landmarks * 3 // 4
    common = sorted(words[half:], key=lambda s: (-seen[s][0], s))[: landmarks - half]
    marks = words[:half] + common
    if not marks:
        share = min(max(n1 / (n0 + n1), 1e-6), 1 - 1e-6)
        return Machine(np.zeros(_PLACES), 0.0, (0.0,) * POOLED, float(np.log(share / (1 - share))), decay)
    tables, rows = kernel.features(marks)
    value, vector = np.linalg.eigh(tables.T @ tables)
    on = value > 1e-6 * value.max()
    whiten = vector[:, on] / np.sqrt(value[on])
    nystroem = tables @ whiten

    # instances: strings of toxic texts that speak for the label, and whatever the machine itself
    # then finds in toxic texts without one; clean strings at large, and those that look worst
    distinct = sorted({s for bag in bags for s in bag if len(s) >= 3})
    at = {s: i for i, s in enumerate(distinct)}
    precise = lambda s: (seen[s][1] + 0.5) / (sum(seen[s]) + 1) >= PRECISE
    clean = [s for s in distinct if seen[s][0] and not (speaks(s) > SPEAKS and precise(s))]
    frequent = sorted(clean, key=lambda s: (-seen[s][0], s))[:1000]
    some = sorted(set(frequent) | {clean[i] for i in rng.choice(len(clean), min(len(clean), 1500), replace=False)}) if clean else []
    toxic_bags = [[s for s in bag if len(s) >= 3] for bag, label in zip(bags, y) if label]
    witness = {s for s in words if speaks(s) > SPEAKS and precise(s)} or set(words[:1])
    positive, negative = [s for bag in toxic_bags for s in bag if s in witness], list(some)
    for _ in range(3):
        number = Counter(positive)
        counted = sorted(number)
        often = np.sqrt([number[s] for s in counted])
        bent = [_insert(s, rng) for s in counted for _ in range(4)]
        x = kernel.project(counted + bent + negative, nystroem, rows)
        target = np.r_[np.ones(len(counted) + len(bent)), -np.ones(len(negative))]
        rarely = np.sqrt([seen[s][0] for s in negative])
        cost = np.r_[often, np.repeat(often, 4) / 4, 2 * often.sum() * rarely / max(1.0, rarely.sum())]
        w, bias = hinge(x, target, cost)
        table = np.append(tables @ (whiten @ w), 0.0)[np.minimum(rows, len(tables))]
        margin = kernel.project(distinct, table) + bias
        picked = [max(bag, key=lambda s: (margin[at[s]], s)) for bag in toxic_bags if bag and not witness.intersection(bag)]
        positive = [s for bag in toxic_bags for s in bag if s in witness] + [s for s in picked if margin[at[s]] > 0 and not seen[s][0]]
        hard = sorted(clean, key=lambda s: -margin[at[s]])[:1000]
        negative = sorted(set(some) | set(hard))
    pooled = np.array([pool([margin[at[s]] for s in bag if len(s) >= 3], bias) for bag in bags])
    slopes, shift = _logistic(pooled, y)
    return Machine(table, float(bias), slopes, shift, decay, marks, whiten @ w)


def _logistic(pooled: np.ndarray, y: np.ndarray) -> tuple[tuple, float]:
    """Logistic map of pooled margins by descent, lightly held; it never falls with a margin."""
    x = np.concatenate([pooled, np.ones((len(pooled), 1))], 1)
    theta = np.zeros(x.shape[1])
    rate = 4 / np.linalg.eigvalsh(x.T @ x / len(x)).max()
    held, pull = theta.copy(), 0.0
    for t in range(4000):
        p = 1 / (1 + np.exp(-np.clip(x @ held, -30, 30)))
        new = held - rate * (x.T @ (p - y) / len(x) + 1e-5 * held)
        new[:-1] = np.maximum(new[:-1], 0)
        held = new + t / (t + 3) * (new - theta)
        theta = new
    return tuple(map(float, theta[:-1])), float(theta[-1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Machine:
    """Fit on labelled documents whose crc32 of the id modulo 3 is not 1.

    Of each label at most ``most_...`` ids are used, the first by a hash of the id, and of each id
    one text, the first by a hash of it, of at most LONGEST characters, so that what the
    driver gets is bounded whatever the tables hold.  Null labels and ids, and labels of
    unknown documents, are left out; of several labels of an id the largest counts.
    """
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(3))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(fold != 1)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64("id")
    take = known.where("label = 1").orderBy(order, "id").limit(most_toxic).union(known.where("label = 0").orderBy(order, "id").limit(most_clean))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where(F.length("text") <= LONGEST)
    one = texts.join(F.broadcast(take), "id").groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text"))
    rows = one.toArrow().to_pylist()
    rows.sort(key=lambda r: r["id"])
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def probability(machine: Machine, spark: SparkSession):
    """A function of a text column: the score in 0..1 of each whole text, by Arrow batches."""
    shared = spark.sparkContext.broadcast(machine)  # one table of weights

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        kernel, known = SubsequenceKernel(m.decay), {}
        for part in parts:
            texts, out = part.to_pylist(), []
            for a in range(0, len(texts), 500):
                bags = [strings(t) for t in texts[a : a + 500]]
                new = list({s for bag in bags for s in bag} - known.keys())
                if new:
                    if len(known) + len(new) > MOST_STRINGS:
                        known.clear()
                        new = list({s for bag in bags for s in bag})
                    known.update(zip(new, m.margins(kernel, new).tolist()))
                out += [pool(list(map(known.__getitem__, bag)), m.bias) for bag in bags]
            yield pa.array(m.probability(np.array(out, float).reshape(-1, POOLED)), pa.float64())

    return F.arrow_udf(run, "double")


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double in 0..1) of each row's whole text.

    A null or empty text, or one without a string of three characters, has the score of
    the machine's bias.  Very long texts are read whole; repeated rows are scored alike;
    null ids stay null; an empty table gives an empty result; only the two columns are read.
    """
    of = probability(machine, docs.sparkSession)
    return docs.select(F.col(id_col), of(F.col(text_col).cast("string")).alias("score"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns.

    Every row is judged on its own text, so rows that share an id, or have none, are kept
    or dropped one by one.
    """
    score = probability(learn(docs, labels, id_col, text_col, label_col), docs.sparkSession)
    return docs.where(score(F.col(text_col).cast("string")) < threshold)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id_col, held_out, score, predicted) of each row; a null id is not held out.  Cases are as in ``score``."""
    machine = learn(docs, labels, id_col, text_col, label_col)
    held = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1
    return score(docs, machine, id_col, text_col).select(id_col, F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
