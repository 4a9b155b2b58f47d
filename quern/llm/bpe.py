"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes tokens for a word.  A sequence of tokens is the
result of the merges if and only if each adjacent pair is: the merges that build
the two sides must never prefer one across the border.  That test runs on NumPy
arrays over all adjacent pairs of all proposed words at once, undoing the later
of the two sides' merges step by step.  Only words with a failing pair go through
exact merging.  Encoded words are remembered, so that a text costs little more
than splitting it.

Supported are tokenizer files whose model is BPE over byte-level characters with
a word-end suffix, with NFC, white space and lower-case normalisers.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Words that a worker remembers before they become the older half of what it remembers.
MOST_WORDS = 150_000
#: Longer words are not remembered, so that what is remembered is bounded in bytes, too.
LONGEST_KNOWN = 256
#: Symbols from which on a word is merged by a heap.
LONG = 64
#: First characters by which the lengths of tokens are known.
HEAD = 3


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class SpeculativeBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("this kind of tokenizer is not supported")
        self.path, self.suffix = path, model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = token
        names = [n["type"] for n in spec["normalizer"]["normalizers"]]
        parts = spec["pre_tokenizer"]["pretokenizers"]
        if names != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"] or not parts[0]["invert"] or parts[1]["use_regex"] or parts[1]["add_prefix_space"]:
            raise ValueError("this tokenizer's normaliser or splitter is not supported")
        self.words = regex.compile(parts[0]["pattern"]["Regex"]).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        #: Characters on which all Unicode versions and regular expression engines agree.
        self.plain = regex.compile(r"[\x00-\x1b\x20-\x7e\xa0-ɏ‐-‧‰-⁞]*").fullmatch
        self.library = None
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(merges)}
        left, right, made = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        self.joined = {}
        for r, (a, b) in enumerate(merges):
            c = self.vocab[a + b]
            self.joined[self.vocab[a], self.vocab[b]] = c
            if made[c] < 0:
                left[c], right[c], made[c] = self.vocab[a], self.vocab[b], r
        self.left, self.right, self.made = left, right, made
        pairs = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(pairs)
        self.pair_keys, self.pair_ranks, self.size = pairs[order], np.array(list(self.rank.values()))[order], size
        self.chars = byte_characters()
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.proposals: dict[str, int] = {}
        # a token may be proposed only if the merges really build it from its own characters
        ok = self.whole_tokens()
        self.proposals = {t: i for t, i in self.vocab.items() if ok[i]}
        self.longest = max(map(len, self.proposals), default=1)
        # longest token that begins with the same characters: no longer match can start there
        self.reach: dict[str, int] = {}
        for t in self.proposals:
            self.reach[t[:HEAD]] = max(len(t), self.reach.get(t[:HEAD], 0))
        self.texts = list(map(str, range(size)))
        self.speculated = self.merged = 0

    # -- verification ---------------------------------------------------------------

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, a huge number where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges keep the border between each two tokens (up to the merge ``limit``).

        The state next to the border just before merge r consists of the right edge of
        the left token and the left edge of the right token, as far as merges before r
        have built them.  Walking back in time, a merge across the border that comes
        before the merges that have consumed either side would have happened.
        """
        a, b = a.copy(), b.copy()
        until = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.astype(np.int64).copy()
        fine, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y, u = a[open_], b[open_], until[open_]
            bad = self.pair_rank(x, y) < u
            fine[open_[bad]] = False
            open_, x, y = open_[~bad], x[~bad], y[~bad]
            ra, rb = self.made[x], self.made[y]
            # of two equal merges the left token's comes first, so the right one is undone first
            undo_left = ra > rb
            # the pair must not merge before the undone merge is made; a pair of the same rank as the
            # right token's own merge would have been taken first, being further left
            until[open_] = np.where(undo_left, ra, rb + 1)
            a[open_] = np.where(undo_left, self.right[x], x)
            b[open_] = np.where(undo_left, y, self.left[y])
            open_ = open_[np.maximum(ra, rb) >= 0]
        return fine

    def whole_tokens(self) -> np.ndarray:
        """Which tokens the merges build from their characters."""
        ok = np.ones(self.size, bool)
        c = np.flatnonzero(self.made >= 0)
        c = c[np.argsort(self.made[c])]
        fine = self.compatible(self.left[c], self.right[c], self.made[c])
        for i, f in zip(c, fine):
            ok[i] = f and ok[self.left[i]] and ok[self.right[i]]
        return ok

    # -- words ----------------------------------------------------------------------

    def _symbols(self, word: str) -> list[str]:
        s = [self.chars[b] for b in word.encode("utf-8", "surrogatepass")]
        s[-1] += self.suffix
        return s

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None if some character is in no token."""
        text = "".join(self.chars[b] for b in word.encode("utf-8", "surrogatepass"))
        end, at, out, known, suffix, reach = len(text), 0, [], self.proposals, self.suffix, self.reach
        while at < end:
            token = None
            if end - at <= self.longest:
                token = known.get(text[at:] + suffix)
                if token is not None:
                    out.append(token)
                    return out
            # without the word's last character, which carries the suffix
            stop = min(end - 1 if suffix else end, at + max(reach.get(text[at : at + HEAD], 0), HEAD - 1))
            while stop > at:
                token = known.get(text[at:stop])
                if token is not None:
                    break
                stop -= 1
            if token is None:
                return None
            out.append(token)
            at = stop
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: again and again the pair of least rank, leftmost first.

        Short words keep the ranks of their pairs in a list.  Long ones keep their pairs in a heap and
        their symbols in a linked list, so the time grows hardly faster than the word.
        """
        ids = [self.vocab[s] for s in self._symbols(word) if s in self.vocab]
        if len(ids) > LONG:
            return self._merge_long(ids)
        rank, joined, none = self.rank.get, self.joined, len(self.rank)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            # only the pairs beside a merge change
            i = ranks.index(least)
            ids[i : i + 2] = [joined[ids[i], ids[i + 1]]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        end, rank = len(ids), self.rank
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= end or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = self.joined[a, b], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < end:
                    r = rank.get((ids[left], ids[right]))
                    if r is not None:
                        heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def learn(self, words: set[str]) -> None:
        """Encode words not seen before: propose, test all adjacent pairs at once, merge the rest."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MOST_WORDS:
            # words that go on being met move to the younger half, others are forgotten with the older one
            self.older, self.known = self.known, {}
            new = list(words)
        older = self.older
        words = []
        for w in new:
            ids = older.get(w)
            if ids is None:
                words.append(w)
            else:
                self.known[w] = ids
        proposed = [self.propose(w) for w in words]
        first, second, owner = [], [], []
        for i, p in enumerate(proposed):
            if p and len(p) > 1:
                first += p[:-1]
                second += p[1:]
                owner += [i] * (len(p) - 1)
        failing = set()
        if first:
            fine = self.compatible(np.array(first, np.int64), np.array(second, np.int64))
            failing = set(np.array(owner)[~fine].tolist())
        self.speculated += len(words)
        for i, (w, p) in enumerate(zip(words, proposed)):
            if p is None or i in failing:
                self.merged += 1
                p = self.merge(w)
            self.known[w] = tuple(p)  # tuples of numbers are nothing to the garbage collector

    # -- texts ----------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """Normalise and split a piece of text without special tokens."""
        if self.plain(text):
            # a final sigma is lowered like any other here, unlike in str.lower
            return self.words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.bytes_of = {c: b for b, c in enumerate(self.chars)}
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes_of[c] for c in w).decode("utf-8", "surrogatepass") for w, _ in parts]

    def pieces(self, text: str | None) -> list:
        """Words as strings, special tokens as ids."""
        if not text:
            return []
        if self.split_special is None or not any(s in text for s in self.special):
            return self.split(text)
        out = []
        for part in self.split_special(text):
            out += [self.special[part]] if part in self.special else self.split(part)
        return out

    def encode_batch(self, texts: list[str | None]):
        """Yield the ids of each text; memory is bounded by a text, the words of a run of texts, and the remembered words."""
        run, size = [], 0
        for t in texts:
            run.append(self.pieces(t))
            size += len(run[-1])
            if size > 100_000:
                yield from self._encode(run)
                run, size = [], 0
        yield from self._encode(run)

    def _encode(self, run: list[list]):
        words = set().union(*run)
        special = {w for w in words if w.__class__ is not str}
        words -= special
        self.learn(words)
        known = self.known
        ids_of = known.__getitem__ if not special else lambda w: (w,) if w.__class__ is not str else known[w]
        for p in run:
            yield list(chain.from_iterable(map(ids_of, p)))
        for w in words:
            if len(w) > LONGEST_KNOWN:
                known.pop(w, None)
                self.older.pop(w, None)

    def decode(self, ids) -> str:
        """Tokens of a file without a decoder are joined by spaces."""
        return " ".join(map(self.strings.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> SpeculativeBPE:
    """One encoder per worker process, with what it remembers, for all tasks that the process runs."""
    return SpeculativeBPE(path)


def encode(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(id_col, ids array<int>[, decoded string]) of each row's whole text.

    A null text is an empty one and gives no ids.  Ids and texts of repeated rows are
    repeated; null ids stay null; an empty table gives an empty result; other columns
    are not read.  Very long texts are encoded in one piece.  ``path`` must be readable
    on every executor, as an installed package's file is.
    """

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a in range(0, len(texts), 200):
                ids = list(bpe.encode_batch(texts[a : a + 200]))
                columns = [keys.slice(a, len(ids)), pa.array(ids, pa.list_(pa.int32()))]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.record_batch(columns, ["id", "ids", "decoded"][: len(columns)])

    kind = dict(df.dtypes)[id_col]
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the decoded text of each row's ids; null ids give an empty text."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(path)
        for ids in parts:
            yield ids.map(lambda x: "" if x is None else bpe.decode(x))

    return df.withColumn(out_col, F.pandas_udf(run, "string")(F.col(ids_col)))


def digests(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of each row's encoding and its decoding.

    The digests are made where the ids are, so that neither ids nor texts travel back.
    Cases are as in ``encode``.
    """

    def run(batches):
        bpe, sha = encoder(path), hashlib.sha256
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            n, one, two = [], [], []
            for ids in bpe.encode_batch(texts):
                n.append(len(ids))
                one.append(sha(" ".join(map(bpe.texts.__getitem__, ids)).encode()).hexdigest())
                two.append(sha(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.record_batch([keys, pa.array(n, pa.int64()), pa.array(one), pa.array(two)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(df.dtypes)[id_col]
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
