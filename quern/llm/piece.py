"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut where no piece of the vocabulary can join two characters: before runs of the
mark that stands for a space, and around characters that are pieces of their own only.
What lies between, a chunk, is merged by an agenda of its adjacent pairs of symbols,
ordered by the score of the piece that they make, the leftmost of equals first; a merge puts
the two pairs that it makes on the agenda.  Symbols that are no pieces are spelt in bytes.
The agendas of many chunks are the rows of a matrix, from each of which the best pair is
taken at a time; a long chunk has a heap of its own.

Chunks not seen before are merged once for a batch of texts, and the batch's answers are
held against the sentencepiece library before they are remembered.  Should the two ever
differ, the library's answer counts, and the difference is counted, too.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
#: What an unknown piece is decoded as, unless the model says otherwise.
UNKNOWN = " ⁇ "
#: Chunks that a worker remembers before they become the older half of what it remembers.
MOST_CHUNKS = 300_000
#: Longer chunks are not remembered.
LONGEST_KNOWN = 64
#: Chunks up to so many characters are merged many at a time, in matrices of these widths.
WIDTHS = (4, 8, 12, 16, 24, 32)
#: Chunks whose ids are asked of the library in one text.
CHECKED = 200
#: Chunks of the texts that are merged and checked together.
RUN = 100_000
#: Fields of the model file: where the trainer's and the normaliser's settings are, and their numbers.
TRAINER, NORMALIZER, MODEL_TYPE, UNKNOWN_SURFACE, CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 3, 44, 2, 3, 4, 5
SUFFIX_SPACES, MERGE_TYPE = 24, 2
NEVER = np.iinfo(np.int32).max


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
        yield tag >> 3, data[at : at + size]
        at += size


class PieceAgenda:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            spec = {k: v for k, v in fields(f.read()) if k in (TRAINER, NORMALIZER)}
        trainer, normalizer = dict(fields(spec.get(TRAINER, b""))), dict(fields(spec.get(NORMALIZER, b"")))
        if trainer.get(MODEL_TYPE) != MERGE_TYPE or trainer.get(SUFFIX_SPACES):
            raise ValueError("the vocabulary is not of the merge type, or marks spaces behind words")
        if normalizer.get(CHARSMAP) or normalizer.get(REMOVE_SPACES, 1) or not normalizer.get(DUMMY_PREFIX, 1) or not normalizer.get(ESCAPE_SPACES, 1):
            raise ValueError("this model's normaliser is not supported")
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError("unused pieces are not supported")
        self.ids = {names[i]: i for i in plain}
        #: Smaller is merged earlier.
        self.order = {names[i]: -sp.get_score(i) for i in plain}
        self.bytes_at = next((i for i in range(size) if sp.is_byte(i)), None)
        if self.bytes_at is None or any(names[self.bytes_at + i] != f"<0x{i:02X}>" for i in range(256)):
            raise ValueError("a vocabulary without pieces for all bytes is not supported")
        joins = {c for p in self.ids if len(p) > 1 for c in p if c != SPACE}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or "\n" in joins:
            raise ValueError("pieces that go on over a space are not supported")
        kind = "".join(map(re.escape, sorted(joins)))
        self.chunks = re.compile(f"{SPACE}*[{kind}]+|{SPACE}+|.", re.DOTALL).findall
        surface = trainer.get(UNKNOWN_SURFACE, UNKNOWN.encode())
        self.surface = [names[i].replace(SPACE, " ").encode() for i in range(size)]
        for i in range(size):
            if sp.is_control(i):
                self.surface[i] = b""
            elif sp.is_unknown(i):
                self.surface[i] = surface
            elif sp.is_byte(i):
                self.surface[i] = bytes([i - self.bytes_at])
        self.marked = [names[i].startswith(SPACE) for i in range(size)]
        self.controls = frozenset(i for i in range(size) if sp.is_control(i))
        # symbols are pieces and the characters that they consist of, by number; pairs of them make pieces
        symbols = [*self.ids, *sorted(joins - set(self.ids))]
        number = {x: i for i, x in enumerate(symbols)}
        self.joined = [str(self.ids[x]) if x in self.ids else ",".join(map(str, self._spell(x))) for x in symbols]
        self.of_char = np.full(0x110000, -1, np.int32)
        for x, i in number.items():
            if len(x) == 1:
                self.of_char[ord(x)] = i
        rank = {o: r for r, o in enumerate(sorted(set(self.order.values())))}
        self.size = len(symbols)
        pairs = {number[p[:k]] * self.size + number[p[k:]]: (rank[self.order[p]], number[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks, self.makes = np.array([pairs[x] for x in self.pairs.tolist()], np.int32).T.copy()
        self.line = self.bytes_at + 10
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.merged = self.corrected = 0

    # -- chunks ---------------------------------------------------------------------

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk: pairs of symbols leave the agenda by the score of what they make."""
        symbols, order = list(chunk), self.order
        end = len(symbols)
        agenda = []
        for i in range(end - 1):
            o = order.get(symbols[i] + symbols[i + 1])
            if o is not None:
                agenda.append((o, i, 2))
        if agenda:
            heapq.heapify(agenda)
            after, before = list(range(1, end + 1)), list(range(-1, end - 1))
            while agenda:
                _, i, length = heapq.heappop(agenda)
                a, j = symbols[i], after[i]
                if not a or j >= end or len(a) + len(symbols[j]) != length:
                    continue  # one of the two has been merged since
                symbols[i], symbols[j] = a + symbols[j], ""
                after[i] = k = after[j]
                if k < end:
                    before[k] = i
                    made = symbols[i] + symbols[k]
                    o = order.get(made)
                    if o is not None:
                        heapq.heappush(agenda, (o, i, len(made)))
                h = before[i]
                if h >= 0:
                    made = symbols[h] + symbols[i]
                    o = order.get(made)
                    if o is not None:
                        heapq.heappush(agenda, (o, h, len(made)))
        out, ids = [], self.ids
        for s in symbols:
            if s:
                x = ids.get(s)
                if x is None:
                    out += self._spell(s)
                else:
                    out.append(x)
        return out

    def _spell(self, symbol: str) -> list[int]:
        return [self.bytes_at + b for b in symbol.encode("utf-8", "surrogatepass")]

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of what each pair makes; a rank of NEVER for pairs that make nothing."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        fits = (self.pairs[at] == key) & (a >= 0) & (b >= 0)
        return np.where(fits, self.ranks[at], NEVER), self.makes[at]

    def merge_many(self, chunks: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of chunks of 2 to ``width`` characters, one after the other, and how many each has.

        Each chunk is a row of agenda, whose best pair is merged in each step.
        """
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbols = np.full((len(chunks), width), -1, np.int32)
        symbols[np.arange(width) < sizes[:, None]] = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        agenda, makes = self._look_up(symbols[:, :-1], symbols[:, 1:])
        done, row = symbols, np.arange(len(chunks))
        symbols = symbols.copy()
        place = np.arange(width)
        while len(row):
            best = agenda.argmin(1)
            on = agenda[np.arange(len(row)), best] < NEVER
            done[row[~on]] = symbols[~on]
            row, symbols, agenda, makes, best = row[on], symbols[on], agenda[on], makes[on], best[on]
            here = np.arange(len(row))
            made = makes[here, best]
            # what stands behind the pair moves up by one
            moved = np.minimum(place + (place > best[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, moved, 1)
            symbols[here, best], symbols[:, -1] = made, -1
            moved = np.minimum(place[:-1] + (place[:-1] > best[:, None]), width - 2)
            agenda, makes = np.take_along_axis(agenda, moved, 1), np.take_along_axis(makes, moved, 1)
            agenda[:, -1] = NEVER
            agenda[here, np.minimum(best, width - 2)], makes[here, np.minimum(best, width - 2)] = self._look_up(made, symbols[here, np.minimum(best + 1, width - 1)])
            left = np.flatnonzero(best > 0)
            agenda[left, best[left] - 1], makes[left, best[left] - 1] = self._look_up(symbols[left, best[left] - 1], made[left])
        there = done >= 0
        return done[there], there.sum(1)

    def learn(self, chunks: set[str]) -> None:
        """Merge chunks not seen before and check them all against the library."""
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > MOST_CHUNKS:
            # chunks that go on being met move to the younger half, others are forgotten with the older one
            self.older, self.known = self.known, {}
            new = list(chunks)
        older, fresh = self.older, []
        for c in new:
            ids = older.get(c)
            if ids is None:
                fresh.append(c)
            else:
                self.known[c] = ids
        self.merged += len(fresh)
        groups: dict[int, list[str]] = {}
        for c in fresh:
            groups.setdefault(bisect.bisect_left(WIDTHS, len(c)) if len(c) > 1 else len(WIDTHS), []).append(c)
        for g, some in groups.items():
            if g < len(WIDTHS):
                symbols, counts = self.merge_many(some, WIDTHS[g])
                names = list(map(self.joined.__getitem__, symbols.tolist()))
                ends = np.cumsum(counts).tolist()
                told = [",".join(names[a:b]) for a, b in zip([0, *ends], ends)]
            else:
                told = [",".join(map(str, self.merge(c))) for c in some]
            self._check(some, told)
            self.known.update(zip(some, told))

    def _check(self, chunks: list[str], told: list[str]) -> None:
        """Hold the ids of chunks against the library's; where they differ, ``told`` gets the library's.

        A line break is a piece of its own, so chunks joined by it are encoded as if each stood alone.
        """
        for a in range(0, len(chunks), CHECKED):
            some, line = chunks[a : a + CHECKED], f",{self.line},"
            want = parsed(f"{self.ids[SPACE]}{line}{line.join(told[a : a + CHECKED])}").tolist()
            if self.library.encode("\n" + "\n".join(some).replace(SPACE, " ")) == want:
                continue
            for i, c in enumerate(some, a):
                right = ",".join(map(str, self.library.encode("\n" + c)[2:]))
                if right != told[i]:
                    self.corrected += 1
                    told[i] = right

    # -- texts ----------------------------------------------------------------------

    def split(self, text: str | None) -> list[str]:
        return self.chunks(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_joined(self, texts: list[str | None]) -> Iterator[str]:
        """The ids of each text, joined by commas; memory is bounded by a text, the chunks of a run of texts, and the remembered chunks."""
        run, size = [], 0
        for t in texts:
            run.append(self.split(t))
            size += len(run[-1])
            if size > RUN:
                yield from self._encode(run)
                run, size = [], 0
        yield from self._encode(run)

    def _encode(self, run: list[list[str]]) -> Iterator[str]:
        self.learn(set().union(*run) if run else set())
        known = self.known
        for chunks in run:
            yield ",".join(map(known.__getitem__, chunks))
        for chunks in run:
            for c in chunks:
                if len(c) > LONGEST_KNOWN:
                    known.pop(c, None)
                    self.older.pop(c, None)

    def encode_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for joined in self.encode_joined(texts):
            yield parsed(joined)

    def decode_bytes(self, ids) -> bytes:
        """The decoded text in UTF-8; pieces of bytes that are no valid text become replacement characters."""
        first = 0
        while first < len(ids) and ids[first] in self.controls:
            first += 1
        if first == len(ids):
            return b""
        if not self.controls.isdisjoint(ids):
            return self._mended(ids, first)  # they part bytes
        out = b"".join(map(self.surface.__getitem__, ids))
        if self.marked[ids[first]]:
            out = out[1:]  # the space that every text is given in front
        try:
            out.decode("utf-8")
            return out
        except UnicodeDecodeError:
            return self._mended(ids, first)

    def _mended(self, ids, first: int) -> bytes:
        out, run = [], b""
        for k, i in enumerate([*ids, None]):
            if i is not None and self.bytes_at <= i < self.bytes_at + 256:
                run += self.surface[i]
                continue
            while run:  # a valid character at a time; else one byte is replaced
                for n in range(1, min(4, len(run)) + 1):
                    try:
                        run[:n].decode("utf-8")
                        out.append(run[:n])
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    n = 1
                    out.append("�".encode())
                run = run[n:]
            if i is not None:
                out.append(self.surface[i][1:] if k == first and self.marked[i] else self.surface[i])
        return b"".join(out)

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8")


def parsed(joined: str) -> np.ndarray:
    return np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceAgenda:
    """One encoder per worker process, with what it remembers, for all tasks that the process runs."""
    return PieceAgenda(path)


def _texts(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids array<int>) of each row's whole text.

    A null text is an empty one and gives no ids.  Repeated rows are repeated; null ids stay
    null; an empty table gives an empty result; other columns are not read.  A text is encoded in one
    piece however long it is, and a word of any length costs little more than its length.
    ``path`` must be readable on every executor, as an installed package's file is.
    """

    def run(batches):
        agenda = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a in range(0, len(texts), 200):
                ids = list(agenda.encode_batch(texts[a : a + 200]))
                yield pa.record_batch([keys.slice(a, len(ids)), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = dict(df.dtypes)[id_col]
    return _texts(df, text_col, id_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the decoded text of each row's ids; null ids give an empty text."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        agenda = encoder(path)
        for ids in parts:
            yield ids.map(lambda x: "" if x is None else agenda.decode(x))

    return df.withColumn(out_col, F.pandas_udf(run, "string")(F.col(ids_col)))


def digests(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of each row's encoding and its decoding.

    The digests are made where the ids are, so that neither ids nor texts travel back.
    Cases are as in ``encode``.
    """

    def run(batches):
        agenda, sha = encoder(path), hashlib.sha256
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            n, one, two = [], [], []
            for joined in agenda.encode_joined(texts):
                ids = parsed(joined).tolist()
                n.append(len(ids))
                one.append(sha(joined.encode()).hexdigest())
                two.append(sha(agenda.decode_bytes(ids)).hexdigest())
            yield pa.record_batch([keys, pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(df.dtypes)[id_col]
    out = _texts(df, text_col, id_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
