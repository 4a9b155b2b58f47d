"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their key, in blocks:

    magic | block ... | index | Bloom filter | footer

A block is a zstd frame of entries ``shared, suffix, value`` lengths as varints, the
key's suffix after the bytes it shares with the key before, and the value: the ids as
little-endian unsigned 32-bit integers.  The sparse index has for each block its last
key, place and the number of documents and ids before it; the footer, of fixed size,
has the places of index and filter.  A lookup asks the filter, searches the index by
bisection, and reads one block.

Documents are range-partitioned by id, so that shards follow each other in order, and
a shard is one task's file: written under a name of its own, then moved in place, so
that a lost executor's task can be repeated.  The manifest has one row per shard.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.files import open_filesystem, put

MAGIC = b"QSSTv001"
FOOTER = struct.Struct("<QQQQQQ8s")
INDEX = struct.Struct("<QQQQ")
BLOCK_BYTES = 64 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
MOST_PIECES = 700_000
# fixed value: the pattern by which byte-level tokenizer files split text, in terms of Python's
# classes; on the characters of PLAIN both say the same
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Characters whose classes no Unicode version has changed, and whose digits are ASCII's.
PLAIN = r"[\x00-\x1b\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞]*"


def key_of(doc_id: int | None) -> bytes:
    """Eight bytes that sort like the number; the empty key, first of all, for null."""
    return b"" if doc_id is None else (int(doc_id) + 2**63).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - 2**63 if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(key: bytes, size: int) -> list[int]:
        a, b = xxhash.xxh64_intdigest(key), xxhash.xxh64_intdigest(key, 1) | 1
        return [(a + i * b) % (1 << 64) % size for i in range(BLOOM_HASHES)]

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        size = max(64, len(keys) * BLOOM_BITS + 7 & ~7)
        flags = np.zeros(size, np.uint8)
        for k in keys:
            flags[cls.places(k, size)] = 1
        return cls(np.packbits(flags))

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (7 - (p & 7)) & 1 for p in self.places(key, len(self.bits) * 8))


class TableWriter:
    """Writes entries, which must come in ascending order of their keys, to a binary stream."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES):
        self.out, self.block_bytes, self.at = out, block_bytes, len(MAGIC)
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.block, self.held, self.last = [], 0, b""
        self.index, self.keys, self.docs, self.ids, self.before = [], [], 0, 0, (0, 0)
        out.write(MAGIC)

    def add(self, key: bytes, value: bytes) -> None:
        if self.docs and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block.append(_varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:])
        self.block.append(value)
        self.held += len(value) + 16
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(value) // 4
        if self.held >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.pack(b"".join(self.block))
            self.out.write(data)
            self.index.append(_varint(len(self.last)) + self.last + INDEX.pack(self.at, len(data), *self.before))
            self.at += len(data)
            self.block, self.held, self.before = [], 0, (self.docs, self.ids)

    def close(self) -> None:
        self.flush()
        index, bloom = b"".join(self.index), Bloom.of(self.keys).bits.tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids, MAGIC))


class Table:
    """Reads a shard from a seekable binary file."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        at, size, self.bloom_at, self.bloom_size, self.docs, self.ids, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard, or cut off")
        data, self.last_keys, self.blocks, i = self._read(at, size), [], [], 0
        while i < len(data):
            n, i = _read_varint(data, i)
            self.last_keys.append(data[i : i + n])
            self.blocks.append(INDEX.unpack_from(data, i + n))
            i += n + INDEX.size
        self.bloom = None

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, i: int):
        """(key, ids before it in the shard, value) of each entry of a block."""
        at, size, _, start = self.blocks[i]
        data, j, key = zstandard.ZstdDecompressor().decompress(self._read(at, size)), 0, b""
        while j < len(data):
            shared, j = _read_varint(data, j)
            rest, j = _read_varint(data, j)
            n, j = _read_varint(data, j)
            key = key[:shared] + data[j : j + rest]
            j += rest
            yield key, start, data[j : j + n]
            start += n // 4
            j += n

    def __iter__(self):
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents under a key."""
        if self.bloom is None:
            self.bloom = Bloom(np.frombuffer(self._read(self.bloom_at, self.bloom_size), np.uint8))
        key, out = key_of(doc_id), []
        if key not in self.bloom:
            return out
        for i in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            for k, _, value in self.block(i):
                if k == key:
                    out.append(np.frombuffer(value, "<u4"))
                elif k > key:
                    return out
        return out


class PieceEncoder:
    """The tokenizers library's ids of texts as bytes, remembering those of their pieces.

    Merges never cross the pieces into which a byte-level tokenizer splits a text, so the
    library need encode a piece only once.  New pieces of a run of texts go to it together:
    those that are a blank and letters as one text, which splits at the blanks again.  A
    text with special tokens, or with other characters than the plain ones, goes to the
    library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = re.compile(PIECES).findall
        self.plain = re.compile(PLAIN).fullmatch
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        joined = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        for a in range(0, len(joined), 1000):
            part = joined[a : a + 1000]
            e = self.tokenizer.encode("".join(part), add_special_tokens=False)
            ids, word = np.array(e.ids, "<u4"), np.array(e.word_ids)
            ends = np.append(np.flatnonzero(np.diff(word)) + 1, len(ids))
            if len(ends) != len(part):
                raise ValueError("the tokenizer splits text in another way")
            data, at = ids.tobytes(), 0
            for p, end in zip(part, ends.tolist()):
                self.known[p] = data[at : 4 * end]
                at = 4 * end
        rest = [p for p in pieces if not (p[0] == " " and p[1:].isalpha())]
        self.known.update(zip(rest, self._library(rest)))

    def encode_batch(self, texts: list[str | None]):
        """Yield the ids of each text; runs of texts bound the memory."""
        run, size = [], 0
        for t in texts:
            if not t:
                run.append([])
            elif self.plain(t) and not any(s in t for s in self.special):
                run.append(self.find(t))
            else:
                run.append(self._library([t])[0])
            size += len(run[-1])
            if size > 100_000:
                yield from self._encode(run)
                run, size = [], 0
        yield from self._encode(run)

    def _encode(self, run: list):
        pieces = {p for x in run if x.__class__ is list for p in x}
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > MOST_PIECES:
            self.known.clear()
            new = list(pieces)
        self._learn(new)
        known = self.known.__getitem__
        for x in run:
            yield b"".join(map(known, x)) if x.__class__ is list else x

    def encode(self, text: str | None) -> bytes:
        return next(iter(self.encode_batch([text])))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process, with what it remembers, for all tasks that the process runs."""
    return PieceEncoder(path)


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode each row's whole text and write shards in ascending order of the id.

    Returns the manifest: shard, file, n_docs, n_ids, first and last key, and start (ids in the
    shards before), one entry per shard, in order.  A null text is an empty one and gives
    the end id only.  Rows that repeat an id follow each other, ordered by a hash of the
    text, and may go on in the next shard, so that an id (or none) that very many rows
    have fills no single shard unless their texts are equal, too; null ids come first.
    An empty table gives no shards.  Other columns are not read.
    """

    def run(batches):
        store, path = open_filesystem(folder)
        shard = TaskContext.get().partitionId()
        final, temporary = f"shard-{shard:06d}.sst", f".shard-{shard:06d}-{uuid.uuid4().hex}"
        first, table, end = None, None, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if table is None and batch.num_rows:
                out = store.open_output_stream(f"{path}/{temporary}")
                table = TableWriter(out)
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                first = key_of(part.column(0)[0].as_py()) if first is None else first
                for key, ids in zip(part.column(0).to_pylist(), encoder(tokenizer).encode_batch(part.column(1).to_pylist())):
                    table.add(key_of(key), ids + end)
        if table is not None:
            table.close()
            out.close()
            put(folder, temporary, final)
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([final]), pa.array([table.docs], pa.int64()), pa.array([table.ids], pa.int64()), pa.array([first], pa.binary()), pa.array([table.last], pa.binary())], ["shard", "file", "n_docs", "n_ids", "first", "last"])

    store, path = open_filesystem(folder)
    store.create_dir(path, recursive=True)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = F.col("id").asc_nulls_first(), F.xxhash64("text").asc()
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    done = sorted(ordered.mapInArrow(run, "shard long, file string, n_docs long, n_ids long, first binary, last binary").collect(), key=lambda r: r.shard)
    for left in store.get_file_info(fs.FileSelector(path)):  # of tasks that were lost
        if left.base_name.startswith(".shard-"):
            store.delete_file(left.path)
    out, start = [], 0
    for r in done:
        out.append(r.asDict() | {"start": start, "first": bytes(r["first"]), "last": bytes(r["last"])})
        start += r.n_ids
    return out


def read(spark: SparkSession, folder: str, manifest: list[dict], id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32[, ids array<long>]) of each document in the shards; one task per shard."""
    shards = [(m["file"], m["start"], m["n_docs"], m["n_ids"]) for m in manifest]

    def run(batches):
        store, path = open_filesystem(folder)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                file, base, docs, n_ids = shards[i]
                rows = []
                with store.open_input_file(f"{path}/{file}") as f:
                    table = Table(f)
                    if (table.docs, table.ids) != (docs, n_ids):
                        raise ValueError(f"{file} is not the file of the manifest")
                    for key, start, value in table:
                        rows.append((id_of(key), base + start, len(value) // 4, zlib.crc32(value)) + ((np.frombuffer(value, "<u4").astype(np.int64),) if ids else ()))
                        if len(rows) >= 2000:
                            yield _rows(rows, ids)
                            rows = []
                if rows:
                    yield _rows(rows, ids)

    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _rows(rows: list, ids: bool) -> pa.RecordBatch:
    names, kinds = ["id", "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4
    if ids:
        names, kinds = [*names, "ids"], [*kinds, pa.list_(pa.int64())]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def lookup(folder: str, manifest: list[dict], doc_id: int | None) -> list[np.ndarray]:
    """Ids of the documents under a key: a binary search of the manifest, then the filters and indexes of the shards that may have it."""
    store, path = open_filesystem(folder)
    key, found = key_of(doc_id), []
    for m in manifest[bisect.bisect_left([m["last"] for m in manifest], key) :]:
        if m["first"] > key:
            break
        with store.open_input_file(f"{path}/{m['file']}") as f:
            found += Table(f).get(doc_id)
    return found
