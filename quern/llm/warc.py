"""WARC archives as a PySpark data source, read and written.

Archives are sequences of gzip members, one per record, or plain.  The writer notes the
length of each member in an extra field of its gzip header (RFC 1952), so that a reader
inflates only a record's header, tests the pushed filters on it, and moves on to the
next member without inflating, or even reading, a payload that nobody wants.  Members
without that field and plain archives are read, too; plain ones skip by Content-Length.

Schema: record_type, record_id, refers_to, target_uri, warc_date, payload_digest string;
payload_bytes long (as stated in the header); headers map<string,string>;
payload binary (null if not wanted or not there).
Options: ``path`` (a folder, or a file), ``payload`` (``true``, ``false``, or ``response``).
Filters on record_type, record_id, refers_to, target_uri, warc_date and payload_digest
are pushed (equality, IN, prefix, null tests, comparisons) where
``spark.sql.python.filterPushdown.enabled`` is on.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,

    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.files import open_filesystem, put
from quern.scratch import scratch_path

SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest"}
FIELD = b"QL"
LENGTH_HEADER = "WARC-Payload-Length"
ROLL_BYTES = 256 << 20
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000


# -- writing ------------------------------------------------------------------------


def clean(value: str) -> str:
    """A header's value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def unclean(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record(record_type: str, record_id: str | None, refers_to: str | None, target_uri: str | None, date: str | None, digest: str | None, size: int | None, payload: bytes | None) -> bytes:
    """One record.  A response's block is an HTTP header and the payload, a revisit's the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if size is None else b"Content-Length: %d\r\n" % size) + b"\r\n"
    block = http + (payload or b"" if record_type != "revisit" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {clean(record_type)}"]
    for name, value in (("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", target_uri), ("WARC-Refers-To", refers_to), ("WARC-Payload-Digest", digest), (LENGTH_HEADER, size)):
        if value is not None:
            lines.append(f"{name}: {clean(str(value))}")
    if record_type == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with its own length in the extra field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHI", 8, FIELD, 4, size)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder = folder
        store, path = open_filesystem(folder)
        if overwrite:
            if store.get_file_info(path).type != fs.FileType.NotFound:
                store.delete_dir(path)
        store.create_dir(path, recursive=True)

    def write(self, batches):
        store, path = open_filesystem(self.folder)
        files, out = [], None
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in cols.items() if n != "headers"}
                if out is None:
                    name = uuid.uuid4().hex
                    files.append((f".{name}", f"part-{name}.warc.gz"))
                    out = store.open_output_stream(f"{path}/.{name}")
                out.write(member(record(row["record_type"] or "", row["record_id"], row["refers_to"], row["target_uri"], row["warc_date"], row["payload_digest"], row["payload_bytes"], row["payload"])))
                if out.tell() >= ROLL_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        for m in messages:
            for temporary, final in m.files if m else ():
                put(self.folder, temporary, final)

    def abort(self, messages):
        store, path = open_filesystem(self.folder)
        for m in messages:
            for temporary, _ in m.files if m else ():
                store.delete_file(f"{path}/{temporary}")


# -- reading ------------------------------------------------------------------------


def parse_header(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = unclean(value.strip())
    return out


class Members:
    """Records of a file: yields (header, take), take() giving the block's bytes.

    What take() does not read is skipped by a seek where the length is known.
    """

    PIECE = 1 << 16

    def __init__(self, file):
        self.file = file

    def __iter__(self):
        file = self.file
        while True:
            at = file.tell()
            head = file.read(12)
            if not head:
                return
            if head[:2] != b"\x1f\x8b":
                yield from self._plain(at)
                return
            size = None
            if head[3] & 4:
                extra = file.read(struct.unpack("<H", head[10:12])[0])
                i = 0
                while i + 4 <= len(extra):
                    n = struct.unpack_from("<H", extra, i + 2)[0]
                    if extra[i : i + 2] == FIELD:
                        size = struct.unpack_from("<I", extra, i + 4)[0]
                    i += 4 + n
            file.seek(at)
            z, data, fed = zlib.decompressobj(31), bytearray(), 0
            first = min(2048, size) if size else 2048

            def feed(n):
                nonlocal fed
                raw = z.unconsumed_tail or file.read(n)
                if not raw:
                    raise ValueError("an archive ends within a record")
                data.extend(z.decompress(raw, 1 << 20))

            while (end := data.find(b"\r\n\r\n")) < 0:
                feed(first)

            def take(end=end):
                while not z.eof:
                    feed(self.PIECE)
                return data

            header = parse_header(bytes(data[:end]))
            body = end + 4

            def block(body=body, header=header):
                whole = take()
                return bytes(whole[body : body + int(header["content-length"])])

            yield header, block
            if size:
                file.seek(at + size)
            else:
                take()
                file.seek(file.tell() - len(z.unused_data))

    def _plain(self, at):
        file = self.file
        while True:
            file.seek(at)
            data = bytearray()
            while (end := data.find(b"\r\n\r\n")) < 0:
                more = file.read(4096)
                if not more:
                    if data.strip():
                        raise ValueError("an archive ends within a record")
                    return
                data += more
            header = parse_header(bytes(data[:end]))
            start, n = at + end + 4, int(header["content-length"])

            def block(start=start, n=n):
                file.seek(start)
                return file.read(n)

            yield header, block
            at = start + n + 4


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a block."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    return payload if gap and head.startswith(b"HTTP/") else block


TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    In: lambda x, v: x is not None and x in v,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
}


@dataclass
class FilePart(InputPartition):
    path: str
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payload: str):
        if payload not in ("true", "false", "response"):
            raise ValueError("option payload is true, false or response")
        self.folder, self.payload, self.tests = folder, payload, []

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", None)
            if column and len(column) == 1 and column[0] in HEADERS:
                name = HEADERS[column[0]]
                if type(f) in TESTS:
                    self.tests.append((name, type(f), f.value))
                    continue
                if type(f) in (IsNull, IsNotNull):
                    self.tests.append((name, type(f), None))
                    continue
            yield f

    def wanted(self, header: dict) -> bool:
        for name, kind, value in self.tests:
            x = header.get(name)
            if kind is IsNull or kind is IsNotNull:
                if (x is None) != (kind is IsNull):
                    return False
            elif not TESTS[kind](x, value):
                return False
        return True

    def partitions(self):
        store, path = open_filesystem(self.folder)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.folder)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = [FilePart(f.path, f.size) for f in found if f.type == fs.FileType.File and re.search(r"(^|/)[^./_][^/]*\.warc(\.gz)?$", f.path)]
        return sorted(files, key=lambda f: (-f.size, f.path)) or [FilePart("", 0)]

    def read(self, part):
        if not part.path:
            return
        store, _ = open_filesystem(self.folder)
        kinds = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [*HEADERS, "payload_bytes", "headers", "payload"]
        rows, held = [], 0
        with store.open_input_file(part.path) as file:
            for header, block in Members(file):
                if not self.wanted(header):
                    continue
                kind = header.get("warc-type")
                payload = None
                if kind != "revisit" and (self.payload == "true" or self.payload == kind):
                    payload = payload_of(block())
                size = header.get(LENGTH_HEADER.lower())
                rows.append([header.get(h) for h in HEADERS.values()] + [int(size) if size and size.isdigit() else None, list(header.items()), payload])
                held += len(payload or b"") + 500
                if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower())

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# -- archives of pages ----------------------------------------------------------------

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Records of pages: of equal payloads of at least ``least`` bytes the page of the least id
    is a response and the others are revisits of it.

    Only the digests meet to find the least id, in an aggregate that combines before it
    shuffles; the pages then join those of more than one row, and adaptive execution
    splits a digest that very many pages share.  A null payload is an empty one, a
    null url leaves out the header, null ids revisit the least id (or are responses if no
    page of the payload has an id), and rows that repeat the least id are responses.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = p.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    return p.join(first, "digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("id")).alias("record_id"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("warc_date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        "payload_bytes",
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, folder: str, **columns) -> None:
    """Write the records of pages to archives below ``folder``."""
    register(pages.sparkSession)
    page_records(pages, **columns).write.format("warc").mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str, id_col: str = "page_id") -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to) of archived pages.

    A response's size and digest are taken from its payload, a revisit's from its header.
    """
    register(spark)
    r = spark.read.format("warc").option("payload", "response").load(folder)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
    response = F.col("record_type") == "response"
    return r.select(
        number("record_id").alias(id_col),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        F.when(~response, number("refers_to")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    archive(pages, folder, **columns)
    return read_pages(pages.sparkSession, folder)
