"""WARC archives as a PySpark data source (format name ``warc``).

Reading.  The reader plans whole files into partitions of about
``PARTITION_BYTES``.  Per record it inflates and parses the headers first;
pushed-down predicates on the record type and the header columns are decided
on these, and a payload that is not wanted (option ``payload``: ``all``,
``none`` or a comma-separated list of record types) is skipped without being
decoded.  Each record is a gzip member of its own whose extra field ``sl``
holds its compressed size, so a skip is a seek; members without it, and plain
archives, are read too.

Writing.  Each task writes files of up to ``ROTATE_BYTES`` under names of its
own; only the files named in a task's commit message enter the manifest, which
the commit writes last and the reader obeys.  Files of lost or repeated tasks
are therefore never read.  Paths are URIs of a file system all nodes share.

Deduplication (``archive``): of payloads of at least ``REVISIT_BYTES``
with equal SHA-256 and size, the smallest id's record is the response and the others
are revisits without a block that refer to it.

Defined cases: null payloads are empty; a null id is a response that is never
referred to; a null URI has no target header; control characters in header
values are percent-encoded; repeated rows revisit the first (a row with the same id
as the response is a response too); an empty table gives an archive without
records; extra columns are not read.  A truncated record raises.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThanOrEqual,
                                    In, InputPartition, IsNotNull, LessThan, WriterCommitMessage)

PARTITION_BYTES = 32 << 20
ROTATE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
CHUNK = 1 << 16
REVISIT_BYTES = 100
LEVEL = 4
MANIFEST = "_manifest.json"
# Header names of the archive format and its revisit profile.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
           "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
           "payload_length": "x-payload-length"}
SCHEMA = ("record_type string, record_id string, target_uri string, date string, content_type string, "
          "payload_digest string, refers_to string, payload_length long, file string, position long, payload binary")
ARROW = pa.schema([(c, pa.string()) for c in ("record_type", "record_id", "target_uri", "date", "content_type",
                                              "payload_digest", "refers_to")]
                  + [("payload_length", pa.int64()), ("file", pa.string()), ("position", pa.int64()), ("payload", pa.binary())])


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member with its size in the extra field."""
    lines = [f"{k}: {_clean(v)}" for k, v in headers if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode()
    raw = head + block + b"\r\n\r\n"
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = c.compress(raw) + c.flush()
    size = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF))


class _Records:
    """The records of one archive file: headers first, payload on demand."""

    def __init__(self, f):
        self.f, self.at, self.end = f, 0, f.size()

    def _member(self):
        """Yield inflated chunks of the member or plain record at ``at``; sets ``skip_to`` if known."""
        self.f.seek(self.at)
        head = self.f.read(CHUNK)
        self.skip_to = None
        if head[:2] != b"\x1f\x8b":
            yield head
            while chunk := self.f.read(CHUNK):
                yield chunk
            return
        flags, p = head[3], 10
        if flags & 4:
            n = struct.unpack_from("<H", head, p)[0]
            extra, q = head[p + 2:p + 2 + n], 0
            while q + 4 <= len(extra):
                size = struct.unpack_from("<H", extra, q + 2)[0]
                if extra[q:q + 2] == b"sl" and size == 8:
                    self.skip_to = self.at + struct.unpack_from("<I", extra, q + 4)[0]
                q += 4 + size
        inflate = zlib.decompressobj(31)
        limit = 1 << 12     # headers first: inflate little until more is asked for
        while True:
            out = inflate.decompress(head, limit)
            if out:
                yield out
                limit = 1 << 18
            if inflate.eof:
                self.skip_to = self.f.tell() - len(inflate.unused_data)
                return
            head = inflate.unconsumed_tail or self.f.read(CHUNK)
            if not head:
                raise ValueError("truncated record")

    def __iter__(self):
        while self.at < self.end:
            chunks, buf = self._member(), b""
            while b"\r\n\r\n" not in buf:
                more = next(chunks, None)
                if more is None:
                    if buf.strip():
                        raise ValueError("truncated record")
                    return
                buf += more
            plain = self.skip_to is None and not self._gzip()
            head, rest = buf.split(b"\r\n\r\n", 1)
            lines = head.decode("utf-8", "replace").split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = int(headers.get("content-length", 0))
            start = self.at

            def block(rest=rest, chunks=chunks, length=length):
                parts, have = [rest], len(rest)
                while have < length:
                    more = next(chunks, None)
                    if more is None:
                        raise ValueError("truncated record")
                    parts.append(more)
                    have += len(more)
                return b"".join(parts)[:length]
            yield start, headers, block
            if plain:
                self.at = start + len(head) + 4 + length + 4
            else:
                if self.skip_to is None:
                    for _ in chunks:
                        pass
                self.at = self.skip_to

    def _gzip(self) -> bool:
        at = self.f.tell()
        self.f.seek(self.at)
        magic = self.f.read(2)
        self.f.seek(at)
        return magic == b"\x1f\x8b"


def payload_of(headers: dict, block: bytes) -> bytes:
    """The payload: what follows the HTTP headers, else the whole block."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


@dataclass
class FileGroup(InputPartition):
    files: list

    def __init__(self, files):
        super().__init__(0)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.wanted = options["path"], options.get("payload", "all")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Predicates on header columns are decided before a payload is touched."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, "set", None))
            elif name == "payload_length" and isinstance(f, GreaterThanOrEqual):
                self.tests.append((name, "from", f.value))
            elif name == "payload_length" and isinstance(f, LessThan):
                self.tests.append((name, "below", f.value))
            else:
                yield f

    def partitions(self):
        fs, root = _open_fs(self.path)
        manifest = f"{root}/{MANIFEST}"
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                files = [(f"{root}/{n}", s) for n, s in json.loads(f.read())]
        else:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            files = [(x.path, x.size) for x in found if re.search(r"\.warc(\.gz)?$", x.path)]
        groups, size = [[]], 0
        for name, n in sorted(files):
            if groups[-1] and size + n > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += n
        return [FileGroup(g) for g in groups]

    def _passes(self, values: dict) -> bool:
        for name, how, want in self.tests:
            v = values.get(name)
            if v is None or (how == "in" and v not in want) or (how == "from" and v < want) or (how == "below" and v >= want):
                return False
        return True

    def read(self, partition):
        wanted = None if self.wanted == "all" else set() if self.wanted == "none" else set(self.wanted.split(","))
        fs, _ = _open_fs(self.path)
        rows, size = [], 0
        for name in partition.files:
            with fs.open_input_file(name) as f:
                for at, headers, block in _Records(f):
                    values = {c: headers.get(h) for c, h in HEADERS.items()}
                    if values["payload_length"] is not None:
                        values["payload_length"] = int(values["payload_length"])
                    if not self._passes(values):
                        continue
                    body = payload_of(headers, block()) if wanted is None or values["record_type"] in wanted else None
                    rows.append(values | {"file": name, "position": at, "payload": body})
                    size += 500 + len(body or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Columns: ``record_type, record_id, target_uri, payload_digest, refers_to, payload_length, payload``."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator):
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        task, files, out, size = uuid.uuid4().hex, [], None, 0
        for b in iterator:
            for r in b.to_pylist():
                if out is None:
                    files.append([f"{task}-{len(files):05d}.warc.gz", 0])
                    out, size = fs.open_output_stream(f"{root}/{files[-1][0]}", compression=None), 0
                size += out.write(record(*_layout(r)))
                files[-1][1] = size
                if size >= ROTATE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages):
        fs, root = _open_fs(self.path)
        for name, _ in (x for m in messages if m for x in m.files):
            fs.delete_file(f"{root}/{name}")


def _layout(r: dict) -> tuple[list, bytes]:
    head = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Target-URI", r["target_uri"]), ("WARC-Payload-Digest", r["payload_digest"]),
            ("X-Payload-Length", str(r["payload_length"]))]
    if r["record_type"] == "revisit":
        return head + [("WARC-Refers-To", r["refers_to"]), ("WARC-Profile", PROFILE)], b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (r["payload"] or b"")
    return head + [("Content-Type", "application/http; msgtype=response")], block


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> None:
    """Write the rows as WARC records to the folder ``path`` (a URI that all nodes reach)."""
    register(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.col(payload_col).alias("text"))
    payload = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    df = src.select("id", "uri", payload.alias("payload")).withColumns(
        {"payload_length": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = (df.where((F.col("payload_length") >= REVISIT_BYTES) & F.col("id").isNotNull())
             .groupBy("payload_digest", "payload_length").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
             .where("copies > 1").drop("copies"))
    df = df.join(first, ["payload_digest", "payload_length"], "left")
    again = F.col("first").isNotNull() & (F.col("id") != F.col("first"))

    def urn(c):
        return F.concat(F.lit("<urn:x-record:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    (df.select(F.when(again, "revisit").otherwise("response").alias("record_type"), urn("id").alias("record_id"),
               F.col("uri").alias("target_uri"), F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
               F.when(again, urn("first")).alias("refers_to"), "payload_length", F.when(again, F.lit(None)).otherwise(F.col("payload")).alias("payload"))
     .write.format("warc").option("path", path).mode("append").save())


def read(spark: SparkSession, path: str, payload: str = "all") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", payload).load()


def key_of(urn_col: str):
    """The id text inside a record's URN."""
    return F.regexp_extract(urn_col, "^<urn:x-record:(.*)>$", 1)
