"""WARC archives: a Python data source that writes and reads them.

Writing: `df.write.format("warc")`. Each record is a gzip member of its own, so any reader of such archives can begin at any record. The
member's length stands in its header (the extra field `sl`), so a record can be passed over without being inflated. Files are begun
anew at PARTITION bytes, written under a name that readers pass over, and get their own when the job commits. A payload that other records share is
stored once, in a `response`; the others are `revisit` records that refer to it and have no block.

Reading: `spark.read.format("warc")`. Files are planned into partitions by their bytes. A record's header block is parsed first, from the first
inflated bytes of its member; records whose type or headers fail a pushed predicate are skipped, and so are all payloads if payloads are
not wanted. Archives without lengths, compressed as a whole or not at all, are read from end to end.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .common import new_folder

END = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PARTITION = 32 << 20  # bytes of archives that one task reads, about
SCHEMA = "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload string"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 40 hexadecimal digits, 5 bits at a time."""
    digits = F.sha1(data)
    out = []
    for k in range(0, 40, 5):
        n = F.conv(F.substring(digits, k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to.

    Of records with equal payloads of at least `least` bytes, the one with the largest page_id is the response. Null html is an empty
    payload. Rows that repeat the largest page_id are responses all; a null page_id revisits, or is a response where its payload has no page_id.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumns({"payload_digest": base32_sha1(F.col("payload").cast("binary")), "payload_bytes": F.octet_length("payload").cast("long")})
    # aggregated before the join, so a payload that a third of all pages share is one row; the join then splits that key
    last = p.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("_last"))
    p = p.join(last, "payload_digest", "left")
    again = F.coalesce(F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last")), F.lit(False))
    return p.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_last"))}).drop("_last")


def _system(path: str):
    """The file system of a path, and the path on it."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if rest else path
    return fs.FileSystem.from_uri(path)


def _member(data: bytes) -> bytes:
    """A gzip member that tells its own length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _record(page_id: int | None, url: str | None, payload: str, digest: str, size: int, kind: str, refers_to: int | None) -> bytes:
    own = kind == "response"
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", None if page_id is None else f"<urn:page:{page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else url.replace("\r", "%0A").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", None if own else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", None if own else f"<urn:page:{refers_to}>"),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(size if own else 0)),
    ]
    head = "".join(f"{k}: {v}{END}" for k, v in lines if v is not None)
    return f"WARC/1.1{END}{head}{END}{payload if own else ''}{END}{END}".encode()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.most = int(options.get("partitionbytes", PARTITION))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, at = _system(self.path)
        system.create_dir(at, recursive=True)
        names, out, size = [], None, 0
        try:
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to")), strict=True):
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{at}/_{names[-1]}", compression=None), 0
                    member = _member(_record(*row))
                    out.write(member)
                    size += len(member)
                    if size >= self.most:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _system(self.path)
        system.create_dir(at, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{at}/_{name}", f"{at}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _system(self.path)
        for m in messages:
            for name in m.names if m else ():
                with contextlib.suppress(OSError):
                    system.delete_file(f"{at}/_{name}")


def write_warc(records: DataFrame, path: str, partition_bytes: int = PARTITION) -> None:
    """Write what plan_records() gives as archives below path, a member for each record."""
    records.sparkSession.dataSource.register(WarcSource)
    records.select("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to").write.format("warc").option("partitionBytes", str(partition_bytes)).mode("append").save(path)


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Archives below path with their bytes, listed by Spark, so on any file system it reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


class Files(InputPartition):
    def __init__(self, paths: tuple[str, ...]):
        self.paths = paths


def _head(block: bytes) -> dict[str, str]:
    """Names (in lower case) and values of a header block."""
    out = {}
    for x in block.splitlines()[1:]:
        name, _, value = x.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _streamed(f, path: str) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
    """The records of an archive without lengths of members. A block is read if asked for, else passed over."""
    while first := f.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record begins at byte {f.tell() - len(first)}")
        lines = [first]
        while (x := f.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(x)
        head = _head(b"".join(lines))
        n = int(head["content-length"])
        asked: list[bytes] = []

        def block(n=n, asked=asked) -> bytes:
            asked.append(f.read(n))
            return asked[0]

        yield head, block
        f.seek(4 if asked else n + 4, 1)


def _members(f, path: str, chunk: int = 4096) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
    """The records of an archive whose members tell their lengths: only so much of one is inflated as is asked for."""
    at = 0
    while fixed := f.read(12):
        if fixed[:3] != b"\x1f\x8b\x08" or not fixed[3] & 4:
            raise ValueError(f"{path}: no member with a length begins at byte {at}")
        extra = f.read(struct.unpack("<H", fixed[10:12])[0])
        size = struct.unpack("<I", extra[4:8])[0]
        left = size - 12 - len(extra) - 8
        d = zlib.decompressobj(-15)
        raw = f.read(min(chunk, left))
        left -= len(raw)
        text = d.decompress(raw)
        while b"\r\n\r\n" not in text and left:
            raw = f.read(min(chunk, left))
            left -= len(raw)
            text += d.decompress(raw)
        top, _, rest = text.partition(b"\r\n\r\n")
        if not top.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record in the member at byte {at}")
        head = _head(top)

        def block(d=d, rest=rest, left=left, n=int(head["content-length"])) -> bytes:
            return (rest + d.decompress(f.read(left)) + d.flush())[:n]

        yield head, block
        at += size
        f.seek(at)


@contextlib.contextmanager
def _records(path: str):
    """Header blocks of a file's records, each with a function that reads its payload."""
    system, at = _system(path)
    with system.open_input_file(at) as f:
        start = f.read(16)
        f.seek(0)
        if start[:2] != b"\x1f\x8b":
            yield _streamed(io.BufferedReader(f), path)
        elif len(start) > 13 and start[3] & 4 and start[12:14] == b"sl":
            yield _members(f, path)
        else:
            with gzip.GzipFile(fileobj=f) as g:
                yield _streamed(g, path)


def _number(header: str | None) -> int | None:
    return int(header.strip("<>").rpartition(":")[2]) if header else None


_TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.files = [x.rsplit("|", 1) for x in options.get("files", options.get("path", "") + "|0").split("\n") if x]
        self.most = int(options.get("partitionbytes", PARTITION))
        self.payload = options.get("payload", "true").lower() == "true"
        self.names = [f.name for f in schema.fields]
        self.schema = schema
        self.tests: list[tuple[str, type, object]] = []
        self.push = options.get("onequery", "false").lower() == "true"

    def pushFilters(self, filters: list[Filter]):
        """Predicates on what the headers say are taken; others are left to Spark.

        Only if the option oneQuery is set: Spark keeps a loaded relation's reader with the filters of the first query that it serves, so
        another query of the same DataFrame would miss rows.
        """
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if self.push and name in self.names and name != "payload" and (type(f) in _TESTS or isinstance(f, IsNotNull)):
                self.tests.append((name, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out, now, size = [], [], 0
        for path, n in self.files:
            if now and size + int(n) > self.most:
                out.append(Files(tuple(now)))
                now, size = [], 0
            now.append(path)
            size += int(n)
        return [*out, Files(tuple(now))] if now else out or [Files(())]

    def _fits(self, row: dict) -> bool:
        return all((v := row[name]) is not None and (kind is IsNotNull or _TESTS[kind](v, x)) for name, kind, x in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows, held = to_arrow_schema(self.schema), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], f.type) for n, f in zip(self.names, schema, strict=True)], schema=schema)

        for path in partition.paths:
            with _records(path) as found:
                for head, block in found:
                    kind, n = head["warc-type"], int(head["content-length"])
                    row = {
                        "page_id": _number(head.get("warc-record-id")), "record_type": kind, "target_uri": head.get("warc-target-uri"), "payload": None,
                        "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": int(head.get("x-payload-length", n)), "refers_to": _number(head.get("warc-refers-to")),
                    }
                    if self._fits(row) and self.payload and kind != "revisit":
                        data = block()
                        if len(data) != n or base64.b32encode(hashlib.sha1(data).digest()).decode() != row["payload_digest"]:
                            raise ValueError(f"{path}: the payload of {row['page_id']} is damaged")
                        row["payload"] = data.decode()
                        held += n
                    if self._fits(row):
                        rows.append(row)
                    if len(rows) >= 4096 or held > 4 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()})

    def reader(self, schema) -> DataSourceReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()}, schema)


def read_warc(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = PARTITION, where: str | None = None) -> DataFrame:
    """The records below path. payload: decode the payloads of responses, and check them against their digests.

    where: a predicate, of which all that concerns record types and headers is decided before a payload is read. The result of a call with
    it serves one query (see WarcReader.pushFilters); without it, filters are applied to what is read.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    listed = "\n".join(f"{p}|{n}" for p, n in files(spark, path))
    df = spark.read.format("warc").option("files", listed).option("payload", str(payload).lower()).option("partitionBytes", str(partition_bytes)).option("oneQuery", str(where is not None).lower()).load()
    return df if where is None else df.where(where)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages (page_id, url, html) as archives in the shared folder and read them back; see plan_records() for nulls and ties.

    Two reads, each with its predicate pushed: responses with their payloads, which are checked against their digests, and revisits by headers alone.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_warc(plan_records(pages, least), path)
    return read_warc(spark, path, where="record_type = 'response'").unionByName(read_warc(spark, path, payload=False, where="record_type = 'revisit'"))
