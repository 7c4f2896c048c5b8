"""WARC archives as a PySpark data source, `format("warc")`.

Reading: files are planned into partitions by size; of a record the header is parsed first, predicates on record type
and header fields are pushed down, and a payload that is filtered out or not asked for is not decoded: gzip members carry
their lengths in an extra field (`sl`), so the reader goes on behind them; in plain files it uses Content-Length.
Writing: a gzip member for each record, a file for each task, and a list of files that the commit writes, so that files
of lost or repeated tasks do not count.

Paths are anything Arrow's file systems open (local, HDFS, object stores).
"""

import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from struct import pack, unpack

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .shared import small_batches

# Columns and the header fields behind them; `headers` has all fields under lower-case names, values of a repeated one
# joined by a newline, `payload` the entity without protocol headers. A column takes the first value of its field.
FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "WARC-Payload-Length",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} {'long' if c == 'payload_length' else 'string'}" for c in FIELDS) + ", headers map<string,string>, payload binary"
LISTING = "_files.json"
PARTITION_BYTES = 128 << 20
BATCH_BYTES = 4 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def clean(value) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in str(value))


def member(data: bytes) -> bytes:
    """A gzip member whose extra field `sl` has its compressed and its full length."""
    packer = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + pack("<H", 12) + b"sl" + pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_bytes(row: dict, date: str) -> bytes:
    """One record; a revisit has no payload, a NULL payload counts as empty."""
    kind, payload = row.get("record_type") or "response", row.get("payload") or b""
    head = b""
    if kind in ("response", "revisit"):
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    length = row.get("payload_length")
    values = {
        "WARC-Type": kind,
        "WARC-Record-ID": row.get("record_id"),
        "WARC-Date": row.get("date") or date,
        "WARC-Target-URI": row.get("target_uri"),
        "WARC-Refers-To": row.get("refers_to"),
        "WARC-Profile": REVISIT if kind == "revisit" else None,
        "WARC-Payload-Digest": row.get("payload_digest"),
        "WARC-Payload-Length": len(payload) if length is None else length,
        "Content-Type": row.get("content_type") or ("application/http; msgtype=response" if head else "application/octet-stream"),
        "Content-Length": len(block),
    }
    lines = ["WARC/1.1", *[f"{k}: {clean(v)}" for k, v in values.items() if v is not None]]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with system.open_output_stream(posixpath.join(folder, name), compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(member(record_bytes(row, self.date)))
                    n += 1
        return Written(name, n)

    def commit(self, messages: list) -> None:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        listing = posixpath.join(folder, LISTING)
        old = []
        if not self.overwrite and system.get_file_info(listing).type == fs.FileType.File:
            with system.open_input_stream(listing) as f:
                old = json.loads(f.read())
        with system.open_output_stream(listing) as f:
            f.write(json.dumps([*old, *[m.name for m in messages if m is not None]]).encode())

    def abort(self, messages: list) -> None:
        """Files without a place in the listing are never read."""


@dataclass
class Files(InputPartition):
    paths: list
    value: int = field(default=0)


def header_fields(header: bytes) -> dict[str, list[str]]:
    """The values of each field by its lower-case name, in order; lines that begin with white space go on with a value."""
    fields: dict[str, list[str]] = {}
    last = None
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last is not None:
            last[-1] = f"{last[-1]} {line.strip()}".strip()
            continue
        name, _, value = line.partition(":")
        last = fields.setdefault(name.strip().lower(), [])
        last.append(value.strip())
    return fields


class Members:
    """The records of one file, header first; the rest of a record that is passed over is not decoded."""

    def __init__(self, source, name="archive"):
        self.source, self.at, self.end, self.name = source, 0, source.size(), name
        self.packed = source.read_at(2, 0) == b"\x1f\x8b" if self.end >= 2 else False

    def records(self) -> Iterator["Member"]:
        while self.at < self.end:
            record = Member(self)
            if record.fields is None:
                return
            yield record
            self.at = record.behind()


class Member:
    def __init__(self, file: Members):
        self.file, self.start, self.next = file, file.at, None
        self.plain, self.read = b"", file.at
        if file.packed:
            head = file.source.read_at(24, self.start)
            self.inflater = zlib.decompressobj(31)
            if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
                self.next = self.start + unpack("<I", head[16:20])[0]
        step = 4096
        while (cut := self.plain.find(b"\r\n\r\n")) < 0 and self.more(step):
            step *= 2
        self.fields = None
        if cut >= 0:
            self.fields = header_fields(self.plain[:cut])
            self.block = cut + 4
            given = self.fields.get("content-length", [""])[0]
            if not (given.isascii() and given.isdigit()):
                raise ValueError(f"{file.name}: the record at byte {self.start} has no valid Content-Length: {given!r}")
            self.length = int(given)
        elif self.plain.strip():
            raise ValueError(f"{file.name}: the record at byte {self.start} ends inside its header")

    def more(self, size: int) -> bool:
        """Reads on; False at the end of the record."""
        if self.file.packed and self.inflater.eof:
            return False
        data = self.file.source.read_at(min(size, self.file.end - self.read), self.read) if self.read < self.file.end else b""
        self.read += len(data)
        self.plain += self.inflater.decompress(data) if self.file.packed else data
        return bool(data)

    def content(self) -> bytes:
        parts, have = [self.plain], len(self.plain)
        self.plain = b""
        while have < self.block + self.length and self.more(1 << 16):
            parts.append(self.plain)
            have += len(self.plain)
            self.plain = b""
        self.plain = b"".join(parts)
        return self.plain[self.block : self.block + self.length]

    def behind(self) -> int:
        if not self.file.packed:
            return self.start + self.block + self.length + 4
        if self.next is None:  # foreign archives without lengths: inflate and drop
            while not self.inflater.eof and self.more(1 << 16):
                self.plain = b""
            self.next = self.read - len(self.inflater.unused_data)
        return self.next


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, partition_bytes: int):
        self.names, self.path, self.partition_bytes = schema.names, path, partition_bytes
        self.schema_json = schema.json()
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kinds = (EqualTo, In, StringStartsWith, IsNotNull, IsNull)
            if isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in FIELDS and f.attribute[0] != "payload_length":
                self.tests.append((type(f).__name__, FIELDS[f.attribute[0]].lower(), getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, fields: dict) -> bool:
        for kind, name, value in self.tests:
            own = fields.get(name, [None])[0]
            if not {
                "EqualTo": lambda: own is not None and own == value,  # noqa: B023
                "In": lambda: own is not None and own in value,  # noqa: B023
                "StringStartsWith": lambda: own is not None and own.startswith(value),  # noqa: B023
                "IsNotNull": lambda: own is not None,  # noqa: B023
                "IsNull": lambda: own is None,  # noqa: B023
            }[kind]():
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        system, folder = opened(self.path)
        listing = posixpath.join(folder, LISTING)
        if system.get_file_info(folder).type == fs.FileType.File:
            infos = [system.get_file_info(folder)]
        elif system.get_file_info(listing).type == fs.FileType.File:
            with system.open_input_stream(listing) as f:
                names = json.loads(f.read())
            infos = system.get_file_info([posixpath.join(folder, n) for n in names]) if names else []
        else:
            infos = [i for i in system.get_file_info(fs.FileSelector(folder, recursive=True)) if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        groups, size = [], 0
        for info in sorted(infos, key=lambda i: (-i.size, i.path)):
            if not groups or size + info.size > self.partition_bytes:
                groups.append(Files([]))
                size = 0
            groups[-1].paths.append(info.path)
            size += info.size
        return groups or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(StructType.fromJson(json.loads(self.schema_json)))
        system, _ = opened(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as source:
                for record in Members(source, path).records():
                    if not self.wanted(record.fields):
                        continue
                    row = {c: record.fields.get(FIELDS[c].lower(), [None])[0] for c in self.names if c in FIELDS}
                    if row.get("payload_length") is not None:
                        row["payload_length"] = int(row["payload_length"])
                    if "headers" in self.names:
                        row["headers"] = [(k, "\n".join(v)) for k, v in record.fields.items()]
                    if "payload" in self.names and record.fields.get("warc-type", [""])[0] != "revisit":
                        block = record.content()
                        if record.fields.get("content-type", [""])[0].lower().startswith("application/http"):
                            block = block.partition(b"\r\n\r\n")[2]
                        row["payload"] = block
                        size += len(block)
                    rows.append(row)
                    if size > BATCH_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcSource(DataSource):
    """Options: `path`; `partitionBytes`, the file bytes of a read task. Give a schema of fewer columns to read fewer."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes `format("warc")` known, with predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


LEAST_BYTES = 1000


def page_records(pages: DataFrame) -> DataFrame:
    """Records of `pages` (page_id, url, html): a payload of at least 1000 bytes is written once.

    Of pages with equal payloads the one with the largest page_id is the response, others revisit it. NULL html is an
    empty payload. A page without id is a response, and so is every repetition of a response's row.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    same = rows.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest", "bytes")
    kept = same.agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = F.coalesce(F.col("page_id") < F.col("kept"), F.lit(False))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    return rows.join(kept, ["digest", "bytes"], "left").select(
        urn("page_id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(again, urn("kept")).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.col("bytes").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    small_batches(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)
