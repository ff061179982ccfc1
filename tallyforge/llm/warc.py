"""WARC archives as a PySpark Python data source, for reading and writing.

Writing: each task writes its own ``.warc.gz`` file, a gzip member for each
record, and the driver commits a manifest of the files and of places where they
can be cut; a file of a failed task is in no manifest. Members carry the skip
length field, so a reader passes a record without inflating it.

Reading: the manifest (or, without one, the folder's ``.warc`` and ``.warc.gz``
files) is planned into partitions of about SPLIT_BYTES; a file that no manifest
cuts is one partition, read a window at a time. Equality, membership and
prefix predicates on record type and header columns are pushed down. A record's
first bytes are inflated and its headers parsed; only if they satisfy the
predicates and the payload is wanted is the rest decoded.

Options: ``payload`` is ``true`` (decode, check against the digest and return
it), ``verify`` (decode and check, return null) or ``false`` (don't decode).

Defined results: null payloads are written as empty; a null URL has no target
header and reads back as null; a damaged payload (digest differs) is an error. Of
rows with one page_id and equal payloads each is a record, and all of them point
to the largest page_id or are responses where it is their own; rows without
page_id are responses under ids of their own; an empty table writes no archive
and reads as no rows; very long payloads are held one at a time; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from tallyforge.llm.common import checkpointed, own_folder

#: Compressed bytes of a partition, and of records before a new place to cut.
SPLIT_BYTES = 16 << 20
#: Bytes inflated to find a record's headers.
HEAD_BYTES = 4096
#: Bytes handed to zlib at a time where a member doesn't say how long it is.
PIECE_BYTES = 1 << 14
#: Bytes of a file held at a time, beside the payload at hand.
WINDOW_BYTES = 1 << 20
MANIFEST = "_manifest.json"
#: Revisit ids that are sent to all tasks; more of them are joined.
SENT_ROWS = 1_000_000

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
#: Columns that predicates can use before any payload is decoded.
HEADER_COLUMNS = frozenset(["record_id", "record_type", "target_uri", "payload_digest", "payload_length", "refers_to"])

VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, record_type: str, uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response, or a revisit without its payload; both carry the digest and length of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if uri is not None:
        fields.append(("WARC-Target-URI", " ".join(uri.split())))
    if record_type == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with the skip length field: compressed length, then length."""
    body = zlib.compressobj(4, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    size = 10 + 2 + 12 + len(packed) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _skip(buf: memoryview, at: int) -> tuple[int, int]:
    """Where the deflated data of the member at ``at`` starts, and the member's length if it says so (else 0)."""
    flags = buf[at + 3]
    place, size = at + 10, 0
    if flags & 4:
        (extra,) = struct.unpack_from("<H", buf, place)
        field, place = place + 2, place + 2 + extra
        while field + 4 <= place:
            name, n = bytes(buf[field : field + 2]), struct.unpack_from("<H", buf, field + 2)[0]
            if name == b"sl":
                size = struct.unpack_from("<I", buf, field + 4)[0]
            field += 4 + n
    for flag in (8, 16):
        if flags & flag:
            while buf[place]:
                place += 1
            place += 1
    return place + 2 * bool(flags & 2), size


def parse_head(head: bytes) -> tuple[dict[str, str], int] | None:
    """A record's headers and their length, or None if ``head`` ends before they do."""
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = head[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


class Window:
    """A file's bytes, a piece in memory at a time."""

    def __init__(self, file: pa.NativeFile, end: int) -> None:
        self.file, self.end, self.start, self.held = file, end, 0, b""

    def get(self, at: int, n: int) -> memoryview:
        """``n`` bytes from ``at`` on, fewer where the file's part ends."""
        n = min(n, self.end - at)
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.start, self.held = at, self.file.read_at(min(max(n, WINDOW_BYTES), self.end - at), at)
        return memoryview(self.held)[at - self.start : at - self.start + n]


@dataclass
class Found:
    """A record whose headers are read: its fields (None if they don't end), HTTP head, and length after the WARC head; ``rest`` decodes the payload, ``end`` tells where the next record begins."""

    fields: dict[str, str] | None
    http: bytes
    block: int
    rest: Callable[[], bytes]
    end: Callable[[], int]


def _heads(more: Callable[[int], bytes]) -> tuple[dict[str, str] | None, int, bytes]:
    """The fields of a record, their length and the HTTP head, from ``more(n)``: the record's first n bytes at least, or all."""
    n = HEAD_BYTES
    while (parsed := parse_head(head := more(n))) is None:
        if len(head) < n:
            return None, 0, b""
        n = 2 * len(head)
    fields, at = parsed
    if not fields.get("content-type", "").startswith("application/http"):
        return fields, at, b""
    block = int(fields.get("content-length", "0"))
    while True:
        end = head.find(b"\r\n\r\n", at, at + block)
        if end >= 0 or len(head) >= at + block or len(head) < n:
            return fields, at, head[at : end + 4] if end >= 0 else b""
        n = 2 * len(head)
        head = more(n)


def _plain(window: Window, at: int) -> Found:
    fields, n_head, http = _heads(lambda n: bytes(window.get(at, n)))
    block = int((fields or {}).get("content-length", "0"))
    start = at + n_head + len(http)
    return Found(fields, http, block, lambda: bytes(window.get(start, block - len(http))), lambda: at + n_head + block + 4)


def _packed(window: Window, at: int) -> Found:
    """A gzip member; where it says how long it is, what isn't wanted is passed over."""
    body, length = _skip(window.get(at, WINDOW_BYTES), 0)
    stop = at + length - 8 if length else window.end
    inflate = zlib.decompressobj(-15)
    fed, head = at + body, b""

    def step(most: int) -> bytes:
        nonlocal fed
        piece = inflate.unconsumed_tail
        if not piece:
            piece = window.get(fed, min(PIECE_BYTES, stop - fed))
            fed += len(piece)
        return inflate.decompress(piece, most)

    def ended() -> bool:
        return inflate.eof or not inflate.unconsumed_tail and fed >= stop

    def more(n: int) -> bytes:
        nonlocal head
        while len(head) < n and not ended():
            head += step(n)
        return head

    fields, n_head, http = _heads(more)
    block = int((fields or {}).get("content-length", "0"))

    def rest() -> bytes:
        parts = [head]
        while not ended():
            parts.append(step(0))
        return b"".join(parts)[n_head + len(http) : n_head + block]

    def end() -> int:
        if length:
            return at + length
        while not ended():
            step(WINDOW_BYTES)
        return fed - len(inflate.unused_data) + 8

    return Found(fields, http, block, rest, end)


@dataclass
class Part(InputPartition):
    """Bytes ``start`` to ``end`` of a file, cut between records."""

    path: str
    start: int
    end: int

    def __post_init__(self) -> None:
        super().__init__(self.path)


@dataclass
class Written(WriterCommitMessage):
    """A task's file with the places where it can be cut."""

    name: str
    cuts: list[int]


def open_folder(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


class WarcReader(DataSourceReader):
    """Reads the records of a folder."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower()
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Part]:
        files, root = open_folder(self.path)
        cuts: dict[str, list[int]] = {}
        found = files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        manifests = [i.path for i in found if i.base_name.startswith(MANIFEST)]
        for path in manifests:
            with files.open_input_stream(path) as f:
                cuts |= {f"{path.rpartition('/')[0]}/{name}": places for name, places in json.loads(f.read()).items()}
        if not manifests:
            cuts = {i.path: [0, i.size] for i in found if i.base_name.endswith((".warc", ".warc.gz"))}
        return [Part(path, a, b) for path, places in sorted(cuts.items()) for a, b in zip(places[:-1], places[1:], strict=True)]

    def _wanted(self, row: dict) -> bool:
        for f in self.filters:
            value = row[f.attribute[0]]
            if value is None:
                return False
            if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark hands over where there is nothing to read
            return
        files, _ = open_folder(self.path)
        rows, size = [], 0
        with files.open_input_file(partition.path) as f:
            window = Window(f, partition.end)
            record = _packed if partition.path.endswith(".gz") else _plain
            at = partition.start
            while at < partition.end:
                found = record(window, at)
                if found.fields is None:
                    raise ValueError(f"{partition.path}: a record at byte {at} has no end of headers")
                row = self._row(found)
                wanted = self._wanted(row)
                if wanted and row["record_type"] != "revisit" and self.payload != "false":
                    payload = found.rest()
                    if row["payload_digest"] and digest(payload) != row["payload_digest"]:
                        raise ValueError(f"{partition.path}: the payload of {row['record_id']} is damaged")
                    row["payload"] = payload if self.payload == "true" else None
                    size += len(payload)
                at = found.end()
                if wanted:
                    rows.append(row)
                if len(rows) >= 4096 or size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    @staticmethod
    def _row(found: Found) -> dict:
        fields = found.fields
        length = found.block
        if found.http:
            length = None
            for line in found.http.split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.lower() == b"content-length":
                    length = int(value)
        return {
            "record_id": _bare(fields.get("warc-record-id")), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_length": length, "refers_to": _bare(fields.get("warc-refers-to")), "headers": list(fields.items()), "payload": None,
        }


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (record_id, record_type, target_uri, payload, refers_to), a file for each task."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.run = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = open_folder(self.path)
        files.create_dir(root, recursive=True)
        name = f"{self.run}-{uuid.uuid4().hex}.warc.gz"
        cuts, at = [0], 0
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("record_id", "record_type", "target_uri", "payload", "refers_to")), strict=True):
                    data = member(record(row[0], row[1], row[2], row[3] or b"", row[4]))
                    out.write(data)
                    at += len(data)
                    if at - cuts[-1] >= SPLIT_BYTES:
                        cuts.append(at)
        if cuts[-1] != at:
            cuts.append(at)
        return Written(name, cuts)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = open_folder(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{MANIFEST}-{self.run}") as out:
            out.write(json.dumps({m.name: m.cuts for m in messages if m}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = open_folder(self.path)
        for m in messages:
            if m:
                files.delete_file(f"{root}/{m.name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def _page(column: str) -> F.Column:
    return F.regexp_extract(column, r"^urn:x-page:(-?\d+)$", 1).try_cast("long")


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload of at least ``least`` bytes a page with a larger id has too. Payloads don't move."""
    body = F.coalesce("html", F.lit(""))
    each = pages.where(F.col("page_id").isNotNull() & (F.octet_length(body) >= least)).select("page_id", F.sha1(body).alias("digest"))
    same = each.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first")).where("first <> refers_to").drop("first")
    return checkpointed(each.join(checkpointed(same), "digest").where("page_id <> refers_to").select("page_id", "refers_to").distinct())


def write_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    """A record for each row of ``pages(page_id, url, html)``."""
    register(pages.sparkSession)
    again = revisits(pages, least)
    if again.count() <= SENT_ROWS:
        again = F.broadcast(again)
    urn = lambda c: F.concat(F.lit("urn:x-page:"), F.col(c).cast("string"))
    rows = pages.select("page_id", "url", "html").join(again, "page_id", "left")
    out = rows.select(F.coalesce(urn("page_id"), F.concat(F.lit("urn:uuid:"), F.uuid())).alias("record_id"), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"), urn("refers_to").alias("refers_to"))
    out.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: str = "true") -> DataFrame:
    """The archives' records; see the module for ``payload``."""
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = own_folder(spark, "warc")
    write_pages(pages, path)
    back = read(spark, path, "verify")
    return back.select(_page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", _page("refers_to").alias("refers_to"))
