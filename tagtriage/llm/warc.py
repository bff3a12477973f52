"""WARC archives as a Spark data source, read and written.

Reading: the files are dealt to partitions by size; predicates on the record
type and on header columns are pushed into the reader; a record's headers are
parsed first, and where they fail the predicates, or where the wanted columns
need no payload, the rest of the record is passed over: by a seek where the file
is plain or the gzip member says its length ("sl" extra field, which the writer
sets), else by inflating without keeping.

Writing: each task writes archives of its own name; the commit writes a list of
the archives that count, so that files of lost or repeated tasks are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In,
                                    InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith,
                                    WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema

from tagtriage.llm.common import arrow_rows, scratch_path, store

FORMAT = "tagtriage_warc"
LISTED = "_committed.json"
# column -> header, all known once the headers are parsed
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
           "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}
# columns that need the payload itself
DECODED = ("payload", "read_bytes", "read_digest")
SCHEMA = ("record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, "
          "content_type string, headers map<string,string>, payload_bytes long, payload binary, read_bytes long, "
          "read_digest string, file string, offset long")
_PIECE = 1 << 16
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _filesystem(path: str):
    from pyarrow import fs
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path)


# ---- bytes of an archive

class _Plain:
    """An archive without compression."""

    def __init__(self, f):
        self.f, self.buf, self.at = f, b"", 0

    def start(self) -> int:
        return self.f.tell() - len(self.buf) + self.at

    def _more(self) -> bool:
        piece = self.f.read(_PIECE)
        self.buf, self.at = self.buf[self.at:] + piece, 0
        return bool(piece)

    def line(self) -> bytes:
        while (end := self.buf.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.buf) - 1
                break
        out, self.at = self.buf[self.at:end + 1], end + 1
        return out

    def take(self, n: int) -> bytes:
        have = self.buf[self.at:self.at + n]
        self.at += len(have)
        return have + self.f.read(n - len(have)) if len(have) < n else have

    def skip(self, n: int) -> None:
        have = min(n, len(self.buf) - self.at)
        self.at += have
        if n > have:
            self.f.seek(self.f.tell() + n - have)


class _Gzip:
    """An archive of gzip members, usually one a record."""

    def __init__(self, f):
        self.f, self.raw, self.inflate, self.buf, self.at = f, b"", None, b"", 0
        self.member, self.next_member, self.length, self.given = 0, None, None, 0

    def start(self) -> int:
        """The offset of the member that holds the next byte."""
        if self.at >= len(self.buf):
            self._more()
        return self.member

    def _fill(self, n: int) -> bool:
        while len(self.raw) < n:
            piece = self.f.read(max(_PIECE, n - len(self.raw)))
            if not piece:
                return False
            self.raw += piece
        return True

    def _head(self) -> bool:
        """Read a member's header; whether there is one."""
        self.member = self.f.tell() - len(self.raw)
        if not self._fill(10):
            return False
        magic, method, flags = struct.unpack("<HBB", self.raw[:4])
        if magic != 0x8B1F or method != 8:
            raise ValueError(f"no gzip member at byte {self.member}")
        at, self.next_member, self.length = 10, None, None
        if flags & 4:
            self._fill(12)
            size, = struct.unpack("<H", self.raw[10:12])
            self._fill(12 + size)
            extra, at = self.raw[12:12 + size], 12 + size
            while len(extra) >= 4:
                mark, n = extra[:2], struct.unpack("<H", extra[2:4])[0]
                if mark == b"sl" and n == 8:
                    packed, self.length = struct.unpack("<II", extra[4:12])
                    self.next_member = self.member + packed
                extra = extra[4 + n:]
        for flag in (8, 16):  # name, comment
            if flags & flag:
                while (end := self.raw.find(b"\0", at)) < 0:
                    if not self._fill(len(self.raw) + 1):
                        raise ValueError(f"gzip member at byte {self.member} ends in its header")
                at = end + 1
        self.raw = self.raw[at + (2 if flags & 2 else 0):]
        self.inflate, self.given = zlib.decompressobj(-15), 0
        return True

    def _more(self) -> bool:
        while True:
            if self.inflate is None and not self._head():
                return False
            if not self.raw and not self._fill(1):
                raise ValueError(f"gzip member at byte {self.member} is cut short")
            out = self.inflate.decompress(self.raw, _PIECE)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw = self.inflate.unused_data
                self._fill(8)
                self.raw, self.inflate = self.raw[8:], None
            if out:
                self.buf, self.at = self.buf[self.at:] + out, 0
                self.given += len(out)
                return True

    def line(self) -> bytes:
        while (end := self.buf.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.buf) - 1
                break
        out, self.at = self.buf[self.at:end + 1], end + 1
        return out

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            if self.at >= len(self.buf) and not self._more():
                break
            parts.append(self.buf[self.at:self.at + left])
            self.at += len(parts[-1])
            left -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        left = n - (len(self.buf) - self.at)
        if left > 0 and self.inflate is not None and self.next_member is not None and self.given + left == self.length:
            self.f.seek(self.next_member)
            self.raw, self.buf, self.at, self.inflate = b"", b"", 0, None
            return
        while n > 0:
            if self.at >= len(self.buf) and not self._more():
                return
            step = min(n, len(self.buf) - self.at)
            self.at += step
            n -= step


def _fields(src) -> dict[str, str]:
    """Header lines up to the empty one, names in lower case; the first of equal names counts."""
    out: dict[str, str] = {}
    while (line := src.line().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out, body


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value.startswith("<") and value.endswith(">") else value


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def records(src, wanted: list[str], accept) -> Iterator[dict]:
    """Rows of one archive: ``accept`` sees the header columns; ``wanted`` names the columns to fill."""
    block_needed = any(c in wanted for c in (*DECODED, "payload_bytes"))
    decode = any(c in wanted for c in DECODED)
    while True:
        offset = src.start()
        line = src.line()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {offset}")
        fields = _fields(src)
        length = int(fields.get("content-length", 0))
        row = {c: fields.get(h) for c, h in HEADERS.items()}
        row["record_id"], row["refers_to"] = _bare(row["record_id"]), _bare(row["refers_to"])
        if not accept(row):
            src.skip(length + 4)
            continue
        row |= {"headers": fields, "offset": offset}
        http = (row["content_type"] or "").startswith("application/http")
        if decode or block_needed and http:
            block = src.take(length)
            if len(block) < length:
                raise ValueError(f"record at byte {offset} is cut short")
            src.skip(4)
            inner, body = _http(block) if http else ({}, block)
            if row["record_type"] == "revisit":
                full, body = inner.get("content-length", ""), None
                row["payload_bytes"] = int(full) if full.isdigit() else None
            else:
                row["payload_bytes"] = len(body)
            if decode and body is not None:
                row |= {"payload": body, "read_bytes": len(body)}
                if "read_digest" in wanted:
                    row["read_digest"] = base32_sha1(body)
        else:
            src.skip(length + 4)
            row["payload_bytes"] = length
        yield row


# ---- predicates on header columns

def _holds(f: Filter, row: dict) -> bool | None:
    """The predicate's value as in SQL: None where a null decides."""
    if isinstance(f, Not):
        inner = _holds(f.child, row)
        return None if inner is None else not inner
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if isinstance(f, In):
        return None if value is None else True if value in f.value else None if None in f.value else False
    if value is None or f.value is None:
        return None
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return value.endswith(f.value)
    return f.value in value


def _pushable(f: Filter) -> bool:
    if isinstance(f, Not):
        return _pushable(f.child)
    return (isinstance(f, EqualTo | EqualNullSafe | In | IsNull | IsNotNull | StringStartsWith | StringEndsWith | StringContains)
            and len(f.attribute) == 1 and f.attribute[0] in HEADERS)


@dataclass
class _Files(InputPartition):
    paths: list

    def __init__(self, paths):
        super().__init__(None)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path = schema, options["path"]
        self.limit = int(options.get("partition_bytes", 64 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if _pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        """Archives by falling size, packed into partitions of about ``partition_bytes``."""
        from pyarrow import fs
        store_, path = _filesystem(self.path)
        info = store_.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store_.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path))
        listing = store_.get_file_info(f"{path}/{LISTED}")
        if listing.type == fs.FileType.File:
            with store_.open_input_stream(listing.path) as s:
                count = set(json.loads(s.read()))
            files = [(p, n) for p, n in files if p.rsplit("/", 1)[-1] in count]
        out, held, size = [], [], 0
        for p, n in files:
            if held and size + n > self.limit:
                out.append(_Files(held))
                held, size = [], 0
            held.append(p)
            size += n
        return [*out, _Files(held)] if held else out or [_Files([])]

    def read(self, partition):
        store_, _ = _filesystem(self.path)
        schema = to_arrow_schema(self.schema)
        wanted = schema.names
        accept = lambda row: all(_holds(f, row) for f in self.filters)
        rows, size = [], 0
        for path in partition.paths:
            with store_.open_input_file(path) as f:
                for row in records((_Gzip if path.endswith(".gz") else _Plain)(f), wanted, accept):
                    row["file"] = path
                    rows.append({c: row.get(c) for c in wanted})
                    size += 200 + len(row.get("payload") or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


# ---- writing

@dataclass
class _Written(WriterCommitMessage):
    names: list


def record_bytes(row: dict) -> bytes:
    """One record. Responses hold an HTTP head and the payload; revisits the head
    alone, whose Content-Length is that of the full payload."""
    payload = row.get("payload") or b""
    if isinstance(payload, str):
        payload = payload.encode()
    full = row.get("payload_bytes")
    full = len(payload) if full is None else full
    digest = row.get("payload_digest") or base32_sha1(payload)
    kind = row.get("record_type") or "response"
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: {_clean(row.get('content_type') or 'text/html; charset=utf-8')}\r\n"
             f"Content-Length: {full}\r\n\r\n").encode() + (b"" if kind == "revisit" else payload)
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_clean(row.get('record_id') or uuid.uuid5(uuid.NAMESPACE_URL, digest).urn)}>"),
            ("WARC-Date", row.get("date") or "1970-01-01T00:00:00Z"), ("WARC-Target-URI", row.get("target_uri")),
            ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<{_clean(row['refers_to'])}>" if row.get("refers_to") else None)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    """Header values stay on their line: control characters are percent-encoded."""
    return _CONTROL.sub(lambda m: m[0] if m[0] == " " else f"%{ord(m[0]):02X}", value)


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field says its length and that of its content."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    size = 12 + 12 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if size >= 1 << 32 or len(data) >= 1 << 32:
        return struct.pack("<HBBIBB", 0x8B1F, 8, 0, 0, 0, 255) + body + tail
    return (struct.pack("<HBBIBBH", 0x8B1F, 8, 4, 0, 0, 255, 12) + b"sl" + struct.pack("<HII", 8, size, len(data))
            + body + tail)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"], overwrite
        self.packed = options.get("compression", "gzip") == "gzip"
        self.level, self.limit = int(options.get("level", 3)), int(options.get("file_bytes", 64 << 20))

    def write(self, iterator):
        from pyspark import TaskContext
        store_, path = _filesystem(self.path)
        store_.create_dir(path, recursive=True)
        task, names, out, size = TaskContext.get().partitionId(), [], None, 0
        try:
            for batch in iterator:
                cols = batch.schema.names
                for i in range(batch.num_rows):
                    data = record_bytes({c: batch.column(k)[i].as_py() for k, c in enumerate(cols)})
                    if self.packed:
                        data = gzip_member(data, self.level)
                    if out is None or size + len(data) > self.limit:
                        if out is not None:
                            out.close()
                        names.append(f"part-{task:05d}-{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                        out, size = store_.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages):
        store_, path = _filesystem(self.path)
        store_.create_dir(path, recursive=True)
        names = [n for m in messages if m is not None for n in m.names]
        listing = f"{path}/{LISTED}"
        if not self.overwrite and store_.get_file_info(listing).is_file:
            with store_.open_input_stream(listing) as s:
                names = json.loads(s.read()) + names
        with store_.open_output_stream(listing) as s:
            s.write(json.dumps(names).encode())

    def abort(self, messages):
        store_, path = _filesystem(self.path)
        for n in (n for m in messages if m is not None for n in m.names):
            store_.delete_file(f"{path}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    arrow_rows(spark, 256)


def read_warc(spark: SparkSession, path: str, columns: str | None = None, **options) -> DataFrame:
    """Records of the archives under ``path`` (a folder, or one file of name
    .warc or .warc.gz). ``columns`` is a schema with some of ``SCHEMA``'s columns:
    payloads are only decoded where payload, read_bytes or read_digest is among
    them. An archive that is cut short or is none raises."""
    register(spark)
    reader = spark.read.format(FORMAT).options(**options)
    return (reader.schema(columns) if columns else reader).load(path)


def write_warc(rows: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """Write rows (columns of ``SCHEMA``; those that are absent get defaults) as
    archives under ``path``. Options: compression (gzip, none), level, file_bytes."""
    register(rows.sparkSession)
    rows.write.format(FORMAT).options(**options).mode(mode).save(path)


# ---- pages

def _base32(hexed: Column) -> Column:
    """Bare upper-case base32 of 40 hexadecimal digits: 8 letters for every 10 digits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(4):
        part = F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 10).cast("long")
        out += [F.substring(alphabet, F.shiftright(part, 35 - 5 * j).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for j in range(8)]
    return F.concat(*out)


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A record a row of ``pages`` (page_id, url, html; other columns are left
    aside): among equal payloads of at least ``min_bytes`` bytes the largest
    page_id is the response, others revisit it; smaller payloads are responses.

    Null html is the empty payload, a null url has no target. Rows without id
    revisit, unless no row with that payload has an id. Rows with equal id and
    payload are all what one of them would be.

    Payload classes are narrow partial sums. Only the rows that revisit are
    joined back, by id and digest, so that a payload which a third of the rows
    hold is no hot key; where they are few, pages are not shuffled at all."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    named = raw.withColumn("hex", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))
    narrow = store(named.where(F.col("size") >= min_bytes).select("page_id", "hex", "size", F.xxhash64("html").alias("mark")), "payloads")
    classes = store(narrow.groupBy("hex", "size", "mark").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1 AND last IS NOT NULL").drop("n"), "payload-classes")
    again = store(narrow.join(classes, ["hex", "size", "mark"]).where(~F.col("page_id").eqNullSafe(F.col("last")))
                  .select(F.col("page_id").alias("r_id"), F.col("hex").alias("r_hex"), F.col("size").alias("r_size"),
                          F.col("mark").alias("r_mark"), "last").distinct(), "revisits")
    out = named.join(again, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("hex") == F.col("r_hex"))
                     & (F.col("size") == F.col("r_size")) & (F.xxhash64("html") == F.col("r_mark")), "left")
    revisit = F.col("last").isNotNull()
    return out.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("urn:page:"), F.col("page_id").cast("string"))).alias("record_id"),
        F.col("url").alias("target_uri"), F.concat(F.lit("urn:page:"), F.col("last").cast("string")).alias("refers_to"),
        _base32(F.col("hex")).alias("payload_digest"), F.col("size").alias("payload_bytes"),
        F.when(~revisit, F.col("html")).alias("payload"))


def page_of(column: str) -> Column:
    """The page_id in a record's name; null where it has none."""
    digits = F.regexp_extract(column, r"^urn:page:(-?[0-9]+)$", 1)
    return F.when(digits != "", digits.cast("long"))


def archive_pages(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to. Responses are decoded and digested
    anew; revisits are found by their type, and only their headers are read."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(page_records(pages, min_bytes), path)
    read = read_warc(spark, path, "record_type string, record_id string, target_uri string, read_bytes long, read_digest string")
    new = read.where("record_type = 'response'").select(
        page_of("record_id").alias("page_id"), F.col("target_uri").alias("url"), F.col("read_bytes").alias("payload_bytes"),
        F.col("read_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    read = read_warc(spark, path, "record_type string, record_id string, target_uri string, payload_bytes long, "
                                  "payload_digest string, refers_to string")
    old = read.where("record_type = 'revisit'").select(
        page_of("record_id").alias("page_id"), F.col("target_uri").alias("url"), "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to"))
    return new.unionByName(old)
