"""Operator 12: web archives (WARC 1.1), written record by record and read back by a reader
that salvages what damage leaves.

Writing: each record is a gzip member of its own. Of records with equal payloads of at least
``least`` bytes the one with the smallest id is a response, the others are revisits that
refer to it and keep its payload's digest and length, not the payload. Spark's text sink
commits the files, so a lost executor leaves no half of one; members go into rows of about
``ROW`` bytes, ``rows_per_file`` of them to a file, and rows are parted by an empty member.

Reading: a file is walked member by member. A member must inflate to its end with the right
check sum and length; the records in it must begin with a version line, have a whole header
block and as many bytes as they say, end with two line ends, and have the digests they name.
After a failed check the reader goes on at the next place where a gzip member or a version
line begins and a whole record passes the checks; records between are recovered, and the
bytes passed over are logged as a gap with the check that failed. Plain files, files of one
member with many records, and files cut off in the middle of a member are read likewise (of
a broken member those records count that lie whole before the break). Records, gaps and
empty members cover a file without overlap. A file is held in memory by one task, as
Spark's binaryFile source does; the writer bounds its own files.

Rows: a null payload is empty; a null id is written as nothing and read back as null; of rows
with one id and one payload none is first alone, so all are responses if theirs is the
smallest id; a null id is larger than any; if all are null, all are responses. Extra columns
are not read; empty tables and folders give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import common as C

#: Bytes of members that go into one row of a file.
ROW = 2 << 20
#: An empty gzip member, which parts the rows of a file. A fixed value of the format.
EMPTY = bytes.fromhex("1f8b080000000000000303000000000000000000")
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_LINES = b"\r\n\r\n"
_BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
#: What a revisit is a revisit for. A fixed value of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PREFIX = "urn:page:"
#: Rows of one digest go to so many tasks.
_SALTS = 16


# -- writing


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """id, url, payload (binary), bytes, digest, refers_to (null: a response) of every page."""
    own = pages.select(
        pages[id_col].cast("string").alias("id"),
        pages[id_col].alias("rank"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[payload_col].cast("binary"), F.lit(b"")).alias("payload"),
    )
    own = own.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    large = own.where(F.col("bytes") >= least)
    shared = large.groupBy("digest").agg(F.count("*").alias("n"), F.min("rank").alias("first")).where("n > 1")
    firsts = C.written(shared.select("digest", F.col("first").alias("first_rank"), F.col("first").cast("string").alias("first")))
    # Spark sends firsts to all tasks if it is small; else rows of one digest are dealt over salts
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    j = own.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    again = (F.col("bytes") >= least) & F.col("first").isNotNull() & ~F.col("rank").eqNullSafe(F.col("first_rank"))
    return j.select("id", "url", "payload", "bytes", "digest", F.when(again, F.col("first")).alias("refers_to"))


def _line(text: str | None) -> str:
    """A header's value: line ends and what else would end it become %-codes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_PREFIX}{_line(page)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_PREFIX}{_line(refers_to)}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _LINES + block + _LINES


def member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(plan: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", rows_per_file: int = 16) -> None:
    """Writes a folder of archives. plan: rows of planned()."""

    def members(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in it:
            for page, url, payload, _, digest, first in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                held.append(member(record(page, url, payload, digest, first, date)))
                size += len(held[-1])
                if size >= ROW:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    rows = plan.mapInArrow(members, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", rows_per_file).text(path)


# -- reading


class Broken(ValueError):
    """A check that failed."""


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def payload(self) -> bytes:
        """What follows the head of an HTTP message; any other block whole."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(_LINES)[2]
        return self.block

    def payload_length(self) -> int | None:
        """The length that the head of an HTTP message names."""
        head = self.block.partition(_LINES)[0]
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", head)
        return int(found[1]) if found else None


@dataclass
class Found:
    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)  # offset, length, reason


def _same(named: str, data: bytes) -> bool:
    """Whether data has the digest; of an algorithm that isn't known nothing is said."""
    algorithm, _, value = named.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("sha1", "sha256", "sha512", "md5"):
        return True
    own = hashlib.new(algorithm, data)
    return value.strip().lower() == own.hexdigest() or value.strip().upper() == base64.b32encode(own.digest()).decode()


def parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record that begins at a place, and where it ends; raises Broken."""
    if not _VERSION_LINE.match(data, at):
        raise Broken("no version line")
    head_end = data.find(_LINES, at)
    if head_end < 0:
        raise Broken("no end of the header block")
    headers: dict[str, str] = {}
    for line in data[at:head_end].decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("a header line without a colon")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Broken("no Content-Length")
    begin = head_end + 4
    end = begin + int(size)
    if data[end : end + 4] != _LINES:
        raise Broken("the block does not end where Content-Length says")
    r = Record(at, end + 4 - at, headers, data[begin:end])
    if not _same(headers.get("warc-block-digest", ""), r.block):
        raise Broken("wrong block digest")
    if r.kind != "revisit" and not _same(headers.get("warc-payload-digest", ""), r.payload()):
        raise Broken("wrong payload digest")
    return r, end + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at a place has, where it ends, and the check that failed. Of a
    broken member what came before the break is there."""
    z = zlib.decompressobj(31)
    view, out, step = memoryview(data), [], 1 << 16
    pos = at
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(view[pos : pos + step]))
            pos += step
    except zlib.error as e:
        return b"".join(out), len(data), f"gzip: {e}"
    if not z.eof:
        return b"".join(out), len(data), "gzip: cut off"
    return b"".join(out), min(pos, len(data)) - len(z.unused_data), None


def _inside(data: bytes) -> tuple[list[Record], str | None]:
    """Records of a member's content, and the first check that failed."""
    records, at, failed = [], 0, None
    while at < len(data):
        try:
            r, at = parse(data, at)
            records.append(r)
        except Broken as e:
            failed = failed or str(e)
            found = data.find(VERSION, at + 1)
            at = len(data) if found < 0 else found
    return records, failed


def _try(data: bytes, at: int) -> tuple[list[Record], int]:
    """Records of the member or plain record at a place, and where it ends; raises Broken."""
    if data.startswith(MAGIC, at):
        content, end, failed = inflate(data, at)
        if failed is None and not content:
            return [], end
        if failed is None:
            records, failed = _inside(content)
            if failed is None:
                return [Record(at, end - at, r.headers, r.block) for r in records], end
        raise Broken(failed)
    r, end = parse(data, at)
    return [r], end


def salvage(data: bytes) -> Found:
    """Every record of a file that passes the checks, and the gaps between."""
    out, at = Found(), 0
    while at < len(data):
        try:
            records, at = _try(data, at)
            out.records += records
            continue
        except Broken as e:
            reason, begin = str(e), at
        # whole records before the break of a member count; their bytes stay in the gap
        if data.startswith(MAGIC, begin):
            out.records += [Record(begin, 0, r.headers, r.block) for r in _inside(inflate(data, begin)[0])[0]]
        at = len(data)
        for m in _BEGIN.finditer(data, begin + 1):
            try:
                records, end = _try(data, m.start())
            except Broken:
                continue
            if records:
                at = m.start()
                break
        out.gaps.append((begin, at - begin, reason))
    return out


SCHEMA = (
    "path string, offset long, length long, gap string, record_type string, record_id string, target_uri string, date string, "
    "payload_bytes long, payload_digest string, refers_to string, payload binary"
)


def read(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """A row for each record (gap is null) and each gap (its reason) of the archives of a
    folder. offset and length are those of the record's member, or of the plain record;
    length is 0 for a record out of a broken member. payload_bytes and payload_digest are the
    payload's own; of a revisit those of the payload it stands for, as its headers say."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in SCHEMA.split(", ")])

    def rows(name: str, found: Found) -> Iterator[tuple]:
        for r in found.records:
            h, data = r.headers, r.payload()
            digest = hashlib.sha256(data).hexdigest()
            size: int | None = len(data)
            if r.kind == "revisit":
                size, digest = r.payload_length(), h.get("warc-payload-digest", "").removeprefix("sha256:") or None
            bare = [h[k].strip("<>") if k in h else None for k in ("warc-record-id", "warc-refers-to")]
            yield name, r.offset, r.length, None, r.kind, bare[0], h.get("warc-target-uri"), h.get("warc-date"), size, digest, bare[1], data if keep_payload else None
        for offset, length, reason in found.gaps:
            yield name, offset, length, reason, *[None] * 8

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held, size = [], 0
                for row in rows(name, salvage(data.as_py() or b"")):
                    held.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > ROW:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(walk, SCHEMA)


def page_ids(records: DataFrame) -> DataFrame:
    """What planned() was given, of records that write() wrote: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    number = lambda c: F.nullif(F.regexp_replace(c, f"^{_PREFIX}", ""), F.lit("")).cast("long")
    return records.where("gap IS NULL").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
