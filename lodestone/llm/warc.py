"""WARC archives: writing, normalising monolithic gzip, reading back through an offset index.

Writing: each page is one WARC/1.1 record; Spark's text writer joins the records
with the format's own record separator and compresses each file as one gzip
stream, so the first archives are monolithic: valid, but without random access.

Normaliser: a whole-file stream is inflated once, in steps of bounded output. Every
record found in it is compressed as a gzip member of its own, whose header states the
member's length in an extra field. Members are written by the text writer again, with
an empty gzip member (20 bytes that inflate to nothing) as the separator, so an archive
is a plain multi-member gzip file on any store Hadoop reaches. The sidecar index is then
read off the written files: archive, offset, length, record type and record id of each
member, for which only a member's first bytes are inflated. However the writer cuts its
files, the index speaks of what is there.

Reading: a task walks the members of the archives it reads, inflates each alone, parses
it, and computes its payload's length and SHA-256 from the bytes, or, for a revisit,
takes them from its header; these narrow rows meet the index by archive, offset and
length. No archive's bytes are ever shuffled. An archive is one write task's records and
one read task's work.

Equal payloads of at least MIN_REVISIT bytes are stored once: the record with the
smallest page_id is the response, the others revisit it. Payloads are compared by
digest and length on a narrow table, so only digests group, and a payload that a
third of all pages share only makes a skewed join that the adaptive plan splits.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, materialise, new_path

MIN_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SEPARATOR = "\r\n\r\n"
#: Fixed value: a gzip member of an empty text; it separates members.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "0000000000000000")
#: Compressed bytes given to the inflater and bytes it may give back at a time, and bytes of members handed on at a time.
STEP, OUT = 1 << 16, 1 << 20
FLUSH = 4 << 20
#: Fixed value: the header of a member with an extra field of eight bytes, its name and the length of its value, four bytes.
MEMBER_HEADER = bytes.fromhex("1f8b0804000000000003" "0800") + b"ML" + bytes.fromhex("0400")
#: Bytes of a record that are inflated for the index at a time.
PEEK = 1 << 10


def records(pages: DataFrame) -> DataFrame:
    """page_id and record (bytes of a WARC record without its final separator), revisits resolved.

    A row whose page_id equals the smallest of its payload's group is a response, so rows
    that repeat it are all responses; null page_ids are never referred to, and a group of
    them alone is all responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    groups = rows.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    groups = materialise(groups.select(F.col("digest").alias("of"), "first"), "groups")
    known = rows.join(groups, F.col("digest") == F.col("of"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    target = F.regexp_replace(F.coalesce("url", F.lit("urn:unknown")), "[\\x00-\\x20\\x7f]+", "%20")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    common = F.concat(
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Target-URI: "), target, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha256:"), F.col("digest")
    )
    full = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response"), common, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.col("bytes") + len(HTTP)).cast("string"), F.lit(SEPARATOR + HTTP.decode()), F.col("html")
    )
    light = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: revisit"), common, F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
        F.col("first").cast("string"), F.lit(">\r\nX-Payload-Length: "), F.col("bytes").cast("string"), F.lit("\r\nContent-Length: 0" + SEPARATOR),
    )
    return known.select("page_id", F.when(revisit, light).otherwise(full).alias("record"))


def write_monolithic(pages: DataFrame, path: str) -> None:
    """Archives of pages under path: every file is one gzip stream over all its records."""
    records(pages).select("record").write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


def inflate(data: bytes):
    """The inflated bytes of a gzip file of any number of members, at most OUT at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        stream, rest = zlib.decompressobj(31), b""
        while not stream.eof:
            if not rest:
                if at >= len(view):
                    raise ValueError("truncated gzip stream")
                rest = view[at : at + STEP]
                at += len(rest)
            part = stream.decompress(rest, OUT)
            rest = stream.unconsumed_tail
            if part:
                yield part
        at -= len(stream.unused_data)


def parse_stream(parts):
    """(header, content) of each record in a stream of byte parts; content is framed by Content-Length."""
    held = bytearray()
    parts = iter(parts)

    def more() -> bool:
        part = next(parts, None)
        if part is not None:
            held.extend(part)
        return part is not None

    while True:
        blank = 0
        while held[blank : blank + 1] in (b"\r", b"\n"):
            blank += 1
        del held[:blank]
        if not held:
            if not more():
                return
            continue
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record's header does not end")
        header = bytes(held[:end])
        size = int(field(header, b"Content-Length") or 0)
        while len(held) < end + 4 + size:
            if not more():
                raise ValueError("a record is shorter than its Content-Length")
        yield header, bytes(held[end + 4 : end + 4 + size])
        while len(held) < end + 8 + size and more():
            pass
        if held[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record's separator is missing")
        del held[: end + 8 + size]


def field(header: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", header)
    return found[1] if found else None


def member(header: bytes, content: bytes) -> bytes:
    """The record as a gzip member of its own, with its length in the header."""
    record = header + b"\r\n\r\n" + content + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = len(MEMBER_HEADER) + 4 + len(body) + 8
    return b"".join((MEMBER_HEADER, size.to_bytes(4, "little"), body, zlib.crc32(record).to_bytes(4, "little"), (len(record) & 0xFFFFFFFF).to_bytes(4, "little")))


def members_of(data: bytes):
    """Offset and length of each member of an archive, separators passed over."""
    at, size = 0, len(data)
    head = len(MEMBER_HEADER)
    while at < size:
        if data[at : at + len(EMPTY_MEMBER)] == EMPTY_MEMBER:
            at += len(EMPTY_MEMBER)
            continue
        if data[at : at + head] != MEMBER_HEADER:
            raise ValueError(f"no member begins at {at}")
        length = int.from_bytes(data[at + head : at + head + 4], "little")
        yield at, length
        at += length
    if at > size:
        raise ValueError("the last member is cut off")


def header_of(packed: bytes) -> bytes:
    """A record's header, from as much of its member as holds it."""
    stream, held = zlib.decompressobj(31), b""
    rest = packed
    while (end := held.find(b"\r\n\r\n")) < 0:
        part = stream.decompress(rest, PEEK)
        if not part:
            raise ValueError("a record's header does not end")
        held, rest = held + part, stream.unconsumed_tail
    return held[:end]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


PLACE = ["archive", "offset", "length"]
PLACE_KINDS = [pa.string(), pa.int64(), pa.int64()]
INDEX = "archive string, offset long, length long, record_type string, record_id string"
#: Index entries and records handed on at a time.
ROWS = 5000


def archives_of(spark: SparkSession, path: str) -> DataFrame:
    """archive (the file's name) and content of the archives under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def normalise(spark: SparkSession, raw_path: str, out_path: str) -> DataFrame:
    """Rewrites the monolithic archives under raw_path with a member per record under out_path; returns the sidecar index.

    A raw file is read as a whole by one task and inflated once. The index stands beside
    the archives, in out_path + "-index".
    """

    def rewrite(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                held, size = [], 0
                for header, content in parse_stream(inflate(data)):
                    held.append(member(header, content))
                    size += len(held[-1])
                    if size > FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["member"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["member"])

    def describe_members(batches):
        names = [*PLACE, "record_type", "record_id"]
        for b in batches:
            for archive, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for offset, length in members_of(data):
                    header = header_of(data[offset : offset + length])
                    rows.append((archive, offset, length, (field(header, b"WARC-Type") or b"").decode(), (field(header, b"WARC-Record-ID") or b"").decode()))
                    if len(rows) >= ROWS:
                        yield _batch(rows, names, [*PLACE_KINDS, pa.string(), pa.string()])
                        rows = []
                yield _batch(rows, names, [*PLACE_KINDS, pa.string(), pa.string()])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(raw_path).select("content")
    members = raw.mapInArrow(rewrite, "member binary").select(F.col("member").cast("string"))
    members.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(out_path)
    return materialise(archives_of(spark, out_path).mapInArrow(describe_members, INDEX), "index", f"{out_path}-index")


RECORD = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def read_back(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record the index names."""
    kinds = [*PLACE_KINDS, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for b in batches:
            for archive, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for offset, length in members_of(data):
                    rows.append((archive, offset, length, *describe(zlib.decompress(data[offset : offset + length], 31))))
                    if len(rows) >= ROWS:
                        yield _batch(rows, [*PLACE, *RECORD], kinds)
                        rows = []
                yield _batch(rows, [*PLACE, *RECORD], kinds)

    found = archives_of(spark, path).mapInArrow(run, "archive string, offset long, length long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return found.join(index.select(*PLACE), PLACE).select(*RECORD)


def describe(record: bytes) -> tuple:
    """page_id, payload length, digest, type, refers_to of one record; a response's payload is checked against its digest."""
    header, content = next(parse_stream([record]))
    kind = field(header, b"WARC-Type").decode()
    digest = field(header, b"WARC-Payload-Digest").decode().removeprefix("sha256:")
    if kind == "revisit":
        return page_of(field(header, b"WARC-Record-ID")), int(field(header, b"X-Payload-Length")), digest, kind, page_of(field(header, b"WARC-Refers-To"))
    payload = content[content.index(b"\r\n\r\n") + 4 :]
    found = hashlib.sha256(payload).hexdigest()
    if found != digest:
        raise ValueError(f"payload of {header!r} has digest {found}")
    return page_of(field(header, b"WARC-Record-ID")), len(payload), found, kind, None


def page_of(record_id: bytes) -> int | None:
    value = record_id.decode().removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as monolithic archives, normalises them and reads every record back through the index.

    Null html is an empty payload; null urls become urn:unknown; repeated rows are records
    of their own; a page of any length is one record; an empty table gives no rows; other
    columns of pages are ignored.
    """
    spark = pages.sparkSession
    raw, archives = new_path(spark, "warc-raw"), new_path(spark, "warc")
    write_monolithic(pages, raw)
    index = normalise(spark, raw, archives)
    drop_path(spark, raw)
    return read_back(spark, archives, index)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: one row per page, from the records read back."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM g
"""
