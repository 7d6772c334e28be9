"""WARC archives: records of pages written by tasks, and a reader that splits files at any byte.

A record is a gzip member of its own. A split of a file is a range of bytes; its task looks for the
magic of gzip, takes a place for a record only if the member decodes to a record's headers, and owns
the records that start in its range, following them from one to the next. A payload may itself hold
an archive, stored as it is; a range that begins within such a record would take the inner records for
the file's own. So where a file has several splits a first pass notes where the records of each end,
and a range begins at the end of the last record that started before it.

Both sides hold one record's payload in memory at a time, and the reader ``READ`` bytes of a file.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, shared_dir, sliced, table
from .token_files import opened

READ = 1 << 20
#: Headers of a record are no longer than this.
HEADERS = 1 << 16
MAGIC = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are always written whole.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(value: str) -> str:
    """A header's value on one line: controls are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, level: int) -> bytes:
    """One record as a gzip member; a revisit has the headers of its response but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(level, wbits=31)
    return b"".join([packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n"), packer.compress(body), packer.compress(b"\r\n\r\n"), packer.flush()])


def _writer(path: str, level: int):
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = opened(path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        n = size = 0
        with where.open_output_stream(f"{top}/.{name}", compression=None) as out:
            for batch in sliced(batches, "html", 1 << 20):
                for r in batch.to_pylist():
                    revisit = r["refers_to"] is not None
                    payload = (r["html"] or "").encode()
                    data = member(r["page_id"], r["url"], payload, len(payload), r["digest"], r["refers_to"], revisit, level)
                    out.write(data)
                    n, size = n + 1, size + len(data)
        where.move(f"{top}/.{name}", f"{top}/{name}")
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip((name, n, size), schema)], schema=schema)

    return run


def write_warc(pages: DataFrame, path: str, least: int = LEAST, level: int = 6) -> DataFrame:
    """Write ``page_id, url, html`` as archives below ``path``; returns ``file, records, bytes`` of each.

    Of pages with equal payloads of at least ``least`` bytes that of the smallest page_id is a response
    and the others are revisits of it. Rows that repeat this id are all responses, as are all of a group
    without ids; a null id in a group with ids is a revisit. Null html is an empty payload, a null url
    leaves its header out, and controls in a url are percent-encoded. Very long pages are one record
    each. An empty table leaves archives without records. A task that is run again leaves a file that
    the returned table doesn't name. Other columns are ignored.
    """
    spark = pages.sparkSession
    where, top = opened(path)
    where.create_dir(top, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    # written, so that the planner knows how small it is; only copied payloads are in it
    long = pages.where(F.octet_length("html") >= least)
    firsts = saved(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "firsts")
    first = F.when((F.octet_length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = pages.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", first.alias("refers_to"))
    return saved(rows.mapInArrow(_writer(path, level), "file string, records bigint, bytes bigint"), "archives")


@dataclass
class Found:
    """A record: where its member begins and ends, its headers, the bytes of its block (none if broken)."""

    start: int
    end: int
    headers: dict[str, str]
    block: bytes | None = field(repr=False, default=None)


class _File:
    """Bytes of a file from any place, in pieces of ``READ``."""

    def __init__(self, where: fs.FileSystem, path: str):
        self.source = where.open_input_file(path)
        self.size = self.source.size()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.source.close()

    def pieces(self, at: int) -> Iterator[bytes]:
        while at < self.size:
            piece = self.source.read_at(min(READ, self.size - at), at)
            yield piece
            at += len(piece)

    def magics(self, at: int, end: int) -> Iterator[int]:
        """Places in ``at..end`` where the magic stands."""
        while at < end:
            piece = self.source.read_at(min(READ, self.size - at), at)
            i = piece.find(MAGIC)
            while i >= 0 and at + i < end:
                yield at + i
                i = piece.find(MAGIC, i + 1)
            if i >= 0 or len(piece) < READ:
                return
            at += READ - len(MAGIC) + 1


def headers_of(head: bytes) -> tuple[dict[str, str], int] | None:
    """The headers (lower-case names) of a record that ``head`` begins with, and where its block begins."""
    stop = head.find(b"\r\n\r\n")
    if not re.match(rb"WARC/\d+\.\d+\r\n", head) or stop < 0:
        return None
    lines = head[:stop].decode("utf-8", "replace").split("\r\n")[1:]
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return (out, stop + 4) if out.get("content-length", "").isdigit() and "warc-type" in out else None


def _head_of_broken(file: _File, start: int) -> bytes:
    """What a member decodes to before it breaks, up to its headers' end; a call that fails gives nothing, so byte by byte."""
    unpack, out = zlib.decompressobj(wbits=31), bytearray()
    rest = file.source.read_at(min(HEADERS, file.size - start), start)
    try:
        while len(out) < HEADERS and not out.endswith(b"\r\n\r\n") and (byte := unpack.decompress(rest, 1)):
            out += byte
            rest = unpack.unconsumed_tail
    except zlib.error:
        pass
    return bytes(out)


def record_at(file: _File, start: int, keep: bool) -> Found | None:
    """The record of the member that begins at ``start``; None if that is no record, no block if it breaks off."""
    unpack = zlib.decompressobj(wbits=31)
    parts: list[bytes] = []
    read, have, found = start, 0, None
    try:
        for piece in file.pieces(start):
            read += len(piece)
            data = unpack.decompress(piece)
            have += len(data)
            if found is None:
                parts.append(data)
                if (found := headers_of(b"".join(parts))) is None:
                    if have > HEADERS:
                        return None
                elif not keep:
                    parts = []
            elif keep:
                parts.append(data)
            if unpack.eof:
                break
    except zlib.error:
        pass
    if found is None and (found := headers_of(_head_of_broken(file, start))) is None:
        return None
    headers, at = found
    n = int(headers["content-length"])
    if not unpack.eof or have < at + n:
        return Found(start, start + 1, headers)
    return Found(start, read - len(unpack.unused_data), headers, b"".join(parts)[at : at + n] if keep else b"")


def records(file: _File, start: int, end: int, keep: bool = True) -> Iterator[Found]:
    """The records that begin in ``start..end``; past a broken one the search goes on by magic."""
    at = start
    while at < end:
        place = next(file.magics(at, end), None)
        if place is None:
            return
        found = record_at(file, place, keep)
        if found is not None:
            yield found
        at = place + 1 if found is None else found.end


RECORD = "path string, start bigint, end bigint, record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, http_headers string, payload binary"
_RECORD = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])


def _row(path: str, r: Found) -> tuple:
    h = r.headers
    block, http = r.block, None
    if block is not None and h.get("content-type", "").replace(" ", "").startswith("application/http"):
        head, gap, block = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
    kind = h["warc-type"] if r.block is not None else "broken"
    return path, r.start, r.end, h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"), h.get("warc-refers-to"), http, block


def _reader(most: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                rows, held = [], 0
                with _File(*opened(path)) as file:
                    for r in records(file, start, end):
                        rows.append(_row(path, r))
                        held += len(r.block or b"")
                        if held > most:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``last``: where the last record ends that begins in the range."""
    for batch in batches:
        last = []
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
            with _File(*opened(path)) as file:
                last.append(max((r.end for r in records(file, start, end, keep=False)), default=start))
        yield pa.record_batch([*(batch.column(c) for c in ("path", "start", "end")), pa.array(last, pa.int64())], names=["path", "start", "end", "last"])


def _splits(files: DataFrame, split: int) -> DataFrame:
    """``path, start, end`` of the ranges of ``path, length``, a task for each."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split).cast("bigint"))
    splits = files.where("length > 0").select("path", "length", F.explode(starts).alias("start"))
    return splits.select("path", "start", F.least(F.col("start") + split, "length").alias("end"))


def _dealt(splits: DataFrame) -> DataFrame:
    return splits.repartitionByRange(max(1, splits.count()), "path", "start")


def read_warc(files: DataFrame, split: int | None = None) -> DataFrame:
    """The records of archives ``path, length`` (bytes), in the columns of ``RECORD``.

    ``split``: bytes of a range; ``spark.sql.files.maxPartitionBytes`` where it isn't given. Names of
    headers have any case; headers that are absent give null. HTTP headers and payload of a block of
    kind ``application/http`` are parted, other blocks are the payload. A record whose member breaks
    off or whose block is short comes as type ``broken`` with a null payload, and the next good one
    is found. Bytes between records are passed over. Records that repeat come as often as they stand
    there; empty files give none.
    """
    spark = files.sparkSession
    if split is None:
        split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    splits = _splits(files, split)
    many = splits.where(F.expr("start > 0")).select("path").distinct()
    noted = saved(_dealt(splits.join(many, "path", "left_semi")).mapInArrow(_ends, "path string, start bigint, end bigint, last bigint"), "ends")
    # a row for each range of a file
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begins = noted.select("path", "start", F.max("last").over(before).alias("begin"))
    splits = splits.join(begins, ["path", "start"], "left")
    splits = splits.select("path", F.greatest("start", "begin").alias("start"), "end").where("start < end")
    return _dealt(splits).mapInArrow(_reader(), RECORD)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the archives below a folder, by Spark's own listing."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select("path", "length")


def digests(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records of pages.

    A response's figures are those of the payload that was read, a revisit's those of its headers.
    """
    revisit = F.col("record_type") == "revisit"
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("bigint"))
    claimed = F.regexp_extract("http_headers", r"(?im)^content-length:\s*(\d+)", 1)
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"),
        F.when(revisit, claimed.cast("bigint")).otherwise(F.length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        F.when(revisit, number("refers_to")).alias("refers_to"),
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark) + "/warc"
    archives = write_warc(table(spark, sf_dir, "pages"), path)
    files = archives.where("records > 0").select(F.concat(F.lit(f"{path}/"), "file").alias("path"), F.col("bytes").alias("length"))
    return digests(read_warc(files))


QUERIES = {"op13_warc": op13_warc}
ORACLES = {
    "op13_warc": """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
    FROM f"""
}
