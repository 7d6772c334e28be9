"""GIF as a media column: LZW code streams, palettes, disposal, transparency, timed frames.

``encode`` writes 8-bit samples as frames of one palette; ``decode`` reads any GIF87a or GIF89a
and composes each frame on the canvas by the rules of the format. Both work on one value at a
time; frames bound what is unpacked at once. The DataFrame functions are maps over rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, record, saved, sliced, table

#: Samples in a row and rows in a frame of what ``payload_gif`` writes; hundredths of a second a frame.
WIDTH, ROWS, DELAY = 64, 1024, 4
#: The most pixels of a canvas or frame that is read.
PIXELS = 1 << 26
GREY = bytes(v for i in range(256) for v in (i, i, i))


@dataclass
class Frame:
    delay_cs: int
    box: tuple[int, int, int, int]  # left, top, width, height
    disposal: int
    canvas: np.ndarray  # height, width, RGBA


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of each of n codes after a clear, for a minimum code size."""
    known = np.arange(n) + (1 << size) + 1
    return np.clip(np.floor(np.log2(np.maximum(known, 1))).astype(np.int64) + 1, size + 1, 12)


_TABLE = {size: _widths(4096, size) for size in range(1, 12)}


def lzw_codes(data: bytes, size: int = 8) -> tuple[list[int], list[int]]:
    """The codes of some samples, and the places of the clear codes among them."""
    clear = 1 << size
    codes, clears, known, fresh = [clear], [0], {}, clear + 2
    put, get = codes.append, known.get
    samples = iter(data)
    at = next(samples, None)
    if at is not None:
        for b in samples:
            key = at << 8 | b
            code = get(key)
            if code is not None:
                at = code
                continue
            put(at)
            known[key] = fresh
            fresh += 1
            if fresh == 4096:
                clears.append(len(codes))
                put(clear)
                known.clear()
                fresh = clear + 2
            at = b
        put(at)
    put(clear + 1)
    return codes, clears


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    codes, clears = lzw_codes(data, size)
    width = np.empty(len(codes), np.int64)
    for a, b in zip(clears, [*clears[1:], len(codes)]):
        # a clear code has the width that the codes before it have reached
        width[a + 1 : b] = _TABLE[size][: b - a - 1]
        width[a] = size + 1 if a == 0 else _TABLE[size][a - last - 1]  # noqa: F821
        last = a
    bits = np.arange(12)
    grid = (np.array(codes, np.int64)[:, None] >> bits) & 1
    return np.packbits(grid[bits < width[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(data: bytes, size: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream; a stream that breaks off gives what it has.

    Raises ValueError for a code size that the format doesn't have.
    """
    if not 1 <= size <= 8:
        raise ValueError(f"no code size {size}")
    size = max(2, size)
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    bits, at, out, have = 8 * len(data), 0, [], 0
    start = [bytes([i]) for i in range(clear)] + [b"", b""]
    while at < bits and have < most:
        # the codes up to the next clear: their widths follow from their number
        known, before, done = list(start), b"", 0
        while at < bits and have < most:
            n = min(4096, (bits - at) // (size + 1) + 1)
            width = _TABLE[size][np.minimum(np.arange(done, done + n), 4095)]
            place = at + np.concatenate([[0], np.cumsum(width)[:-1]])
            width, place = (x[place + width <= bits] for x in (width, place))
            if not width.size:
                at = bits
                break
            byte = place >> 3
            codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7)) & ((1 << width) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            use = codes[: stop[0]] if stop.size else codes
            room = 4096 - len(known)
            for code in use.tolist():
                if code < len(known):
                    s = known[code]
                    if before and room > 0:
                        known.append(before + s[:1])
                        room -= 1
                elif before and code == len(known):
                    s = before + before[:1]
                    known.append(s)
                    room -= 1
                else:
                    return b"".join(out)[:most]
                out.append(s)
                have += len(s)
                before = s
            if stop.size:
                if codes[stop[0]] == end:
                    return b"".join(out)[:most]
                at = int(place[stop[0]] + width[stop[0]])
                break
            done += n
            at = int(place[-1] + width[-1])
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(frames: list[tuple[bytes, int, int]], palette: bytes = GREY) -> bytes:
    """A GIF of frames ``(samples, rows, delay)`` of width ``WIDTH``, each drawn from the top."""
    height = max((rows for _, rows, _ in frames), default=1)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), palette]
    for samples, rows, delay in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, rows, 0) + b"\x08" + _blocks(lzw_encode(samples)))
    return b"".join(out) + b"\x3b"


def decode(data: bytes) -> Iterator[Frame]:
    """Frames of a GIF, composed. Raises ValueError if the data isn't a GIF; stops where it breaks off."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def colours(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        table = np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)
        at += 3 * n
        return table

    def chain() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    if width * height > PIXELS:
        raise ValueError(f"a canvas of {width} x {height}")
    shared = colours(flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear = 0, 0, None
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            at += 1
            body = chain()
            if label == 0xF9 and len(body) >= 4:
                control, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear = control >> 2 & 7, index if control & 1 else None
        elif kind == 0x2C and at + 10 <= len(data):
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            table = colours(flags)
            table = shared if table is None else table
            size = data[at] if at < len(data) else 8
            at += 1
            if w * h > PIXELS:
                raise ValueError(f"a frame of {w} x {h}")
            samples = np.frombuffer(lzw_decode(chain(), size, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if flags & 0x40:  # interlaced: four passes
                order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                whole = np.empty_like(samples)
                whole[order] = samples
                samples = whole
            kept = canvas.copy() if disposal == 3 else None
            room = canvas[top : top + h, left : left + w]
            part = samples[: room.shape[0], : room.shape[1]]
            full = np.zeros((256, 4), np.uint8)
            if table is not None:
                full[: len(table), :3] = table
                full[: len(table), 3] = 255
            drawn = full[part]
            seen = np.ones(part.shape, bool) if clear is None else part != clear
            room[seen] = drawn[seen]
            yield Frame(delay, (left, top, w, h), disposal, canvas.copy())
            if disposal == 2:
                canvas[top : top + h, left : left + w] = 0
            elif disposal == 3:
                canvas = kept
            delay, disposal, clear = 0, 0, None
        else:
            break


def histogram(frame: Frame) -> list[int]:
    """Pixels of a frame's box in each of 16 steps of red, green and blue; clear pixels don't count."""
    left, top, w, h = frame.box
    part = frame.canvas[top : top + h, left : left + w].reshape(-1, 4)
    part = part[part[:, 3] > 0]
    return np.concatenate([np.bincount(part[:, c] >> 4, minlength=16) for c in range(3)]).tolist()


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


def payload_gif(payload: bytes) -> bytes:
    step = WIDTH * ROWS
    return encode([(payload[i : i + step], len(payload[i : i + step]) // WIDTH, DELAY) for i in range(0, len(payload), step)])


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's padded UTF-8 bytes as a GIF, written to the shared folder.

    Null and empty texts have 64 zero bytes; equal texts have equal media. Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1 << 20):
            raw = as_bytes(batch.column("text"))
            yield record(schema, batch.column("doc_id"), [len(r) for r in raw], [payload_gif(padded(r)) for r in raw])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(docs.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary"), "media")


FRAMES = "array<struct<delay_cs int, width int, height int, histogram array<bigint>>>"
_FRAMES = pa.list_(pa.struct([("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))]))


def described(media: DataFrame) -> DataFrame:
    """Reads a ``media`` column: ``doc_id, n_bytes, payload, frames`` (timed, with colour histograms).

    Null and broken media have a null payload; broken ones keep the frames before the break. A canvas
    or frame of more than ``PIXELS`` pixels counts as broken (a header of ten bytes can claim 4 GB).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload", pa.binary()), ("frames", _FRAMES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media", 1 << 20):
            size, sha, payload, frames = [], [], [], []
            for m in batch.column("media").to_pylist():
                size.append(None if m is None else len(m))
                sha.append(None if m is None else hashlib.sha256(m).hexdigest())
                parts, mine = [], []
                try:
                    for f in decode(m or b""):
                        left, top, w, h = f.box
                        parts.append(f.canvas[top : top + h, left : left + w, 0].tobytes())
                        mine.append({"delay_cs": f.delay_cs, "width": w, "height": h, "histogram": histogram(f)})
                    payload.append(b"".join(parts))
                except ValueError:
                    payload.append(None)
                frames.append(mine)
            yield record(schema, batch.column("doc_id"), batch.column("n_bytes"), size, sha, payload, frames)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id bigint, n_bytes bigint, media_bytes bigint, media_sha256 string, payload binary, frames {FRAMES}")


def op6_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = described(stored(table(spark, sf_dir, "documents")))
    sums = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.aggregate("frames", F.lit(0).cast("bigint"), lambda s, f: s + F.element_at(f["histogram"], i)))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -WIDTH, WIDTH)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.array_join(sums.cast("array<string>"), ",").alias("feature"),
        F.size("frames").alias("n_frames"),
    )


QUERIES = {"op6_media_gif": op6_media_gif}
ORACLES: dict[str, str] = {}
