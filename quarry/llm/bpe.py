"""BPE encoding with content-defined chunk reuse, and decoding.

Chunks end where a rolling hash of the last ``WINDOW`` bytes has ``BITS`` zero bits, so the same
passage is cut alike wherever it stands. A chunk that two or more documents hold is encoded once:
the least (doc_id, number) owns it, its task encodes it, and the ids are joined to the other
documents. All other chunks are encoded in place.

A cut may fall inside a word, so ids near it are wrong until they are repaired. The bytes from the
last white space of a chunk to the first white space of the next are encoded anew as one piece;
then a window of that piece and its neighbours is encoded by the library, and must agree with the
ids put together. While it doesn't, the window grows by a word on either side, and at last takes
the whole text. So what comes out is what the library gives for the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, as_bytes, mix, record, saved, sieve, sliced, table
from .tokens import Encoder, public

WINDOW, BITS, LEAST = 24, 10, 256
#: The bytes of characters below U+0250.
LATIN = bytes(range(0xCA))
#: Bytes hashed at once.
STEP = 1 << 18


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base, n = 0x100000001B3, STEP + 2 * WINDOW
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(n, b, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def cuts(data: bytes) -> list[int]:
    """Bounds of the chunks of a text: content decides, at least ``LEAST`` bytes apart.

    The hash of a window is a polynomial in its bytes; all windows of a block come from one running
    sum, brought to the same power.
    """
    if not data:
        return [0]
    up, down = _powers()
    out, start = [0], 0
    while start < len(data) and len(data) >= 2 * LEAST:  # a block at a time, each with the window before it
        low = max(0, start - WINDOW + 1)
        x = np.frombuffer(data, np.uint8, min(len(data), start + STEP) - low, low)
        n = x.size - WINDOW + 1
        if n > 0:
            sums = np.zeros(x.size + 1, np.uint64)
            np.cumsum((x.astype(np.uint64) + np.uint64(1)) * down[: x.size], out=sums[1:])
            h = (sums[WINDOW:] - sums[:n]) * up[WINDOW - 1 : WINDOW - 1 + n]
            ends = np.flatnonzero(mix(h) >> np.uint64(64 - BITS) == 0) + low + WINDOW
            for e in ends.tolist():
                if e - out[-1] >= LEAST and len(data) - e >= LEAST:
                    out.append(e)
        start += STEP
    return [*out, len(data)]


def chunk_hash(chunk: bytes) -> bytes:
    """What a chunk is known by: 128 bits, so that among 10**12 chunks two meet with a chance of 1e-15."""
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _ragged(chunk: bytes) -> tuple[bytes, list[bytes], bytes]:
    """A chunk's bytes before its first white space, the pieces between, and the bytes after its last.

    A chunk without white space is all head, and its tail is the same bytes.
    """
    inner = chunk.split()
    if len(inner) == 1 and len(inner[0]) == len(chunk):
        return chunk, [], chunk
    head = inner.pop(0) if inner and chunk[0] not in SPACES else b""
    tail = inner.pop() if inner and chunk[-1] not in SPACES else b""
    return head, inner, tail


class Chunks(Encoder):
    """Encodes chunks as lists of whole pieces with their ragged ends, and joins them exactly."""

    def of(self, pieces: list[bytes]) -> bytes:
        new = self.memory[0]
        try:
            return b"".join([new[p] for p in pieces])
        except KeyError:
            table = self.known(set(pieces), bytes.decode)
            return b"".join([table[p] for p in pieces])

    def encoded(self, chunk: bytes) -> tuple[bytes, bytes, bytes]:
        head, inner, tail = _ragged(chunk)
        return head, self.of(inner), tail

    def folded(self, data: bytes) -> bytes:
        """A whole text in lower case if that leaves its ids as they are, so that fewer pieces differ.

        The library folds case itself, but finds special tokens before that, and composes letters with
        marks that stand after them; there are none below U+0250.
        """
        return data.lower() if self.folds and b"<|" not in data and not data.translate(None, LATIN) else data

    def prepare(self, texts: list[bytes], chunks: list[bytes]) -> None:
        """Learn the pieces of some whole texts, and the whole pieces of some chunks, together."""
        self.known(set().union(*(t.split() for t in texts), *(_ragged(c)[1] for c in chunks)), bytes.decode)

    def joined(self, data: bytes, bounds: list[int], known: dict[int, tuple[bytes, bytes, bytes]]) -> bytes:
        """Ids of a whole text from its chunks; ``known`` has chunks that were encoded elsewhere."""
        ids, open_, low = [], b"", self.folded(data)
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            head, middle, tail = known[k] if k in known else self.encoded(low[a:b])
            if head == tail and len(head) == b - a:
                open_ += head
                continue
            joint = open_ + head
            if joint:
                ids.append(self.of([joint]))
            if k and not self.agrees(data, low, a, joint):
                return self.whole(data)
            ids.append(middle)
            open_ = tail
        if open_:
            ids.append(self.of([open_]))
        return b"".join(ids)

    def agrees(self, data: bytes, folded: bytes, at: int, joint: bytes) -> bool:
        """True if the library gives the joint and a neighbour on each side the ids of its folded pieces."""
        for reach in (16, 256, 2048):
            low, high = max(0, at - len(joint) - reach), min(len(data), at + len(joint) + reach)
            window = data[low:high]
            # the ragged ends of the window are left out
            first = 0 if low == 0 else next((i for i, b in enumerate(window) if b in SPACES), None)
            last = len(window) if high == len(data) else next((i for i in range(len(window), 0, -1) if window[i - 1] in SPACES), None)
            if first is None or last is None or not low + first <= at <= low + last:
                continue
            if self.raw([window[first:last].decode()])[0] == self.of(folded[low + first : low + last].split()):
                return True
        return False

    def whole(self, data: bytes) -> bytes:
        return self.raw([data.decode()])[0]

    @cached_property
    def strings(self) -> pa.Array:
        """Each id's token with a space behind it."""
        return pa.array([(self.library.id_to_token(i) or "").encode() + b" " for i in range(self.library.get_vocab_size())], pa.large_binary())

    def decoded(self, ids: np.ndarray) -> bytes:
        """What the library's ``decode(ids, skip_special_tokens=False)`` gives, in UTF-8."""
        if self.library.decoder is not None:
            return self.library.decode(ids.tolist(), skip_special_tokens=False).encode()
        if not ids.size:
            return b""
        _, bounds, text = self.strings.take(pa.array(ids)).buffers()
        return text[: int(np.frombuffer(bounds, np.int64)[ids.size]) - 1].to_pybytes()


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every chunk of every text: its hash and its number in the document."""
    schema = pa.schema([("chunk", pa.binary()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("k", pa.int32())])
    for batch in sliced(batches):
        rows = []
        for i, h, data in zip(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), as_bytes(batch.column("text"))):
            c = cuts(data)
            rows += [(chunk_hash(data[a:b]), i, h, k) for k, (a, b) in enumerate(zip(c, c[1:]))]
        if rows:
            yield record(schema, *zip(*rows))


_ENCODED = pa.struct([("k", pa.int32()), ("head", pa.binary()), ("ids", pa.binary()), ("tail", pa.binary())])


def _owned(vocabulary: str):
    """Encodes the chunks that a document owns."""
    schema = pa.schema([("chunk", pa.binary()), ("head", pa.binary()), ("ids", pa.binary()), ("tail", pa.binary())])
    encoder = Chunks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1 << 20):
            hashes, mine = [], []
            for data, ks in zip(as_bytes(batch.column("text")), batch.column("own").to_pylist()):
                c, low = cuts(data), encoder.folded(data)
                hashes += [chunk_hash(data[c[k] : c[k + 1]]) for k in ks]
                mine += [low[c[k] : c[k + 1]] for k in ks]
            encoder.prepare([], mine)
            rows = [(h, *encoder.encoded(c)) for h, c in zip(hashes, mine)]
            if rows:
                yield record(schema, *zip(*rows))

    return run


def _digests(vocabulary: str):
    """Joins the chunks of each text, and digests its ids and the text decoded from them."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    encoder = Chunks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1 << 20):
            n, out = [], []
            shared = batch.column("shared").to_pylist() if "shared" in batch.schema.names else [None] * batch.num_rows
            shared = [{s["k"]: (s["head"], s["ids"], s["tail"]) for s in known or []} for known in shared]
            texts = as_bytes(batch.column("text"))
            places = [cuts(data) for data in texts]
            # only what isn't known yet: chunks that were encoded elsewhere are left out
            low = [encoder.folded(data) for data in texts]
            own = [data[a:b] for data, c, known in zip(low, places, shared) if known for k, (a, b) in enumerate(zip(c, c[1:])) if k not in known]
            encoder.prepare([data for data, known in zip(low, shared) if not known], own)
            for data, c, known in zip(texts, places, shared):
                ids = encoder.joined(data, c, known) if data else b""
                out.append(ids)
                n.append(len(ids) // encoder.dtype.itemsize)
            yield record(schema, batch.column("doc_id"), n, out)

    return run, encoder


def encoded(docs: DataFrame, vocabulary: str, digest: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, or with ``digest=False`` ``ids`` (binary).

    Null and empty texts have no ids. Every row gives a row, also where a doc_id repeats; rows with
    a null id are encoded in place. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    key = ["doc_id", "hash"]  # a doc_id may have several texts
    # it is read twice, and cutting and hashing again costs more than the file
    listed = saved(docs.where("doc_id IS NOT NULL").mapInArrow(_listing, "chunk binary, doc_id bigint, hash bigint, k int"), "listed")
    owners = listed.groupBy("chunk").agg(F.min(F.struct(*key, "k")).alias("owner"), F.max(F.struct(*key)).alias("last")).where((F.col("last.doc_id") != F.col("owner.doc_id")) | (F.col("last.hash") != F.col("owner.hash"))).select("chunk", "owner")
    uses = saved(listed.join(owners, "chunk").distinct(), "uses")
    # only documents that may hold a shared chunk are shuffled
    part = sieve(docs, saved(uses.select("doc_id").distinct(), "sharing"))

    own = uses.where((F.col("owner.doc_id") == F.col("doc_id")) & (F.col("owner.hash") == F.col("hash")) & (F.col("owner.k") == F.col("k")))
    own = saved(own.groupBy(*key).agg(F.collect_list("k").alias("own")), "own")
    done = saved(sieve(docs, own).where("maybe").join(own, key).select("text", "own").mapInArrow(_owned(vocabulary), "chunk binary, head binary, ids binary, tail binary").dropDuplicates(["chunk"]), "encoded")
    shared = uses.select(*key, "k", "chunk").join(done, "chunk").groupBy(*key).agg(F.collect_list(F.struct("k", "head", "ids", "tail")).alias("shared"))

    run, encoder = _digests(vocabulary)
    if digest:
        inner = run
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in inner(batches):
                a, b = [], []
                for raw in batch.column("ids").to_pylist():
                    ids = np.frombuffer(raw, encoder.dtype)
                    a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(encoder.decoded(ids)).hexdigest())
                yield record(schema, batch.column("doc_id"), batch.column("n_tokens"), a, b)

        ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    else:
        ddl = "doc_id bigint, n_tokens bigint, ids binary"
    alone = part.where("NOT maybe").drop("maybe").mapInArrow(run, ddl)
    return alone.unionByName(part.where("maybe").drop("maybe").join(shared, key, "left").mapInArrow(run, ddl))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"))


QUERIES = {"op3_bpe": op3_bpe}
ORACLES: dict[str, str] = {}
