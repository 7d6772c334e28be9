"""What the operators of this package share: tables, scratch space, word hashes and Arrow batches.

Words are hashed with numpy over whole Arrow buffers: a byte table folds case and marks
separators, each word is a polynomial in its bytes modulo 2**64, then mixed. A block of at most
``BLOCK`` bytes is in memory at a time (a longer word or text is taken whole), so memory follows
the longest text and not the partition.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 18
#: 512 bitmaps of 4 KB.
SIEVE_BITS = 1 << 24
SPACES = b" \t\n\x0b\x0c\r"
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, below ``spark.checkpoint.dir``.

    Only on one machine (a local master), where that is unset, a temporary folder takes its place;
    a cluster without the setting is an error, since its machines don't see each other's folders.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/quarry-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


#: The folders made within a ``noted`` block.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def noted() -> Iterator[list[str]]:
    """A list of the scratch folders that the block makes, for a caller that knows when nothing needs them."""
    paths: list[str] = []
    token = _made.set(paths)
    try:
        yield paths
    finally:
        _made.reset(token)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders wherever Spark's file systems keep them."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and is there if an executor goes."""
    return Scratch(df.sparkSession).save(df, name)


class Scratch:
    """Tables of one computation in a folder of its own; each can go once its readers are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, shared_dir(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.top}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        removed(self.spark, [f"{self.top}/{n}" for n in names])


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def least_hashed(rows: DataFrame, n: int, key: str) -> DataFrame:
    """At most ``n`` rows, those of least hash of ``key``: the same ones however the rows are dealt.

    The hash has to be below a share of its range that is sure to hold n rows (they spread evenly;
    the margin is eight standard deviations), so few more than n are sorted, whatever the partitions.
    """
    share = (n + 8 * n**0.5 + 50) / max(1, rows.count())
    rank = F.xxhash64(key, F.lit(1))
    some = rows if share >= 1 else rows.where(rank.bitwiseAND((1 << 40) - 1) / float(1 << 40) < share)
    return some.orderBy(rank.bitwiseAND((1 << 40) - 1), key).limit(n)


def sieve(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``maybe``: false only if no row of ``wanted`` has the doc_id.

    A bitmap of ``SIEVE_BITS`` bits is broadcast, so a text that it rules out need not be shuffled
    to a join. Its size is fixed: where the wanted ids fill it, it lets more rows through.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE_BITS))
    bits = wanted.select(at.alias("at")).groupBy(F.expr("at DIV 32768").alias("_part")).agg(F.expr("bitmap_construct_agg(CAST(at % 32768 AS BIGINT))").alias("_bits"))
    seen = docs.withColumn("_at", at).join(F.broadcast(bits), F.expr("_at DIV 32768") == F.col("_part"), "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST((_at % 32768) DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    return seen.withColumn("maybe", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, CAST(_at % 8 AS INT))")) != 0, F.lit(False))).drop("_at", "_part", "_bits")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _splitmix(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(_ODD))


class Words:
    """Hashes of the words of many texts. ``gaps``: the bytes that part words; case folds A-Z."""

    def __init__(self, gaps: bytes = SPACES, seed: int = 7, prefixes: tuple[int, ...] = ()):
        self.prefixes = prefixes
        t = _splitmix(256, seed) | np.uint64(1)
        t[65:91] = t[97:123]
        self.gap = np.zeros(256, bool)
        self.gap[list(gaps)] = True
        t[self.gap] = 0
        self.table, self.size = t, 0
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        if n > self.size:
            inverse = pow(_ODD, -1, 1 << 64)
            self.size = max(n, 2 * self.size)
            for name, base in (("up", _ODD), ("down", inverse)):
                powers = np.full(self.size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, their starts, and of each text (from ``bounds``) the first word's number.

        With ``prefixes`` there is a column for the word and one for each prefix of so many bytes
        (0 where the word is no longer).
        """
        none = (0, 1 + len(self.prefixes)) if self.prefixes else 0
        if not data.size:
            return np.zeros(none, np.uint64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        self.grow(data.size)
        word = ~self.gap[data]
        fresh = word.copy()
        fresh[1:] &= ~word[:-1]
        cut = bounds[(bounds > 0) & (bounds < data.size)]
        fresh[cut] = word[cut]
        starts = np.flatnonzero(fresh)
        if not starts.size:
            return np.zeros(none, np.uint64), starts, np.zeros(len(bounds), np.int64)
        value = self.table[data]
        value *= self.up[: data.size]
        sums = np.add.reduceat(value, starts)
        first = np.searchsorted(starts, bounds)
        if not self.prefixes:
            return mix(sums * self.down[starts]), starts, first
        length = np.add.reduceat(word.astype(np.int32), starts)
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        columns = [mix(sums * self.down[starts])]
        for n in self.prefixes:
            head = before[np.minimum(starts + n, data.size)] - before[starts]
            columns.append(np.where(length > n, mix(head * self.down[starts] + np.uint64(n)), np.uint64(0)))
        return np.column_stack(columns), starts, first

    def texts(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """For runs of whole texts: the number of the first, and the word hashes of each."""
        i, last = 0, len(bounds) - 1
        while i < last:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, "right")) - 1)
            if bounds[j] - bounds[i] <= BLOCK:
                part = bounds[i : j + 1] - bounds[i]
                h, _, first = self.block(data[bounds[i] : bounds[j]], part)
                yield i, [h[a:b] for a, b in zip(first[:-1], first[1:])]
            else:
                yield i, [np.concatenate([*self.long(data[bounds[i] : bounds[j]])])]
            i = j

    def long(self, data: np.ndarray) -> Iterator[np.ndarray]:
        at = 0
        while at < data.size:
            end = min(at + BLOCK, data.size)
            while end < data.size:
                gaps = np.flatnonzero(self.gap[data[at:end]])
                if gaps.size:
                    end = at + int(gaps[-1]) + 1
                    break
                end = min(end + BLOCK, data.size)
            yield self.block(data[at:end], np.array([0, end - at]))[0]
            at = end


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the bounds of an Arrow string column, without a copy; null is empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``most`` bytes of a string column, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = buffers(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = min(batch.num_rows, max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j


def as_bytes(texts: pa.Array) -> list[bytes]:
    data, bounds = buffers(texts)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
