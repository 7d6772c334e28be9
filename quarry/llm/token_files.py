"""Token ids as Arrow stream files of equal-length sequences.

Documents are range-partitioned by doc_id and sorted, so files and the rows in them follow the
order of ids. Each task writes one file of sequences, ``ids fixed_size_list<uint>[length]`` and
``mask fixed_size_list<uint8>[length / 8]`` (a bit for each id) in batches of equal size, and one small index file with
the place of each document. Documents are packed back to back; only a file's last sequence is
padded, and its mask says where. All batches of a file but its last have one size, so ``sequence``
maps a file, steps to the batch of sequence i and gives views of its buffers. A file is written
under a name of its attempt and then moved; a task that is run again may leave a second file, which
nothing refers to: only the files that the returned table names count.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import record, saved, shared_dir, sliced, table
from .tokens import Encoder, public

LENGTH, ROWS = 1024, 256


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class SequenceWriter:
    """Packs ids into sequences of ``length`` and writes them batch by batch."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        if length % 8:
            raise ValueError("length must be a multiple of 8")
        self.dtype, self.length, self.size = dtype, length, length * rows
        width = {2: pa.uint16(), 4: pa.uint32()}[dtype.itemsize]
        self.schema = pa.schema([("ids", pa.list_(width, length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.out, self.held, self.n = pa.ipc.new_stream(sink, self.schema), bytearray(), 0

    def add(self, ids: bytes) -> None:
        self.held += ids
        self.n += len(ids) // self.dtype.itemsize
        step = self.size * self.dtype.itemsize
        while len(self.held) >= step:
            self._write(np.frombuffer(bytes(self.held[:step]), self.dtype), self.size)
            del self.held[:step]

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.packbits(np.arange(ids.size) < real, bitorder="little")
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x, n in ((ids, self.length), (mask, self.length // 8))]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if rest := len(self.held) // self.dtype.itemsize:
            ids = np.zeros(-(-rest // self.length) * self.length, self.dtype)
            ids[:rest] = np.frombuffer(bytes(self.held), self.dtype)
            self._write(ids, rest)
        self.out.close()


def read_sequences(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids ``(rows, length)`` and mask bits ``(rows, length / 8)`` of each batch, as views of its buffers."""
    where, name = opened(path)
    with where.open_input_file(name) as f, pa.ipc.open_stream(f) as stream:
        for batch in stream:
            ids, mask = (c.flatten().to_numpy(zero_copy_only=True).reshape(batch.num_rows, -1) for c in batch.columns)
            yield ids, mask


def sequence(path: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask bits of sequence i of a file; a local file is mapped, and both are views of it."""
    where, name = opened(path)
    source = pa.memory_map(name) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(name)
    schema = pa.ipc.read_schema(source)
    start = source.tell()
    try:
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
        k, j = divmod(i, batch.num_rows)
        if k:
            source.seek(start + k * (source.tell() - start))
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    except (EOFError, OSError, pa.ArrowInvalid):
        raise IndexError(i) from None
    if i < 0 or j >= batch.num_rows:
        raise IndexError(i)
    return tuple(c.slice(j, 1).flatten().to_numpy(zero_copy_only=True) for c in batch.columns)


def _writer(path: str, vocabulary: str, end_id: int, length: int, rows: int):
    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    encoder = Encoder(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        where, top = opened(path)
        own = f"{top}/.part-{part:05d}-{uuid.uuid4().hex}"
        final = f"{top}/part-{part:05d}-{uuid.uuid4().hex}"
        end = np.array([end_id], encoder.dtype).tobytes()
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        docs = 0
        with where.open_output_stream(f"{own}.arrows") as a, where.open_output_stream(f"{own}.index") as b:
            sequences, places = SequenceWriter(a, encoder.dtype, length, rows), pa.ipc.new_stream(b, index)
            for batch in sliced(batches):
                starts, sizes = [], []
                for ids in encoder.column(batch.column("text").fill_null("")):
                    starts.append(sequences.n)
                    sequences.add(ids + end)
                    sizes.append(sequences.n - starts[-1])
                places.write_batch(record(index, batch.column("doc_id"), starts, sizes))
                docs += batch.num_rows
            sequences.close()
            places.close()
        for kind in ("arrows", "index"):
            where.move(f"{own}.{kind}", f"{final}.{kind}")
        yield record(schema, [part], [final.removeprefix(top).lstrip("/")], [sequences.n], [docs])

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Write the files below ``path``; returns ``part, file, n, docs, start`` of each.

    Null and empty texts have the end id alone. Null ids come first; rows that repeat an id follow
    one another. An empty table leaves files without rows. The columns but doc_id and text are ignored.
    """
    where, top = opened(path)
    where.create_dir(top, recursive=True)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sorted_ = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = saved(sorted_.mapInArrow(_writer(path, vocabulary, end_id, length, rows), "part int, file string, n bigint, docs bigint"), "files")
    # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def read_token_files(files: DataFrame, path: str) -> DataFrame:
    """Each document's place in the whole sequence of ids, and the crc32 of its ids, from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                where, top = opened(path)
                blocks = read_sequences(f"{path}/{file}.arrows")
                held = np.zeros(0, np.uint16)
                with where.open_input_file(f"{top}/{file}.index") as f, pa.ipc.open_stream(f) as index:
                    for part in index:
                        crc = []
                        for n in part.column("n_tokens").to_pylist():
                            pieces = [held]
                            have = held.size
                            while have < n:
                                ids, mask = next(blocks)
                                pieces.append(ids.ravel()[: int(np.bitwise_count(mask).sum())])
                                have += pieces[-1].size
                            held = np.concatenate(pieces) if len(pieces) > 1 else held
                            crc.append(zlib.crc32(held[:n].astype("<u4").tobytes()))
                            held = held[n:]
                        yield record(schema, part.column("doc_id"), [first + s for s in part.column("start").to_pylist()], part.column("n_tokens"), crc)

    # a task for each file: the number keeps the few small rows from being put together
    return files.select("part", "file", "start").repartitionByRange(max(1, files.count()), "part").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark) + "/tokens"
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), path, public("byte_bpe_50k.json")), path)


QUERIES = {"op7_token_files": op7_token_files}
ORACLES: dict[str, str] = {}
