"""Product-quantised vectors: codebooks by rounds of ``treeAggregate`` over columnar numpy blocks.

Rows are packed once into blocks of at most ``BLOCK`` rows, components as columns of integers, written
to the shared folder and read by each round. A task adds up squared distances component by component,
gives each part of each vector to its nearest entry and adds its components to int64 tensors of sums
and counts (parts x entries x components); only these meet in the reduction tree, so what is moved and
what the driver holds don't grow with the rows. The codebooks of a round are broadcast: parts x entries
x components integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record, saved, table
from .vectors import finite, integers, longest

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
BLOCK = 4096
#: Vectors whose distances to all entries are in memory at once.
STEP = 512


def cap(width: int) -> int:
    """The greatest component: sums of squared differences of a part's components fit in int64."""
    return int(((1 << 60) // max(1, width)) ** 0.5)


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector (a column of ``part``) the nearest entry, the lower index in a tie, and the squared distance."""
    top = max(int(np.abs(part).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.int32 if len(part) * (2 * top) ** 2 < 1 << 31 else np.int64
    part, columns = part.astype(kind), np.ascontiguousarray(entries.T.astype(kind))
    n = part.shape[1]
    code, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(0, n, STEP):
        some = part[:, i : i + STEP]
        total = np.zeros((some.shape[1], len(entries)), kind)
        gap = np.empty_like(total)
        for x, y in zip(some, columns):
            np.subtract(x[:, None], y, out=gap)
            np.multiply(gap, gap, out=gap)
            total += gap
        code[i : i + STEP] = at = total.argmin(1)
        error[i : i + STEP] = total[np.arange(len(at)), at]
    return code, error


def _packed(dims: int, parts: int):
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                some = batch.slice(i, BLOCK)
                columns = integers(some.column("embedding"), dims, SCALE, cap(dims // parts)).T
                yield record(schema, [some.column("vec_id").to_pylist()], [some.column("label").to_pylist()], [np.ascontiguousarray(columns).tobytes()])

    return run


def _unpacked(block: bytes, parts: int, width: int) -> np.ndarray:
    """Parts x components x vectors."""
    return np.frombuffer(block, np.int64).reshape(parts, width, len(block) // (8 * parts * width) if width else 0)


def trained(packed: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (parts x entries x components) after so many rounds; entries that nothing uses stay."""
    parts, k, width = codebooks.shape
    if not codebooks.size:
        return codebooks
    blocks = packed.select("block").rdd.map(lambda r: bytes(r[0]))

    def merge(a, b):
        if a is None or b is None:
            return b if a is None else a
        return a[0] + b[0], a[1] + b[1]

    for _ in range(rounds):
        sent = packed.sparkSession.sparkContext.broadcast(codebooks)

        def add(held, block, sent=sent):
            sums, counts = held or (np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64))
            for p, part in enumerate(_unpacked(block, parts, width)):
                code, _ = nearest(part, sent.value[p])
                np.add.at(sums[p], code, part.T)
                np.add.at(counts[p], code, 1)
            return sums, counts

        sums, counts = blocks.treeAggregate(None, add, merge, depth=2) or (0, np.zeros((parts, k), np.int64))
        codebooks = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], codebooks)
        sent.unpersist()
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    """Of the components' decimal numbers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def _coded(codebooks: np.ndarray):
    parts, _, width = codebooks.shape
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in ("ids", "labels"))
                if not width:  # vectors without components: all are the first entry
                    yield record(schema, ids, labels, ["00" * parts] * len(ids), [0] * len(ids))
                    continue
                found = [nearest(x, y) for x, y in zip(_unpacked(batch.column("block")[i].as_py(), parts, width), codebooks)]
                digits = max(2, len(f"{max(0, codebooks.shape[1] - 1):x}"))
                codes = ["".join(f"{c:0{digits}x}" for c in row) for row in np.stack([c for c, _ in found], 1).tolist()]
                yield record(schema, ids, labels, codes, sum(e for _, e in found))

    return run


def quantised(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of each row with a finite vector, and the codebooks.

    A vector that is null or has a null or non-finite component drops out; a null id or label
    stays null. Shorter vectors, and all where the length isn't a multiple of the parts, count as
    filled up with zeros; components beyond the range in which distances fit a long count as its
    end. Rows that repeat an id are rows of their own; the first codebook takes the rows of least id
    (null last), then of least components. With fewer rows than entries there are as many entries as
    rows. An empty table gives no rows and no entries. Other columns are ignored.
    """
    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where(finite(F.col("embedding")))
    dims = -(-longest(kept, "embedding") // parts) * parts
    packed = saved(kept.mapInArrow(_packed(dims, parts), "ids array<bigint>, labels array<bigint>, block binary"), "packed")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow().column(0).combine_chunks()
    books = integers(first, dims, SCALE, cap(dims // parts)).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    books = trained(packed, np.ascontiguousarray(books), rounds)
    return packed.mapInArrow(_coded(books), "vec_id bigint, label bigint, code string, error bigint"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = quantised(table(spark, sf_dir, "embeddings"))
    codes = saved(codes, "codes")
    # a sum that no long holds is null
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Parts as rows: ``c0`` the first codebooks, ``a1``/``c1`` .. the rounds, ``a5`` the last assignment."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
    a{r} AS MATERIALIZED (
      SELECT vec_id, part, v, best.i AS entry, best.d AS d FROM (
        SELECT vec_id, part, any_value(x.v) AS v, min({{'d': list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v), 'i': entry}}) AS best
        FROM parts x JOIN c{r} c USING (part) GROUP BY vec_id, part)),""")
        if r < ROUNDS:
            steps.append(f"""
    c{r + 1} AS MATERIALIZED (
      SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
        SELECT part, entry, list(x ORDER BY place) AS v FROM (
          SELECT part, entry, place, floor(sum(v[place]) / count(*)) AS x
          FROM a{r}, range(1, (SELECT len(v) + 1 FROM a{r} LIMIT 1)) AS places(place) GROUP BY ALL) GROUP BY ALL) m USING (part, entry)),""")
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    parts AS MATERIALIZED (
      SELECT vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) AS t(part)),
    c0 AS MATERIALIZED (
      SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts
      QUALIFY entry < {ENTRIES}),{"".join(steps)}
    books AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256
      FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM c{ROUNDS})),
    coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (vec_id), books"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": _sql()}
