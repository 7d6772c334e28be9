"""Hard negatives by blocked dense products: blocks of anchors are broadcast against all rows.

Anchors go in rounds of at most ``ANCHORS`` rows (and ``ROUND_BYTES``), so what is broadcast and what
the driver holds have a bound, and the number of rounds follows the data. A round passes over the
rows twice. The first pass keeps each anchor's best rows of its own label in each task; these merge by
anchor into its positives. The second has the positives' scores as windows and keeps each window's
best rows of other labels, which merge in the same way. Each task multiplies blocks of rows with the
anchors in float64 (exact, as every product stays below 2**53; int64 where it may not) and compares
scores with the worst one that is still held, so few of them leave numpy. No label or vector is a
group: a label with a third of all rows costs what the others cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, record, table
from .vectors import blocks, finite, integers, longest

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
ANCHORS, ROUND_BYTES = 8192, 32 << 20
#: Rows of the first and of later blocks: the first ones fill what a task holds, before much is compared.
FIRST, BLOCK, ANCHOR_BLOCK = 64, 2048, 1024
FOUND = "slot int, score bigint, vec_id bigint"
_LEAST = np.iinfo(np.int64).min


class Best:
    """For each of n slots the ``k`` best (score, id): higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.kept = [np.zeros(0, np.int64)] * 3
        self.new: list[list[np.ndarray]] = []
        self.size = 0
        #: Score and id of a slot's last kept row, once it is full.
        self.worst, self.last = np.full(n, _LEAST), np.full(n, np.iinfo(np.int64).max)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score > self.worst[slot]) | (ids < self.last[slot])
        if better.any():
            self.new.append([x[better] for x in (slot, score, ids)])
            self.size += len(self.new[-1][0])
        if self.size > len(self.kept[0]) + BLOCK:
            self.merge()

    def merge(self) -> list[np.ndarray]:
        slot, score, ids = (np.concatenate(x) for x in zip(self.kept, *self.new))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])[: slot.size]
        rank = np.arange(slot.size) - np.repeat(starts, np.diff(np.r_[starts, slot.size]))
        full = rank == self.k - 1
        self.worst[slot[full]], self.last[slot[full]] = score[full], ids[full]
        self.kept, self.new, self.size = [x[rank < self.k] for x in (slot, score, ids)], [], 0
        return self.kept


def cap(dims: int) -> int:
    """The greatest component: products of vectors of such components still fit in int64."""
    return int(((1 << 62) // max(1, dims)) ** 0.5)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: as float64 where each sum stays below 2**53, else as int64."""
    top = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * anchors.shape[1]
    return anchors.astype(np.float64) @ rows.T.astype(np.float64) if top < 1 << 53 else anchors @ rows.T


def percent(share: int, score: np.ndarray) -> np.ndarray:
    """The floor of so many hundredths of each score, without leaving int64."""
    whole, rest = np.divmod(score, 100)
    return share * whole + share * rest // 100


class _Anchors:
    """A block of anchors and what a pass holds for them."""

    def __init__(self, ids, labels, vectors, k):
        self.ids, self.labels, self.vectors = ids, labels[:, None], vectors
        self.best = Best(len(ids), k)

    def see(self, ids: np.ndarray, labels: np.ndarray, block: np.ndarray) -> None:
        """Rows of an anchor's own label."""
        score = products(self.vectors, block)
        a, c = np.nonzero((score >= self.best.worst[:, None]) & (self.labels == labels))
        other = self.ids[a] != ids[c]
        a, c = a[other], c[other]
        self.best.add(a, score[a, c].astype(np.int64), ids[c])


class _Windows(_Anchors):
    """A block of anchors with windows of scores; ``owner`` (ascending): the anchor of each window."""

    def __init__(self, ids, labels, vectors, k, owner, floor, ceiling):
        super().__init__(ids, labels, vectors, k)
        self.owner, self.floor, self.ceiling = owner, floor, ceiling
        self.first = np.searchsorted(owner, np.arange(len(ids) + 1))
        self.most = np.full(len(ids), _LEAST)
        np.maximum.at(self.most, owner, ceiling)
        self.best = Best(len(owner), k)

    def see(self, ids: np.ndarray, labels: np.ndarray, block: np.ndarray) -> None:
        """Rows of other labels within the widest range of an anchor's windows, then within each of them."""
        score = products(self.vectors, block)
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.owner, np.maximum(self.floor, self.best.worst))
        a, c = np.nonzero((score >= least[:, None]) & (score <= self.most[:, None]) & (self.labels != labels))
        n = self.first[a + 1] - self.first[a]
        window = np.repeat(self.first[a] - np.cumsum(n) + n, n) + np.arange(n.sum())
        value, ids = np.repeat(score[a, c].astype(np.int64), n), np.repeat(ids[c], n)
        fits = (value >= self.floor[window]) & (value <= self.ceiling[window]) & (value >= self.best.worst[window])
        self.best.add(window[fits], value[fits], ids[fits])


def _found(sent, k: int, dims: int):
    """A task's pass over its rows; ``sent``: a broadcast of ids, labels and vectors, and of the windows if there are any."""
    schema = pa.schema([("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, *windows = sent.value
        held, offsets = [], []
        for i in range(0, len(ids), ANCHOR_BLOCK):
            part = [x[i : i + ANCHOR_BLOCK] for x in (ids, labels, vectors)]
            if windows:
                owner = windows[0]
                mine = slice(*np.searchsorted(owner, [i, i + ANCHOR_BLOCK]))
                held.append(_Windows(*part, k, owner[mine] - i, *(w[mine] for w in windows[1:])))
                offsets.append(mine.start)
            else:
                held.append(_Anchors(*part, k))
                offsets.append(i)
        for batch in blocks(batches, FIRST, BLOCK):
            block = integers(batch.column("embedding"), dims, SCALE, cap(dims))
            row_ids, row_labels = (np.asarray(batch.column(c)) for c in ("vec_id", "label"))
            for anchors in held:
                anchors.see(row_ids, row_labels, block)
        for at, anchors in zip(offsets, held):
            slot, score, found = anchors.best.merge()
            yield record(schema, slot + at, score, found)

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best of what tasks found for each slot: at most k rows a task meet."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rounds(anchors: DataFrame, most: int) -> Iterator[list[str]]:
    """The anchors' files in groups of at most ``most`` rows; none of the files has more."""
    files, held = [], 0
    for file, n in sorted(tuple(r) for r in anchors.groupBy(F.input_file_name()).count().collect()):
        if held + n > most:
            yield files
            files, held = [], 0
        files.append(file)
        held += n
    if files:
        yield files


def mined(rows: DataFrame, is_anchor: Column, k_positives: int = POSITIVES, k_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchors_a_round: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows``: vec_id, embedding, label; others are ignored. Rows with a null id or label, a null
    vector or one with a null or non-finite component take no part. Shorter vectors count as filled
    up with zeros; components beyond the range in which a product fits a long count as its end. Ties
    go by id. Rows that repeat an id each count, but are no positives of each other; an anchor that
    comes twice gives its rows twice. An anchor without positives, and a positive without
    negatives in its window (as with a score below 0), give no row; an empty table gives none.
    """
    spark = rows.sparkSession
    label = F.col("label").cast("bigint")
    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), is_anchor.alias("is_anchor"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    dims = longest(kept, "embedding")
    most = max(1, min(anchors_a_round, ROUND_BYTES // (8 * max(1, dims))))
    scratch = Scratch(spark)
    path = f"{scratch.top}/anchors"
    chosen = kept.where("is_anchor").drop("is_anchor")
    chosen.write.option("maxRecordsPerFile", most).parquet(path)
    kept = kept.drop("is_anchor")
    results = []
    for k, files in enumerate(_rounds(spark.read.schema(chosen.schema).parquet(path), most)):
        block = spark.read.schema(chosen.schema).parquet(*files).orderBy("vec_id").toArrow().combine_chunks()
        ids, labels = (block.column(c).to_numpy() for c in ("vec_id", "label"))
        vectors = integers(block.column("embedding").combine_chunks(), dims, SCALE, cap(dims))
        sent = spark.sparkContext.broadcast((ids, labels, vectors))
        best = _merged(kept.mapInArrow(_found(sent, k_positives, dims), FOUND), k_positives)
        best = best.orderBy("slot", "rank").toArrow()  # at most k_positives rows an anchor of the round
        sent.unpersist()
        owner, score, positive = (best.column(c).to_numpy().astype(np.int64) for c in ("slot", "score", "vec_id"))
        sent = spark.sparkContext.broadcast((ids, labels, vectors, owner, -percent(low, -score), percent(high, score)))
        negatives = _merged(kept.mapInArrow(_found(sent, k_negatives, dims), FOUND), k_negatives)
        pairs = pa.table({"slot": pa.array(np.arange(owner.size), pa.int32()), "anchor_id": ids[owner], "positive_id": positive, "positive_score": score})
        pairs = spark.createDataFrame(pairs)
        out = negatives.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(F.broadcast(pairs), "slot").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        scratch.save(out, f"round-{k}")
        results.append(f"{scratch.top}/round-{k}")
        sent.unpersist()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.read.schema(schema).parquet(*results) if results else spark.createDataFrame([], schema)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {
    "op11_hard_negatives": """
    WITH kept AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
      FROM kept a JOIN kept c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
      AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
    QUALIFY rank <= 10"""
}
