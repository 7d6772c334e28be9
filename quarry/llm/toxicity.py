"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values.

Tokens are lower-cased runs of letters. A token has features, the word and its prefixes of
``PREFIXES`` bytes (languages that build words from stems), each hashed into ``BUCKETS`` buckets,
so the model has a fixed size whatever the corpus holds. A feature counts once a document. Its
weight is the log-odds of toxic against clean training documents with an informative Dirichlet
prior: its share of both classes, ``PRIOR`` times the toxic class's size in pseudo-counts. Only
weights that stand out by ``STANDS_OUT`` standard deviations are kept, and a token takes the
weight of the feature that stands out most; every other token scores ``-DRIFT``, so that
stretches of plain text end a segment. Ruzzo and Tompa's linear scan finds all maximal segments of a text. The best segment's
chance under plain text of that length is 1 - exp(-K n exp(-lambda s)): lambda solves
E[exp(lambda s)] = 1 over clean tokens, K is fitted to clean documents' maxima. A logistic curve
over that significance gives the score, fitted with ``COST`` clean texts for a missed toxic one.

The labels are learned from a bounded sample (``sample`` documents of least hash); its ids and the
weights are all that is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buffers, held_out, least_hashed, record, saved, sliced, table

BUCKETS = 1 << 20
PRIOR, STANDS_OUT, DRIFT, TOP = 0.5, 3.5, 0.1, 8.0
PREFIXES = (4, 5, 6, 7, 8, 10)
#: What a missed toxic text costs in clean texts when the curve is fitted.
COST = 3.0
#: Segments whose chance is at most this are passages.
PASSAGE = 1e-2
#: log10 of the chance from which a segment counts towards its text.
NOTABLE = -0.5
LETTERS = set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
GAPS = bytes(b for b in range(256) if b not in LETTERS)
SEED = 11


def _buckets(words: np.ndarray) -> np.ndarray:
    """Buckets of each token's features; 0 marks a prefix that the word doesn't have."""
    return ((words & np.uint64(BUCKETS - 1)) | (words > 0).astype(np.uint64)).astype(np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a bucket."""
    schema = pa.schema([("toxic", pa.int32()), ("bucket", pa.int32()), ("docs", pa.int64())])
    words = Words(GAPS, SEED, PREFIXES)
    for batch in sliced(batches):
        toxic = batch.column("toxic").to_numpy()
        for at, texts in words.texts(*buffers(batch.column("text"))):
            for label in (0, 1):
                mine = [np.unique(_buckets(w)) for t, w in zip(toxic[at : at + len(texts)], texts) if t == label]
                if mine:
                    b, n = np.unique(np.concatenate(mine), return_counts=True)
                    yield record(schema, np.full(int((b > 0).sum()), label, np.int32), b[b > 0], n[b > 0])


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` by Ruzzo and Tompa's scan, in linear time.

    Runs of tokens of no note are summed first, so the scan takes time in the tokens that score.
    Each segment keeps a link to the last one before it whose left sum is smaller: those between
    can't be smaller than a new left sum either, so the search for one follows the links.
    """
    high = np.flatnonzero(score > 0)
    if not high.size:
        return []
    before = np.concatenate([[0.0], np.cumsum(score)])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, left sum, right sum, link
    for i, left, right in zip(high.tolist(), before[high].tolist(), before[high + 1].tolist()):
        start = i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
        found.append((start, i + 1, left, right, j))
    return [(s, e, r - x) for s, e, x, r, _ in found]


class Model:
    """Weights of the buckets that stand out, the calibration, and the curve."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, notable: np.ndarray, rate: float = 1.0, k: float = 1.0, curve: tuple[float, float] = (-4.0, 1.0)):
        self.buckets, self.weights, self.notable = buckets.astype(np.int32), weights.astype(np.float32), notable.astype(np.float32)
        self.rate, self.k, self.curve = rate, k, curve

    def scorer(self):
        """A function from a text's token features to its tokens' scores."""
        weight, notable = np.full(BUCKETS, -DRIFT, np.float32), np.zeros(BUCKETS, np.float32)
        weight[self.buckets], notable[self.buckets] = self.weights, self.notable

        def score(words: np.ndarray) -> np.ndarray:
            if not len(words):
                return np.zeros(0)
            b = _buckets(words)
            top = notable[b].argmax(axis=1)
            return weight[b[np.arange(len(b)), top]].astype(float)

        return score

    def log_chance(self, s: float, n: int) -> float:
        """log10 of the chance that plain text of n tokens holds a segment of score s or more."""
        x = math.log(self.k * max(n, 1)) - self.rate * s
        return (x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 50.0))) or 1e-300)) / math.log(10)

    def significance(self, scores: list[float], n: int) -> float:
        """The negative log10 chances of all notable segments of a text together, 40 at most."""
        return min(40.0, -sum(c for c in (self.log_chance(s, n) for s in scores) if c <= NOTABLE))

    def score(self, significance: float) -> float:
        z = self.curve[0] + self.curve[1] * significance
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _maxima(model: Model):
    schema = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("best", pa.float64()), ("scores", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, score_of = Words(GAPS, SEED, PREFIXES), model.scorer()
        for batch in sliced(batches):
            toxic = batch.column("toxic").to_numpy()
            for at, texts in words.texts(*buffers(batch.column("text"))):
                found = [[x for _, _, x in segments(score_of(w))] for w in texts]
                best = [max(x, default=0.0) for x in found]
                yield record(schema, toxic[at : at + len(texts)], [len(w) for w in texts], best, found)

    return run


def _spread(model: Model):
    """How many tokens take each score, in steps of 1/16."""
    schema = pa.schema([("score", pa.float64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, score_of = Words(GAPS, SEED, PREFIXES), model.scorer()
        for batch in sliced(batches):
            for _, texts in words.texts(*buffers(batch.column("text"))):
                s = np.concatenate([score_of(w) for w in texts])
                x, n = np.unique(np.where(s > 0, np.round(s * 16) / 16, -DRIFT), return_counts=True)
                yield record(schema, x, n)

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    """Learn from at most ``sample`` labelled documents outside the held-out fifth, of least hash."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = least_hashed(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), sample, "doc_id")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    train = saved(texts.join(F.broadcast(known), "doc_id").select("toxic", "text"), "train")

    counts = train.mapInArrow(_counts, "toxic int, bucket int, docs bigint").groupBy("bucket").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == t, F.col("docs"))), F.lit(0)).alias(f"d{t}") for t in (0, 1)])
    counts = saved(counts, "counts")
    n0, n1 = (float(x or 0) for x in counts.agg(F.sum("d0"), F.sum("d1")).first())
    nothing = Model(np.zeros(0), np.zeros(0), np.zeros(0))
    if not n0 or not n1:
        return nothing
    all_ = PRIOR * n1
    prior = (F.col("d0") + F.col("d1")) * (all_ / (n0 + n1))
    a1, a0 = F.col("d1") + prior, F.col("d0") + prior
    odds = F.log(a1 / (n1 + all_ - a1)) - F.log(a0 / (n0 + all_ - a0))
    stands = counts.withColumns({"odds": odds, "z": F.abs(odds) / F.sqrt(1 / a1 + 1 / a0)}).where((F.col("z") >= STANDS_OUT) & (F.col("odds") > 0))
    # no more rows than the model has buckets
    rows = stands.select("bucket", "odds", "z").collect()
    if not rows:
        return nothing
    b, w, z = (np.array(x, float) for x in zip(*rows))
    model = Model(b, np.minimum(w, TOP) - DRIFT, z)

    # how often clean tokens take each score
    tokens = train.where("toxic = 0").mapInArrow(_spread(model), "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n")).collect()
    at, n = (np.array(x, float) for x in zip(*tokens)) if tokens else (np.array([-DRIFT]), np.ones(1))
    p = n / n.sum()
    mean = lambda r: (p * np.exp(r * at)).sum() - 1
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    model.rate = max(low, 0.02)
    seen = train.mapInArrow(_maxima(model), "toxic int, n bigint, best double, scores array<double>").toPandas()
    clean = seen[(seen.toxic == 0) & (seen.n > 0)]
    model.k = float(np.clip((len(clean) + 1) / ((clean.n * np.exp(-model.rate * clean.best)).sum() + 1), 1e-9, 1e9))
    x = np.array([model.significance(s, n) for s, n in zip(seen.scores, seen.n)])
    model.curve = _logistic(x, seen.toxic.to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope (not negative) by Newton's steps; a toxic text weighs ``COST``."""
    a, b, weigh = 0.0, 0.0, np.where(y > 0, COST, 1.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        v = weigh * p * (1 - p) + 1e-9
        e = weigh * (y - p)
        g = np.array([e.sum() - ridge * a, (e * x).sum() - ridge * b])
        h = np.array([[v.sum() + ridge, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + ridge]])
        da, db = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), max(0.0, float(b))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted, significance, passages`` of every whole text.

    A passage is ``(first_token, end_token, score, log10_chance)``. Null, empty and letterless
    texts have no token and take the score of no finding; repeated rows are scored alike.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("significance", pa.float64()), ("passages", pa.list_(pa.struct([("first_token", pa.int64()), ("end_token", pa.int64()), ("score", pa.float64()), ("log10_chance", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, score_of = Words(GAPS, SEED, PREFIXES), model.scorer()
        for batch in sliced(batches):
            for at, texts in words.texts(*buffers(batch.column("text"))):
                score, sig, spans = [], [], []
                for w in texts:
                    found = [(s, e, x, model.log_chance(x, len(w))) for s, e, x in segments(score_of(w))]
                    best = model.significance([f[2] for f in found], len(w))
                    sig.append(best)
                    score.append(model.score(best))
                    spans.append([dict(zip(("first_token", "end_token", "score", "log10_chance"), f)) for f in found if f[3] <= math.log10(PASSAGE)])
                yield record(schema, batch.column("doc_id").slice(at, len(texts)), score, [int(s >= 0.5) for s in score], sig, spans)

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, score double, predicted int, significance double, passages array<struct<first_token bigint, end_token bigint, score double, log10_chance double>>")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic, in their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, score_of = Words(GAPS, SEED, PREFIXES), model.scorer()
        for batch in sliced(batches):
            mask = []
            for _, texts in words.texts(*buffers(batch.column("text"))):
                for w in texts:
                    found = [x for _, _, x in segments(score_of(w))]
                    mask.append(model.score(model.significance(found, len(w))) < 0.5)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "significance", F.size("passages").alias("n_passages"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
