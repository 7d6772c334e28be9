"""Language identification: the family first, then one-versus-one linear SVMs within it.

A text's features are the square roots of its byte trigram shares, folded to lower case, with
everything but letters as one gap, hashed into ``SIZE`` buckets and scaled to length 1. Families
come from a fixed list of languages; a learned language that isn't in the list is a family of its
own. A linear SVM per family against the rest picks the family; within it, one linear SVM for each
pair of languages votes, and the margins break ties.

The SVMs learn from every language with labelled documents outside the held-out fifth: from at most
``per_language`` of each (those of least hash), fewer where that would pass ``most`` rows, but one
at least. That sample is all that reaches the driver. Prediction is a map over the documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLOCK, buffers, held_out, record, saved, sliced, table

SIZE = 4096
#: Families of common languages.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-iranian": ("hi", "bn", "ur", "fa", "pa", "mr", "gu"),
    "semitic": ("ar", "he", "am", "mt"),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_FOLD = np.full(256, 1, np.uint32)
_FOLD[97:123] = np.arange(2, 28)
_FOLD[65:91] = np.arange(2, 28)
_FOLD[128:256] = np.arange(28, 156)


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams of some bytes that hold a letter."""
    c = np.concatenate([np.ones(1, np.uint32), _FOLD[data], np.ones(1, np.uint32)])
    h = (c[:-2] * np.uint32(160) + c[1:-1]) * np.uint32(160) + c[2:]
    some = (c[1:-1] > 1) | ((c[:-2] > 1) & (c[2:] > 1))
    return ((h[some] * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of features for each text; zeros if it has no letter."""
    out = np.zeros((len(bounds) - 1, SIZE), np.float32)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        for k in range(a, b, BLOCK):  # memory follows the block
            out[i] += np.bincount(_trigrams(data[k : min(b, k + BLOCK)]), minlength=SIZE)
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, c: float = 1.0) -> np.ndarray:
    """Weights (the bias last) of a linear SVM with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # both classes weigh alike
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    norm = (x * x).sum(axis=1) + 1 / (2 * cost)
    order = np.random.default_rng(9)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * cost[i])
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w.astype(np.float32)


class Model:
    """The SVMs of the families and of the pairs of languages in each."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.members: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.members.setdefault(FAMILY.get(lang, lang), []).append(lang)
        self.families = sorted(self.members)
        lang = np.array(langs)
        family = np.array([FAMILY.get(c, c) for c in langs])
        self.of_family = np.array([_svm(x, np.where(family == f, 1, -1)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for f in self.families:
            for a, b in itertools.combinations(self.members[f], 2):
                mine = (lang == a) | (lang == b)
                self.pairs[a, b] = _svm(x[mine], np.where(lang[mine] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and the confidence of each row."""
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -10, 10)))
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if self.of_family is None:
            pick, score = np.zeros(len(x), int), np.ones(len(x))
        else:
            m = x @ self.of_family.T
            pick = m.argmax(axis=1)
            ranked = np.sort(m, axis=1)
            score = sure((ranked[:, -1] - ranked[:, -2]) / 2)
        out = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows, langs = np.flatnonzero(pick == k), self.members[f]
            if not rows.size:
                continue
            if len(langs) == 1:
                out[rows] = langs[0]
                continue
            votes, least = np.zeros((len(rows), len(langs))), np.full((len(rows), len(langs)), np.inf)
            for (a, b), (i, j) in zip(itertools.combinations(langs, 2), itertools.combinations(range(len(langs)), 2)):
                m = x[rows] @ self.pairs[a, b]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                least[:, i] = np.minimum(least[:, i], m)
                least[:, j] = np.minimum(least[:, j], -m)
            best = (votes + np.tanh(least) / 4).argmax(axis=1)
            out[rows] = np.array(langs, object)[best]
            score[rows] *= sure(least[np.arange(len(rows)), best])
        return out.tolist(), score


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("x", pa.binary())])
    for batch in sliced(batches, most=1 << 20):
        x = features(*buffers(batch.column("text"))).astype(np.float16)
        yield record(schema, batch.column("lang"), [r.tobytes() for r in x])


def fit(docs: DataFrame, per_language: int = 400, most: int = 8000) -> Model | None:
    """Learn every language from at most ``most`` documents (or one of each) outside the held-out fifth."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    counts = saved(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    per_language = max(1, min(per_language, most // max(1, counts.count())))
    # a share of each language that is sure to hold enough, cut to the least hashes
    share = F.broadcast(counts.select("lang", (F.lit(3.0 * per_language + 200) / F.col("n")).alias("share")))
    rank = F.xxhash64("doc_id", F.lit(1))
    some = known.join(share, "lang").where((rank.bitwiseAND(0xFFFFFF) / float(1 << 24)) < F.col("share")).select("lang", "text", "doc_id", rank.alias("rank"))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id"))).where(F.col("r") <= per_language)
    rows = saved(some.select("lang", "text").mapInArrow(_featured, "lang string, x binary"), "featured").orderBy("lang", "x").collect()
    if not rows:
        return None
    return Model(np.array([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32), [r.lang for r in rows])


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    Null, empty and letterless texts are ``und`` with score 0; without a model so is every text.
    Repeated rows are predicted alike. Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1 << 20):
            known = batch.column("letters").to_numpy(zero_copy_only=False)
            lang, score = (["und"] * batch.num_rows, np.zeros(batch.num_rows)) if model is None else model.predict(features(*buffers(batch.column("text"))))
            yield record(schema, batch.column("doc_id"), [p if k else "und" for p, k in zip(lang, known)], np.where(known, score, 0.0))

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return docs.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
