"""Set-similarity join: pairs of word sets of two sides whose Jaccard similarity reaches a share.

All words stand in one order, rarest first (how many sets of both sides have a word, then the word).
Sets of n and m words that reach the share s have ceil(s / (1 + s) * (n + m)) words in common, so their
prefixes of n - ceil(s * n) + 1 and m - ceil(s * m) + 1 words share one; only these are joined, by
equality. A pair must also fit in length (s * n <= m <= n / s), and from the first word they share what
is left of both sides must be long enough. Pairs are taken once and compared whole. Words of a prefix
are rare unless a set has no others; AQE splits the key of one that isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _up(x: Column) -> Column:
    """Ceiling, with room for what floating point adds to a whole number."""
    return F.ceil(x - 1e-9).cast("int")


def _ordered(sets: DataFrame, often: DataFrame, share: float, block: list[str]) -> DataFrame:
    """``id, n, place, word`` of the prefix of each set."""
    words = sets.select("id", *block, F.xxhash64("words").alias("_set"), F.explode("words").alias("word")).join(often, "word")
    # a set's words meet again in one row: as large as the set itself was
    rows = words.groupBy("id", *block, "_set").agg(F.array_sort(F.collect_set(F.struct("often", "word"))).alias("w")).withColumn("n", F.size("w"))
    prefix = F.slice("w", F.lit(1), F.col("n") - _up(F.col("n") * share) + 1)
    return rows.select("id", *block, "n", F.posexplode(prefix).alias("place", "w")).select("id", *block, "n", "place", "w.word")


def candidates(left: DataFrame, right: DataFrame, share: float, block: list[str]) -> DataFrame:
    """``id, other`` of the pairs whose prefixes meet and whose lengths and places allow the share, each once."""
    both = left.select("words").unionAll(right.select("words"))
    often = both.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("often"))
    a = _ordered(left, often, share, block)
    b = _ordered(right, often, share, block).withColumnsRenamed({"id": "other", "n": "m", "place": "at"})
    least = _up((F.col("n") + F.col("m")) * (share / (1 + share)))
    fits = (F.col("m") >= F.col("n") * share - 1e-9) & (F.col("n") >= F.col("m") * share - 1e-9) & (F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) >= least)
    return a.join(b, ["word", *block]).where(fits).select("id", "other").distinct()


def similar(left: DataFrame, right: DataFrame, share: float = 0.5, block: tuple[str, ...] = ()) -> DataFrame:
    """``id, other, shared, similarity`` of ``id, words`` on both sides, within equal ``block`` columns.

    Words repeated in a set and null words count once and not at all; empty and null sets are like
    nothing; of rows that repeat an id, all are compared and a pair comes once, with its most shared
    words. Null ids and blocks take no part. Other columns are ignored.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    words = F.array_distinct(F.filter("words", lambda w: w.isNotNull()))
    clean = lambda df: df.select("id", *block, words.alias("words")).where(F.size("words") > 0).dropna(subset=["id", *block])
    left, right = clean(left), clean(right)
    pairs = candidates(left, right, share, list(block))
    rows = pairs.join(left.select("id", *(F.col(b).alias(f"l_{b}") for b in block), F.col("words").alias("lw")), "id")
    rows = rows.join(right.select(F.col("id").alias("other"), *(F.col(b).alias(f"r_{b}") for b in block), F.col("words").alias("rw")), "other")
    for b in block:
        rows = rows.where(F.col(f"l_{b}") == F.col(f"r_{b}"))
    shared = F.size(F.array_intersect("lw", "rw"))
    rows = rows.select("id", "other", shared.alias("shared"), (F.size("lw") + F.size("rw") - shared).alias("all")).where(F.col("shared") >= F.col("all") * share - 1e-9)
    best = rows.groupBy("id", "other").agg(F.max_by(F.struct("shared", "all"), F.struct(F.col("shared") / F.col("all"), "shared")).alias("b"))
    return best.select("id", "other", F.col("b.shared").alias("shared"), (F.col("b.shared") / F.col("b.all")).alias("similarity"))
