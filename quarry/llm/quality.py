"""Quality rules whose thresholds come from the data, per language and source. Native throughout.

Every text gets counts in one row-wise pass (no explode, so no shuffle of words). Three shares are
then judged: symbols per word character, words that repeat the word before them, and lines that
repeat an earlier line. A share falls into a bin of a logarithmic scale (``GROWTH`` from edge to
edge; no share at all has a bin of its own), so the bin counts of a group are a quantile sketch of
fixed relative error, near 0 as elsewhere, and merge by addition: from task to (language, source),
to language, to the whole corpus. A group's quartiles come from its own sketch and ``PRIOR``
documents' worth of its language's and the corpus's sketches, half each, so a small group leans on
them and a large one doesn't, without a switch at any size. The limit is the third quartile and
``FENCE`` times the interquartile range, at least that of ``SHARES`` (where all quartiles are 0, a
single symbol or line shouldn't be fenced). A share is too high when its count passes the limit by
``SLACK`` standard errors, so a repeated line of three lines isn't taken for a habit. The limits are
a table of one row per group, joined to the documents; a hot source costs no task more, because
counts are combined before the shuffle and the join is on the small side's keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

GROWTH, FENCE, SLACK, PRIOR = 1.05, 3, 2.0, 50
#: The bin of shares of 0.
NONE = -10_000
#: The least interquartile range of each share, and the counts that it is made of.
SHARES = {"symbol_share": 0.002, "echo_share": 0.002, "line_share": 0.02}
PARTS = {"symbol_share": ("n_symbols", "word_chars"), "echo_share": ("n_echo_words", "n_words"), "line_share": ("n_dup_lines", "n_lines")}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_echo_words", "n_repeat_words")
GAP, GAPS = r"[\x20\x09-\x0D]", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, f) -> Column:
    """``f(value)`` with value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)


def pairwise(a: Column, f, gap: int = 1) -> Column:
    """f of every two elements ``gap`` apart; empty for shorter arrays."""
    n = F.greatest(F.size(a) - gap, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + gap), n), f)


def _covered(windows: Column) -> Column:
    """Words in windows (their hashes in text order) that are found twice or more."""
    placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    same = let(placed, lambda s: F.array_sort(F.array_distinct(F.flatten(F.filter(pairwise(s, lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"]))), lambda p: p.isNotNull())))))
    return let(same, lambda p: total(pairwise(p, lambda a, b: F.least(b - a, F.lit(8)).cast("bigint"))) + 8)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of a text. Null and wordless texts have zeros."""
    text = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(text, F.lit(GAPS))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda marks: F.length(F.translate(text, marks, ""))
    docs = docs.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{GAP}+"))).withColumn("_lines", lines)
    docs = docs.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    docs = docs.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": without(GAPS).cast("bigint"),
            "n_symbols": (F.length(text) - without(SYMBOLS)).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_echo_words": total(pairwise(F.col("_hash"), lambda a, b: (a == b).cast("bigint"))),
            "_windows": pairwise(pairwise(pairwise(F.col("_hash"), lambda a, b: F.xxhash64(a, b)), lambda a, b: F.xxhash64(a, b), 2), lambda a, b: F.xxhash64(a, b), 4),
        }
    )
    repeated = F.when(F.size("_windows") == F.size(F.array_distinct("_windows")), F.lit(0).cast("bigint")).otherwise(_covered(F.col("_windows")))
    return docs.withColumn("n_repeat_words", repeated).drop("_words", "_lines", "_hash", "_windows")


def with_shares(docs: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return docs.withColumns({s: F.least(share(*PARTS[s]), F.lit(1.0)) for s in SHARES})


def _bin(share: str) -> Column:
    return F.when(F.col(share) > 0, F.ceil(F.log(F.col(share)) / F.lit(math.log(GROWTH)))).otherwise(NONE).cast("int")


def sketches(docs: DataFrame) -> DataFrame:
    """``(lang, source, share, bin, n)``: the mergeable sketch of every share of every group."""
    bins = docs.groupBy("lang", "source", *[_bin(s).alias(s) for s in SHARES]).agg(F.count("*").alias("n"))
    return bins.select("lang", "source", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(s).alias("bin")) for s in SHARES])).alias("s")).groupBy("lang", "source", "s.share", "s.bin").agg(F.sum("n").alias("n"))


def _merged(sketch: DataFrame, worth: int | None, *keys: str) -> DataFrame:
    """One row per group of ``keys`` and share, with its bins weighed in thousandths of a document.

    Where ``worth`` is given, all the bins together weigh about as much as so many documents.
    """
    merged = sketch.groupBy(*keys, "share", "bin").agg(F.sum("n").alias("n"))
    whole = merged.groupBy(*keys, "share").agg(F.sum("n").alias("total"), F.collect_list(F.struct("bin", "n")).alias("bins"))
    # whole numbers, so that sums don't hang on their order
    weight = lambda b: b["n"] * 1000 if worth is None else F.call_function("div", b["n"] * (1000 * worth), F.col("total"))
    return whole.withColumn("bins", F.transform("bins", lambda b: F.struct(b["bin"].alias("bin"), weight(b).alias("w"))))


def thresholds(docs: DataFrame) -> DataFrame:
    """One row per (lang, source) with its documents and the limit of each share."""
    sketch = sketches(docs)
    own = _merged(sketch, None, "lang", "source")
    lang = _merged(sketch, PRIOR // 2, "lang").select(F.col("lang").alias("_lang"), F.col("share").alias("_share"), F.col("bins").alias("_bins"))
    # a row for each share
    all_ = _merged(sketch, PRIOR // 2).select("share", F.col("bins").alias("_all"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("share") == F.col("_share"))).join(F.broadcast(all_), "share")
    joined = joined.withColumn("bins", F.array_sort(F.concat("bins", "_bins", "_all"))).withColumn("weight", F.aggregate("bins", F.lit(0).cast("bigint"), lambda x, b: x + b["w"]))

    def quartile(k: int) -> Column:
        walk = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("at")),
            lambda s, b: F.struct((s["seen"] + b["w"]).alias("seen"), F.when(s["at"].isNull() & ((s["seen"] + b["w"]) * 4 >= F.col("weight") * k), b["bin"]).otherwise(s["at"]).alias("at")),
        )
        return F.when(walk["at"] == NONE, 0.0).otherwise(F.pow(F.lit(GROWTH), walk["at"].cast("double")))

    least = F.create_map(*[F.lit(x) for s, r in SHARES.items() for x in (s, r)])[F.col("share")]
    at = joined.select("lang", "source", "share", "total", quartile(1).alias("low"), quartile(3).alias("high"))
    limit = F.col("high") + FENCE * F.greatest(F.col("high") - F.col("low"), least)
    return at.groupBy("lang", "source").agg(F.max("total").alias("n_documents"), *[F.max(F.when(F.col("share") == s, limit)).alias(f"max_{s}") for s in SHARES])


def _judged(docs: DataFrame, *keep: str) -> DataFrame:
    counted = saved(with_shares(with_counts(docs)).select(*keep, "lang", "source", *COUNTS, *SHARES), "counted")
    limits = saved(thresholds(counted), "limits").select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"max_{s}" for s in SHARES])
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    within = F.lit(True)
    for s, (count, of) in PARTS.items():
        within = within & (F.col(count) <= F.col(f"max_{s}") * F.col(of) + SLACK * F.sqrt(F.col(count)))
    return joined.withColumns({"base_failed": failed, "kept": ~failed & F.coalesce(within, F.lit(True))})


def judged(docs: DataFrame) -> DataFrame:
    """Each document's counts and verdict.

    Base rules: under 20 words, or over 30 % of the words in repeated windows. Null texts have no
    words and fail; null languages and sources are groups of their own. Ties and repeated rows are
    judged alike. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select("doc_id", "lang", "source", F.col("text").cast("string").alias("text"))
    return _judged(docs, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def passing(docs: DataFrame) -> DataFrame:
    """The documents that are kept, row by row, in their own columns.

    They are written once with their counts; only the limits are joined, so no text is shuffled.
    """
    named = docs.select(F.struct("*").alias("_row"), "lang", "source", F.col("text").cast("string").alias("text"))
    return _judged(named, "_row").where("kept").select("_row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


#: The same in DuckDB: words are unnested, windows are compared as strings.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
k AS (
  SELECT r, i, array_to_string(words[i:i+7], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM k) WHERE n > 1),
cover AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r),
c AS (
  SELECT w.r, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i-1]))::BIGINT AS n_echo
  FROM w LEFT JOIN cover ON w.r = cover.r),
s AS (
  SELECT *, least(coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0.0), 1.0) AS symbol_share,
    coalesce(n_echo::DOUBLE / nullif(n_words, 0), 0.0) AS echo_share, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0.0) AS line_share FROM c),
long AS (
  SELECT lang, source, 'symbol_share' AS share, symbol_share AS x FROM s UNION ALL
  SELECT lang, source, 'echo_share', echo_share FROM s UNION ALL
  SELECT lang, source, 'line_share', line_share FROM s),
o AS (SELECT lang, source, share, CASE WHEN x > 0 THEN ceil(ln(x) / {math.log(GROWTH)!r})::INT ELSE {NONE} END AS bin, count(*) AS n FROM long GROUP BY ALL),
l AS (SELECT lang, share, bin, sum(n)::BIGINT AS n, (sum(sum(n)) OVER (PARTITION BY lang, share))::BIGINT AS total FROM o GROUP BY lang, share, bin),
a AS (SELECT share, bin, sum(n)::BIGINT AS n, (sum(sum(n)) OVER (PARTITION BY share))::BIGINT AS total FROM o GROUP BY share, bin),
g AS (SELECT DISTINCT lang, source, share FROM o),
u AS (
  SELECT lang, source, share, bin, n * 1000 AS w FROM o UNION ALL
  SELECT g.lang, g.source, g.share, l.bin, (l.n * {500 * PRIOR}) // l.total FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.share = l.share UNION ALL
  SELECT g.lang, g.source, g.share, a.bin, (a.n * {500 * PRIOR}) // a.total FROM g JOIN a ON g.share = a.share),
h AS (SELECT lang, source, share, bin, sum(sum(w)) OVER (PARTITION BY lang, source, share ORDER BY bin) AS seen, sum(sum(w)) OVER (PARTITION BY lang, source, share) AS weight FROM u GROUP BY lang, source, share, bin),
q AS (SELECT lang, source, share, min(bin) FILTER (4 * seen >= weight) AS b1, min(bin) FILTER (4 * seen >= 3 * weight) AS b3 FROM h GROUP BY lang, source, share),
v AS (SELECT lang, source, share, CASE WHEN b1 = {NONE} THEN 0 ELSE pow({GROWTH}::DOUBLE, b1) END AS lo, CASE WHEN b3 = {NONE} THEN 0 ELSE pow({GROWTH}::DOUBLE, b3) END AS hi,
  CASE share {" ".join(f"WHEN '{k}' THEN {v}" for k, v in SHARES.items())} END::DOUBLE AS least FROM q),
t AS (SELECT *, hi + {FENCE} * greatest(hi - lo, least) AS lim FROM v),
p AS (
  SELECT lang, source, max(lim) FILTER (share = 'symbol_share') AS a, max(lim) FILTER (share = 'echo_share') AS b, max(lim) FILTER (share = 'line_share') AS c FROM t GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_symbols <= p.a * word_chars + {SLACK} * sqrt(n_symbols)
    AND n_echo <= p.b * n_words + {SLACK} * sqrt(n_echo) AND n_dup_lines <= p.c * n_lines + {SLACK} * sqrt(n_dup_lines)) AS kept
FROM s JOIN p ON s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source
"""

QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES = {"op4_quality_rules": ORACLE}
