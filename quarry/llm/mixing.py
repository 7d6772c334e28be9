"""Mixing sources to target weights: budgets down a domain-language-source tree. Native.

Siblings share their parent's budget by weight; what a sibling can't use (it has its tokens times
``max_epochs`` at most) goes to its siblings by weight, and only what they can't use either is left
to the ancestors' other children, because a parent's own limit is the sum of its children's. Each
level is one closed-form fill: siblings in the order of limit over weight are full up to a point,
and the rest share what is left. A leaf then takes whole epochs and, of one more, the longest
prefix of its documents in a seeded order whose tokens fit.

The order is an md5 of seed, epoch and doc_id. A leaf's prefix is found from sums of 4096 hash
bins, then from 4096 bins of the one where the budget ends, so only one row in 16 million of a leaf
is ordered; the choice itself is a filter on the hash, and texts are never shuffled. A hot source is combined before the shuffle like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

LEVELS = ("domain", "lang", "source")
#: Fixed values of the registered query: target weights (others weigh 1), the share of all tokens to take, epochs, seed.
WEIGHTS = {"domain": {"d0": 3, "d1": 2, "d2": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
SHARE, EPOCHS, SEED = 0.6, 2, 13
#: Hex digits of the order key that name a bin, coarse then fine.
DIGITS = (3, 6)
GAP = r"[\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """Words of a text; none for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{GAP}|{GAP}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, GAP))).cast("bigint")


def domain(source: Column) -> Column:
    """Three made domains of sources, for tables without one."""
    return F.concat(F.lit("d"), (F.crc32(F.coalesce(source, F.lit(""))) % 3).cast("string"))


def order_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def filled(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``share`` to siblings with ``weight`` and ``most`` (their limit) under ``given`` (the parent's budget)."""
    ranked = Window.partitionBy(*parent).orderBy(F.try_divide("most", "weight").asc_nulls_last(), name)
    whole = Window.partitionBy(*parent)
    before = F.coalesce(F.sum("most").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    step = nodes.withColumn("rise", F.try_divide(F.col("given") - before, left))
    step = step.withColumn("full", (F.col("weight") > 0) & (F.col("most") <= F.col("weight") * F.col("rise")))
    step = step.withColumn("level", F.min(F.when(~F.col("full") & (F.col("weight") > 0), F.struct(F.try_divide("most", "weight").alias("o"), F.col(name).alias("k"), "rise"))).over(whole)["rise"])
    return step.withColumn("share", F.when(F.col("weight") <= 0, 0.0).when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("level"))).drop("rise", "full", "level", "given")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], share: float, epochs: int) -> DataFrame:
    """``domain, lang, source, tokens, budget`` for each leaf with ``tokens``."""
    given = None
    for depth, level in enumerate(LEVELS):
        keys, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        w = weights.get(level, {})
        weight = F.coalesce(F.create_map(*[F.lit(x) for k, v in w.items() for x in (k, float(v))])[F.col(level)], F.lit(1.0)) if w else F.lit(1.0)
        nodes = leaves.groupBy(*keys).agg((F.sum("tokens") * epochs).alias("most")).withColumn("weight", weight)
        if given is None:
            all_ = leaves.agg(F.floor(F.sum("tokens") * F.lit(share)).cast("double").alias("given"))
            nodes = nodes.crossJoin(all_).withColumn("_all", F.lit(0))
            nodes = filled(nodes, ["_all"], level).drop("_all")
        else:
            nodes = filled(_same(nodes, given.select(*parent, F.col("share").alias("given")), parent), parent, level)
        given = saved(nodes.select(*keys, "most", "share"), "budget")
    return given.select(*LEVELS, (F.col("most") / epochs).cast("bigint").alias("tokens"), F.floor(F.round("share", 6)).cast("bigint").alias("budget"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join whose null keys meet."""
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(right, on, "left").drop(*[f"_{k}" for k in keys])


def plan(sized: DataFrame, weights: dict, share: float, epochs: int, seed: int) -> DataFrame:
    """Each leaf's whole epochs, and the last key of its part epoch: ``.., whole, cut_key, cut_id``.

    ``sized`` has doc_id, the tree's columns and ``n_tokens``.
    """
    leaf = budgets(sized.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), weights, share, epochs)
    whole = F.coalesce(F.least(F.try_divide("budget", "tokens").cast("int"), F.lit(epochs)), F.lit(0))
    leaf = saved(leaf.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "leaf")
    keyed = saved(_same(sized, leaf.select(*LEVELS, "whole", "rest"), list(LEVELS)).select("doc_id", *LEVELS, "n_tokens", "rest", order_key(F.col("whole"), seed).alias("key")), "keyed")
    near, edge = keyed.withColumn("before", F.lit(0).cast("bigint")), None
    for digits in DIGITS:
        bins = near.groupBy(*LEVELS, "rest", "before", F.substring("key", 1, digits).alias("bin")).agg(F.sum("n_tokens").alias("n"))
        ahead = F.coalesce(F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        upto = bins.withColumn("before", F.col("before") + ahead)
        edge = upto.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
        edge = edge.groupBy(*LEVELS).agg(F.min_by(F.struct("bin", "before"), "bin").alias("e")).select(*LEVELS, F.col("e.bin").alias("edge"), "e.before")
        edge = saved(edge, "edge")
        near = _same(near.drop("before", "edge"), edge, list(LEVELS)).where(F.substring("key", 1, digits) == F.col("edge"))
    run = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cut = near.withColumn("run", run).where(F.col("run") <= F.col("rest")).groupBy(*LEVELS).agg(F.max(F.struct("key", "doc_id")).alias("cut"))
    out = _same(_same(leaf, edge, list(LEVELS)), cut, list(LEVELS))
    # nothing left to part: the whole epoch if no bin passes the rest, else the bins before the edge
    return saved(out.select(*LEVELS, "tokens", "budget", "whole", F.coalesce("edge", F.lit("g")).alias("edge"), F.col("cut.key").alias("cut_key")), "plan")


def mixed(docs: DataFrame, weights: dict = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The chosen rows of ``docs`` with ``domain, epoch, n_tokens``: one row per epoch of a document.

    ``docs`` needs doc_id, text, lang, source; a column ``domain`` is taken if it is there, else
    derived from the source. Null names are nodes of their own; null and wordless texts have no
    tokens and go with any prefix. Rows that repeat a doc_id in a leaf are taken or left together.
    Columns of ``docs`` named like the added ones are replaced. An empty table gives no rows.
    """
    docs = docs.drop("epoch", "n_tokens")
    if "domain" not in docs.columns:
        docs = docs.withColumn("domain", domain(F.col("source")))
    docs = docs.withColumn("n_tokens", n_tokens(F.col("text")))
    sized = saved(docs.select("doc_id", *LEVELS, "n_tokens"), "sized")
    chosen = plan(sized, weights, share, epochs, seed).select(*LEVELS, "whole", "edge", "cut_key")
    rows = _same(docs, chosen, list(LEVELS)).withColumn("key", order_key(F.col("whole"), seed))
    part = (F.col("whole") < epochs) & ((F.substring("key", 1, DIGITS[-1]) < F.col("edge")) | F.coalesce(F.col("key") <= F.col("cut_key"), F.lit(False)))
    taken = F.col("whole") + part.cast("int")
    return rows.where(taken > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), taken - 1))).drop("whole", "edge", "cut_key", "key")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def _level_sql(depth: int) -> str:
    """One level of the tree in DuckDB: the same fill over the budgets of the level above."""
    level, keys, parent = LEVELS[depth], ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth]) or "1"
    w = WEIGHTS.get(level, {})
    weight = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {float(v)}" for k, v in w.items()) + " ELSE 1.0 END" if w else "1.0"
    above = f"JOIN (SELECT {', '.join(LEVELS[:depth])}, share FROM b{depth - 1}) p USING ({', '.join(LEVELS[:depth])})" if depth else "CROSS JOIN (SELECT floor(sum(tokens) * %s)::DOUBLE AS share FROM leaves) p" % SHARE
    order = f"PARTITION BY {parent} ORDER BY most / weight, {level}"
    return f"""
n{depth} AS (SELECT {keys}, sum(tokens) * {EPOCHS} AS most, ({weight})::DOUBLE AS weight FROM leaves GROUP BY {keys}),
r{depth} AS (SELECT n.*, (p.share - coalesce(sum(most) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rise FROM n{depth} n {above}),
f{depth} AS (SELECT *, most <= weight * rise AS isfull FROM r{depth}),
b{depth} AS (SELECT {keys}, most, CASE WHEN isfull THEN most::DOUBLE ELSE weight * first_value(CASE WHEN NOT isfull THEN rise END IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS share FROM f{depth})"""


#: Needs crc32 of a source; the tables name them src0 .. src19, so the domains are listed by a macro of values.
def _oracle() -> str:
    import zlib

    names = " ".join(f"WHEN source = 'src{i}' THEN 'd{zlib.crc32(f'src{i}'.encode()) % 3}'" for i in range(20))
    key = f"md5(concat_ws(':', '{SEED}', %s::VARCHAR, doc_id::VARCHAR))"
    return rf"""
WITH d AS (
  SELECT doc_id, CASE {names} END AS domain, lang, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL),{",".join(_level_sql(k) for k in range(3))},
plan AS (SELECT domain, lang, source, tokens, floor(round(share, 6))::BIGINT AS budget, least(floor(floor(round(share, 6)) / tokens)::INT, {EPOCHS}) AS n_whole FROM b2 JOIN leaves USING (domain, lang, source)),
k AS (SELECT d.*, n_whole, budget - n_whole * tokens AS rest, {key % "n_whole"} AS key FROM d JOIN plan USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AND n_whole < {EPOCHS} AS part FROM (SELECT * FROM k)),
t AS (SELECT *, n_whole + part::INT AS taken FROM c)
SELECT doc_id, domain, lang, source, unnest(range(0, taken))::INT AS epoch, n_tokens FROM t WHERE taken > 0
"""


QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {"op8_mixing": _oracle().replace("ORDER BY key, doc_id RANGE", "ORDER BY key RANGE")}
