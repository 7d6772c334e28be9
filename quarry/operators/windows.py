"""Dedup, ordered state and set operations over keyed rows.

Keep-one-per-key is a window rank over an explicit order that ends with the primary key, so a
result never depends on the order of the input. Set algebra on snapshots stays in arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import EVENTS, LISTINGS, ORDERS_TODAY, events, listings, load, today



def with_totals(rows: DataFrame, key: str, **totals: Column) -> DataFrame:
    """Rows with sums of their group beside them, by an aggregate and a join: no task holds a whole group, AQE splits a hot key."""
    per = rows.groupBy(F.col(key).alias("_key")).agg(*(c.alias(n) for n, c in totals.items()))
    return rows.join(per, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def keep_last_by_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key by ordinal; rows with a null key all stay, and are not dealt by it."""
    last = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*df.columns), F.struct(ordinal)).alias("_row"))
    return last.select("_row.*").unionByName(df.where(F.col(key).isNull()))


def canonical_url(url: Column) -> Column:
    """Trimmed, without fragment, query and trailing slashes, https, without www., lower case."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), r"[#?].*$", ""), r"/+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(u, r"^http://", "https://"), r"^https://(www\.|m\.)", "https://"))


_CANON = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '[#?].*$', ''), '/+$', ''), '^http://', 'https://'), '^https://(www\.|m\.)', 'https://'))"


@query("w01_keep_latest", f"""
WITH {LISTINGS} SELECT id, owner, sale_date, price FROM listings QUALIFY row_number() OVER (PARTITION BY owner ORDER BY sale_date DESC NULLS LAST, price DESC NULLS LAST, id) = 1""")
def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(listings(spark, sf_dir).select("id", "owner", "sale_date", "price"), ["owner"], [F.desc_nulls_last("sale_date"), F.desc_nulls_last("price"), "id"])


@query("w02_dedup_canonical_url", f"SELECT page_id, {_CANON} AS canon FROM pages QUALIFY row_number() OVER (PARTITION BY {_CANON} ORDER BY length(html) DESC, page_id) = 1")
def dedup_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("canon"), F.length("html").alias("n"))
    return keep_first(pages, ["canon"], [F.desc("n"), "page_id"]).select("page_id", "canon")


@query("w03_latest_per_user", "SELECT user_id, max(ts) AS ts, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query("w04_keep_last_in_batch", f"""
WITH {EVENTS}, b AS (SELECT event_id, CASE WHEN k % 50 = 0 THEN NULL ELSE k END AS key FROM ev)
SELECT event_id, key FROM b QUALIFY key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY event_id DESC) = 1""")
def keep_last_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = events(spark, sf_dir).select("event_id", F.when(F.col("k") % 50 != 0, F.col("k")).alias("key"))
    return keep_last_by_key(batch, "key", "event_id")


@query("w05_richest_per_key", "SELECT doc_id, source, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1")
def richest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("d"))).alias("m"))
    return best.select((-F.col("m.d")).alias("doc_id"), "source", "lang", F.col("m.n_chars").alias("n_chars"))


@query("w06_dedup_within_house", f"""
WITH {LISTINGS} SELECT id, house, deal_type, price FROM listings QUALIFY length(prop_type) < 9 OR row_number() OVER (PARTITION BY house, owner, floor(price / 50000) ORDER BY id) = 1""")
def dedup_within_house(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each place and price step; the least id is combined in each task, so nothing is sorted."""
    rows = listings(spark, sf_dir).withColumn("step", F.floor(F.col("price") / 50000))
    first = rows.groupBy("house", "owner", "step").agg(F.min("id").alias("id")).select("id")
    short = F.length("prop_type") < 9
    return rows.where(short).unionByName(rows.where(~short).join(first, "id", "left_semi").select(rows.columns)).select("id", "house", "deal_type", "price")


@query("w07_prefer_open_soonest", f"""
WITH {LISTINGS} SELECT id, owner, sale_date, status = 'sold' AS ended, count(*) FILTER (status <> 'sold') OVER (PARTITION BY owner) > 1 AS also_in_future FROM listings
QUALIFY row_number() OVER (PARTITION BY owner ORDER BY status = 'sold', sale_date, id) = 1""")
def prefer_open_soonest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = F.col("status") == "sold"
    rows = listings(spark, sf_dir).select("id", "owner", "sale_date", ended.alias("ended")).withColumn("also_in_future", F.count_if(~F.col("ended")).over(Window.partitionBy("owner")) > 1)
    return keep_first(rows, ["owner"], ["ended", "sale_date", "id"])


_SNAPS = f"""{EVENTS}, snaps AS (SELECT user_id, ts::DATE AS day, list_sort(list(DISTINCT k)) AS ks FROM ev GROUP BY 1, 2)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's set of keys by day."""
    return events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_set("k")).alias("ks"))


@query("w08_changed_snapshots", f"""
WITH {_SNAPS}, h AS (SELECT *, sha256(array_to_string(ks, chr(10))) AS hash FROM snaps)
SELECT user_id, day, hash, CASE WHEN hash = lag(hash) OVER (PARTITION BY user_id ORDER BY day) THEN 'unchanged' ELSE 'full' END AS kind FROM h""")
def changed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = snapshots(spark, sf_dir).withColumn("hash", F.sha2(F.array_join(F.col("ks").cast("array<string>"), "\n"), 256))
    before = F.lag("hash").over(Window.partitionBy("user_id").orderBy("day"))
    return hashed.select("user_id", "day", "hash", F.when(F.col("hash") == before, "unchanged").otherwise("full").alias("kind"))


_RECALL = f"""{_SNAPS}, r AS (SELECT user_id, day, ks, lag(ks) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM snaps)"""


@query("w09_snapshot_recall", f"""
WITH {_RECALL} SELECT user_id, day, CASE WHEN prev IS NULL OR len(prev) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ks, prev))::DOUBLE / len(prev) END AS recall FROM r""")
def snapshot_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev = F.lag("ks").over(Window.partitionBy("user_id").orderBy("day"))
    rows = snapshots(spark, sf_dir).withColumn("prev", prev)
    recall = F.try_divide(F.size(F.array_intersect("ks", "prev")).cast("double"), F.nullif(F.size("prev"), F.lit(0)))
    return rows.select("user_id", "day", F.when(F.col("prev").isNull(), 1.0).otherwise(F.coalesce(recall, F.lit(1.0))).alias("recall"))


@query("w10_nearest_dates", f"WITH {LISTINGS} SELECT id, house, sale_date FROM listings QUALIFY dense_rank() OVER (PARTITION BY house ORDER BY sale_date DESC) <= 3")
def nearest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("id", "house", "sale_date")
    return rows.withColumn("r", F.dense_rank().over(Window.partitionBy("house").orderBy(F.desc("sale_date")))).where("r <= 3").drop("r")


@query("w11_rolling_five", f"""
WITH {EVENTS}, d AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'view') AS n FROM ev GROUP BY 1, 2)
SELECT user_id, day, sum(n) OVER w::BIGINT AS total, sum(n) OVER w::DOUBLE / nullif(count(nullif(n, 0)) OVER w, 0) AS mean_of_nonzero FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""".replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT").replace("sum(n) OVER w::DOUBLE", "(sum(n) OVER w)::DOUBLE").replace("nullif(count(nullif(n, 0)) OVER w, 0)", "nullif((count(nullif(n, 0)) OVER w), 0)"))
def rolling_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("n"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(-4, 0)
    some = F.count(F.nullif("n", F.lit(0))).over(w)
    return days.select("user_id", "day", F.sum("n").over(w).alias("total"), F.try_divide(F.sum("n").over(w).cast("double"), some).alias("mean_of_nonzero"))


@query("w12_fair_share", f"""
WITH {LISTINGS}, r AS (SELECT id, house, row_number() OVER (PARTITION BY house ORDER BY sale_date, id) AS turn FROM listings WHERE status = 'stc')
SELECT id, house, turn FROM r ORDER BY turn, house LIMIT 60""")
def fair_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn for each house until 60 are dealt; no house can have more, so each task keeps its first 60."""
    turn = F.row_number().over(Window.partitionBy("house").orderBy("sale_date", "id"))
    return listings(spark, sf_dir).where("status = 'stc'").select("id", "house", turn.alias("turn")).where("turn <= 60").orderBy("turn", "house").limit(60)


@query("w13_per_house_cap", f"""
WITH {LISTINGS} SELECT id, house, deal_type FROM listings WHERE status <> 'sold' QUALIFY deal_type = '1-URGENT' OR row_number() OVER (PARTITION BY house, deal_type = '1-URGENT' ORDER BY sale_date DESC, id) <= 5""")
def per_house_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ever = F.col("deal_type") == "1-URGENT"
    rows = listings(spark, sf_dir).where("status <> 'sold'").select("id", "house", "deal_type", "sale_date")
    few = rows.where(~ever).withColumn("r", F.row_number().over(Window.partitionBy("house").orderBy(F.desc("sale_date"), "id"))).where("r <= 5").drop("r")
    return rows.where(ever).unionByName(few).select("id", "house", "deal_type")


@query("w14_soonest_else_latest", f"""
WITH {LISTINGS} SELECT house, id, sale_date FROM listings QUALIFY row_number() OVER (PARTITION BY house ORDER BY sale_date < DATE '2001-01-01', CASE WHEN sale_date >= DATE '2001-01-01' THEN sale_date END ASC NULLS LAST, sale_date DESC, id) = 1""")
def soonest_else_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = F.col("sale_date") < F.lit("2001-01-01").cast("date")
    rows = listings(spark, sf_dir).select("house", "id", "sale_date")
    return keep_first(rows, ["house"], [past, F.when(~past, F.col("sale_date")).asc_nulls_last(), F.desc("sale_date"), "id"])


@query("w16_first_event", "SELECT user_id, min_by(event_type, (ts, event_id)) AS first_type, min(ts) AS first_ts, count(*) AS n FROM events GROUP BY user_id")
def first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.min("ts").alias("first_ts"), F.count("*").alias("n"))


@query("w17_group_headers", f"WITH {LISTINGS} SELECT id, sale_date, count(*) OVER (PARTITION BY sale_date) AS on_day FROM listings WHERE sale_date >= DATE '2001-07-01'")
def group_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).where(F.col("sale_date") >= F.lit("2001-07-01").cast("date"))
    return with_totals(rows.select("id", "sale_date"), "sale_date", on_day=F.count("*"))


#: Hours to the next probe after so many equal results in a row.
LADDER = (6, 12, 24, 48, 96, 168)


@query("w18_backoff_ladder", """
WITH s AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1 AS same FROM i)
SELECT event_id, same, [6, 12, 24, 48, 96, 168][least(same, 5) + 1] AS hours FROM c""")
def backoff_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marked = events(spark, sf_dir).withColumn("fresh", F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1))
    runs = marked.withColumn("island", F.sum("fresh").over(w))
    same = (F.row_number().over(Window.partitionBy("user_id", "island").orderBy("ts", "event_id")) - 1).cast("bigint")
    return runs.withColumn("same", same).select("event_id", "same", F.element_at(F.array(*[F.lit(h) for h in LADDER]), F.least(F.col("same"), F.lit(5)).cast("int") + 1).alias("hours"))


# set operations


@query("u01_precedence_union", f"""
WITH {LISTINGS}, u AS (SELECT owner AS key, 'cache' AS origin, 0 AS p, max(price) AS price FROM listings WHERE status = 'available' GROUP BY owner UNION ALL SELECT owner, 'lots', 1, max(price) FROM listings WHERE status <> 'available' GROUP BY owner)
SELECT key, origin, price FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY p) = 1""")
def precedence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = F.col("status") == "available"
    per = listings(spark, sf_dir).groupBy(F.col("owner").alias("key")).agg(F.max(F.when(open_, F.col("price"))).alias("cache"), F.max(F.when(~open_, F.col("price"))).alias("lots"), F.count_if(open_).alias("n"))
    return per.select("key", F.when(F.col("n") > 0, "cache").otherwise("lots").alias("origin"), F.when(F.col("n") > 0, F.col("cache")).otherwise(F.col("lots")).alias("price"))


@query("u02_union_minus_active", f"""
WITH {LISTINGS} SELECT id, owner, 'active' AS pool FROM listings WHERE status = 'available' AND sale_date >= DATE '2001-06-01'
UNION ALL SELECT id, owner, 'unsold' FROM listings l WHERE status = 'stc' AND NOT EXISTS (SELECT 1 FROM listings a WHERE a.status = 'available' AND a.sale_date >= DATE '2001-06-01' AND a.owner = l.owner)""")
def union_minus_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("id", "owner", "status", "sale_date")
    active = rows.where((F.col("status") == "available") & (F.col("sale_date") >= F.lit("2001-06-01").cast("date"))).select("id", "owner", F.lit("active").alias("pool"))
    rest = rows.where("status = 'stc'").select("id", "owner", F.lit("unsold").alias("pool")).join(active.select("owner"), "owner", "left_anti")
    return active.unionByName(rest.select("id", "owner", "pool"))


@query("u03_fallback_switch", f"""
WITH {LISTINGS}, n AS (SELECT count(*) AS n FROM listings WHERE status = 'stc' AND sale_date >= DATE '2001-07-25')
SELECT id, 'main' AS via FROM listings, n WHERE n.n >= 50 AND status = 'stc' AND sale_date >= DATE '2001-07-25' UNION ALL SELECT id, 'fallback' FROM listings, n WHERE n.n < 50 AND status = 'stc' AND sale_date >= DATE '2001-01-01'""")
def fallback_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).where((F.col("status") == "stc") & (F.col("sale_date") >= F.lit("2001-01-01").cast("date"))).select("id", (F.col("sale_date") >= F.lit("2001-07-25").cast("date")).alias("main"))
    enough = F.broadcast(rows.agg((F.count_if("main") >= 50).alias("enough")))  # one row; one plan for both branches
    return rows.crossJoin(enough).where(~F.col("enough") | F.col("main")).select("id", F.when(F.col("enough"), "main").otherwise("fallback").alias("via"))


@query("u04_set_difference", f"""
WITH {_RECALL} SELECT user_id, day, len(list_filter(ks, lambda x: NOT list_contains(prev, x)))::INT AS added, len(list_filter(prev, lambda x: NOT list_contains(ks, x)))::INT AS removed, len(list_intersect(ks, prev))::INT AS retained FROM r WHERE prev IS NOT NULL""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir).withColumn("prev", F.lag("ks").over(Window.partitionBy("user_id").orderBy("day"))).where("prev IS NOT NULL")
    return rows.select("user_id", "day", F.size(F.array_except("ks", "prev")).alias("added"), F.size(F.array_except("prev", "ks")).alias("removed"), F.size(F.array_intersect("ks", "prev")).alias("retained"))


@query("u05_vanished", f"""
WITH {_RECALL}, v AS (SELECT user_id, day, unnest(list_filter(prev, lambda x: NOT list_contains(ks, x))) AS k FROM r WHERE prev IS NOT NULL AND len(ks) * 2 >= len(prev)) SELECT user_id, day, k FROM v WHERE k % 3 <> 0""")
def vanished(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir).withColumn("prev", F.lag("ks").over(Window.partitionBy("user_id").orderBy("day")))
    gated = rows.where(F.size("ks") * 2 >= F.size("prev"))  # a scrape that shrank by half proves nothing
    return gated.select("user_id", "day", F.explode(F.array_except("prev", "ks")).alias("k")).where(F.col("k") % 3 != 0)


@query("u06_jaccard", f"""
WITH {_RECALL} SELECT user_id, day, len(list_intersect(ks, prev))::DOUBLE / (len(ks) + len(prev) - len(list_intersect(ks, prev))) AS jaccard FROM r WHERE prev IS NOT NULL""")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir).withColumn("prev", F.lag("ks").over(Window.partitionBy("user_id").orderBy("day"))).where("prev IS NOT NULL")
    return rows.select("user_id", "day", (F.size(F.array_intersect("ks", "prev")).cast("double") / F.size(F.array_union("ks", "prev"))).alias("jaccard"))


@query("u07_ghosts", f"""
WITH {LISTINGS}, w AS (SELECT id, house, sale_date, max(sale_date) OVER (PARTITION BY house) AS scraped,
  count(*) FILTER (sale_date >= DATE '2001-07-29') OVER (PARTITION BY house) AS fresh, count(*) FILTER (sale_date < DATE '2001-07-29') OVER (PARTITION BY house) AS ghosts FROM listings WHERE status <> 'sold' AND sale_date >= DATE '2001-06-01')
SELECT id, CASE WHEN sale_date >= DATE '2001-07-29' THEN 'keep' WHEN scraped < DATE '2001-07-30' THEN 'unconfirmed' WHEN fresh < ghosts THEN 'held' ELSE 'flip' END AS verdict FROM w""")
def ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows unseen for over four days: flipped only where the house was scraped and has more fresh rows than ghosts."""
    stale = F.col("sale_date") < F.date_sub(today(), 4)
    rows = listings(spark, sf_dir).where("status <> 'sold' AND sale_date >= DATE '2001-06-01'").select("id", "house", "sale_date")
    house = rows.groupBy("house").agg(F.max("sale_date").alias("scraped"), F.count_if(~stale).alias("fresh"), F.count_if(stale).alias("ghosts"))
    verdict = F.when(~stale, "keep").when(F.col("scraped") < F.date_sub(today(), 3), "unconfirmed").when(F.col("fresh") < F.col("ghosts"), "held").otherwise("flip")
    return rows.join(house, "house").select("id", verdict.alias("verdict"))


@query("u08_conditional_retire", f"""
WITH {LISTINGS} SELECT id, CASE WHEN status IN ('available', 'stc') AND sale_date < DATE '2001-01-01' THEN 'withdrawn' ELSE status END AS status, status IN ('available', 'stc') AND sale_date < DATE '2001-01-01' AS changed FROM listings""")
def conditional_retire(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("status").isin("available", "stc") & (F.col("sale_date") < F.lit("2001-01-01").cast("date"))
    return listings(spark, sf_dir).select("id", F.when(hit, "withdrawn").otherwise(F.col("status")).alias("status"), hit.alias("changed"))
