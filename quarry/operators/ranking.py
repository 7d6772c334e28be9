"""Orders, limits, pages and the served board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import views
from ..registry import query
from ..sources.tables import LISTINGS, ORDERS_TODAY, events, listings, load, spread, today
from .windows import keep_first

#: Points of the board's score.
_SCORE = """least(10, greatest(0, CASE WHEN price < 50000 THEN 3 WHEN price < 100000 THEN 2 WHEN price < 150000 THEN 1 ELSE 0 END
  + CASE deal_type WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END + CASE WHEN balance < 0 THEN 2 ELSE 0 END + CASE WHEN prop_type = 'BUILDING' THEN 1 ELSE 0 END - CASE WHEN status = 'stc' THEN 2 ELSE 0 END))"""


def score() -> Column:
    price, deal = F.col("price"), F.col("deal_type")
    points = (
        F.when(price < 50000, 3).when(price < 100000, 2).when(price < 150000, 1).otherwise(0)
        + F.when(deal == "1-URGENT", 3).when(deal == "2-HIGH", 2).when(deal == "3-MEDIUM", 1).otherwise(0)
        + F.when(F.col("balance") < 0, 2).otherwise(0)
        + F.when(F.col("prop_type") == "BUILDING", 1).otherwise(0)
        - F.when(F.col("status") == "stc", 2).otherwise(0)
    )
    return F.least(F.lit(10), F.greatest(F.lit(0), points))


def fresh(today: Column, window: int = 365) -> Column:
    """The served feed: available and lately seen, or unsold in the last 30 days."""
    age = F.datediff(today, F.col("sale_date"))
    return ((F.col("status") == "available") & (age <= window)) | ((F.col("status") == "stc") & (age <= 30))


@query("active_board", f"""
WITH {LISTINGS}, f AS (SELECT *, {_SCORE} AS score FROM listings WHERE (status = 'available' AND DATE '{ORDERS_TODAY}' - sale_date <= 365) OR (status = 'stc' AND DATE '{ORDERS_TODAY}' - sale_date <= 30)),
cal AS (SELECT n_name AS house, min(s_suppkey) AS calendar_id, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY house, owner, price ORDER BY score DESC, id) = 1)
SELECT id, d.house, owner, price, status, sale_date, prop_type, deal_type, score, calendar_id, suppliers FROM d LEFT JOIN cal ON d.house = cal.house ORDER BY score DESC NULLS LAST, sale_date, id LIMIT 100""")
def active_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = listings(spark, sf_dir).where(fresh(today())).withColumn("score", score())
    calendar = load(spark, sf_dir, "supplier").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("house")).agg(F.min("s_suppkey").alias("calendar_id"), F.count("*").alias("suppliers"))
    one = keep_first(feed, ["house", "owner", "price"], [F.desc("score"), "id"])
    board = one.join(calendar, "house", "left").orderBy(F.desc_nulls_last("score"), "sale_date", "id").limit(100)
    return board.select("id", "house", "owner", "price", "status", "sale_date", "prop_type", "deal_type", "score", "calendar_id", "suppliers")


@query("t01_top_desc_nulls_last", f"WITH {LISTINGS} SELECT id, nullif(prop_type, 'BUILDING') AS kind, price FROM listings ORDER BY kind DESC NULLS LAST, price DESC, id LIMIT 50")
def top_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", F.nullif("prop_type", F.lit("BUILDING")).alias("kind"), "price").orderBy(F.desc_nulls_last("kind"), F.desc("price"), "id").limit(50)


#: Browse orders by name; 0 and null prices sink.
ORDERS = {
    "date_asc": lambda: [F.when(F.col("sale_date") >= today(), 0).otherwise(1), F.col("sale_date").asc_nulls_last(), F.desc("score"), F.col("id")],
    "price_asc": lambda: [F.nullif("price", F.lit(0)).asc_nulls_last(), F.col("id")],
    "price_desc": lambda: [F.coalesce("price", F.lit(0)).desc(), F.col("id")],
    "score": lambda: [F.coalesce("score", F.lit(0)).desc(), F.nullif("price", F.lit(0)).asc_nulls_last(), F.col("id")],
}


@query("t02_browse_orders", f"""
WITH {LISTINGS}, s AS (SELECT id, price, sale_date, {_SCORE} AS score FROM listings),
r AS (SELECT id, row_number() OVER (ORDER BY nullif(price, 0) NULLS LAST, id) AS price_asc, row_number() OVER (ORDER BY coalesce(price, 0) DESC, id) AS price_desc FROM s)
(SELECT 'price_asc' AS sort, id FROM s ORDER BY nullif(price, 0) NULLS LAST, id LIMIT 20) UNION ALL (SELECT 'price_desc', id FROM s ORDER BY coalesce(price, 0) DESC, id LIMIT 20)
UNION ALL (SELECT 'score', id FROM s ORDER BY coalesce(score, 0) DESC, nullif(price, 0) NULLS LAST, id LIMIT 20) UNION ALL (SELECT 'date_asc', id FROM s ORDER BY CASE WHEN sale_date >= DATE '{ORDERS_TODAY}' THEN 0 ELSE 1 END, sale_date NULLS LAST, score DESC, id LIMIT 20)""")
def browse_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumn("score", score())
    tops = [rows.orderBy(*by()).limit(20).select(F.lit(name).alias("sort"), "id") for name, by in ORDERS.items()]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


_TYPES = ("BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE")


@query("t03_score_view", f"""
WITH {LISTINGS}, s AS (SELECT id, prop_type, price, {_SCORE} AS score FROM listings) SELECT id, prop_type, score FROM s ORDER BY list_position(['BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD', 'AUTOMOBILE'], prop_type), score DESC, price, id LIMIT 80""")
def score_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(t) for t in _TYPES]), F.col("prop_type"))
    return listings(spark, sf_dir).withColumn("score", score()).orderBy(place, F.desc("score"), "price", "id").limit(80).select("id", "prop_type", "score")


@query("t04_page", f"WITH {LISTINGS} SELECT id, price FROM listings ORDER BY price DESC, id LIMIT 25 OFFSET 50")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", "price").orderBy(F.desc("price"), "id").offset(50).limit(25)


@query("t05_severity_order", """
WITH s AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, n DESC, event_type) AS place FROM s""")
def severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    per = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))  # one row a type
    return per.select("event_type", "n", F.row_number().over(Window.orderBy(rank, F.desc("n"), "event_type")).alias("place"))


@query("t07_digest_top", f"WITH {LISTINGS} SELECT id, {_SCORE} AS score, sale_date FROM listings WHERE status = 'available' ORDER BY score DESC, sale_date DESC, id LIMIT 10")
def digest_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).where("status = 'available'").select("id", score().alias("score"), "sale_date").orderBy(F.desc("score"), F.desc("sale_date"), "id").limit(10)


@query("t09_stale_work", """
WITH p AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type FROM events), l AS (SELECT user_id, event_type, max(ts) AS last FROM events WHERE user_id % 3 <> 0 GROUP BY 1, 2)
SELECT p.user_id, t.event_type, l.last FROM p CROSS JOIN t LEFT JOIN l ON l.user_id = p.user_id AND l.event_type = t.event_type ORDER BY l.last NULLS FIRST, p.user_id, t.event_type LIMIT 40""")
def stale_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_type", "ts")
    kinds = rows.select("event_type").distinct()  # a fixed vocabulary
    last = rows.where("user_id % 3 <> 0").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    all_ = rows.select("user_id").distinct().crossJoin(F.broadcast(kinds))
    return all_.join(last, ["user_id", "event_type"], "left").orderBy(F.asc_nulls_first("last"), "user_id", "event_type").limit(40)


@query("t10_due_retries", """
SELECT event_id, least(pow(2, greatest(event_id % 7 - 1, 0)), 24)::DOUBLE AS hours FROM events WHERE event_type = 'error' AND event_id % 7 < 5 AND ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts, event_id LIMIT 100""")
def due_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = F.col("event_id") % 7
    hours = F.least(F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(24.0))
    due = events(spark, sf_dir).where((F.col("event_type") == "error") & (attempts < 5) & (F.col("ts") <= F.lit("2024-01-20").cast("timestamp")))
    return due.orderBy("ts", "event_id").limit(100).select("event_id", hours.alias("hours"))


#: Valued listings, as expressions that Spark and DuckDB both read.
VALUED = {
    "id": "c_custkey",
    "price": "CASE WHEN c_custkey % 97 = 0 THEN 0 WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey * 37 % 400 AS DOUBLE) * 1000 + 500 END",
    "score": "CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey * 7 % 100 AS DOUBLE) / 10 END",
    "vacant": "CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE c_custkey % 3 = 0 END",
    "kind": "CASE c_custkey % 5 WHEN 0 THEN 'flat' WHEN 1 THEN 'house' WHEN 2 THEN 'commercial' WHEN 3 THEN 'land' END",
    "gross": "CASE WHEN c_custkey % 4 <> 3 THEN CAST(c_custkey * 11 % 450 AS DOUBLE) / 10 END",
    "warned": "c_custkey % 17 = 0",
    "street": "CASE WHEN c_custkey % 3 <> 2 THEN CAST(c_custkey * 29 % 600 AS DOUBLE) * 1000 END",
    "split": "c_custkey % 8 = 5",
    "units": "CASE WHEN c_custkey % 2 = 1 THEN c_custkey % 9 END",
    "opp": "CASE c_custkey % 7 WHEN 0 THEN 'Executor sale' WHEN 1 THEN 'PROBATE' WHEN 2 THEN 'Development potential' WHEN 3 THEN 'Vacant' END",
    "condition": "CASE c_custkey % 4 WHEN 0 THEN 'needs work' WHEN 1 THEN 'poor' WHEN 2 THEN 'good' END",
    "deal_type": "CASE WHEN c_custkey % 10 = 4 THEN 'HMO' WHEN c_custkey % 10 <> 5 THEN 'Standard' END",
    "signal": "CASE c_custkey % 12 WHEN 1 THEN 'hmo' WHEN 4 THEN 'investment-valuation' END",
    "income": "CASE WHEN c_custkey % 9 = 4 THEN c_custkey * 13 % 50000 END",
    "days": "CASE WHEN c_custkey % 6 <> 2 THEN CAST(c_custkey * 3 % 200 - 60 AS INT) END",
    "below_market": "CASE WHEN c_custkey % 5 <> 1 THEN CAST(c_custkey * 17 % 1300 AS DOUBLE) / 10 - 40 END",
    "net_yield": "CASE WHEN c_custkey % 7 <> 6 THEN CAST(c_custkey * 19 % 300 AS DOUBLE) / 10 END",
    "roce": "CASE WHEN c_custkey % 7 <> 5 THEN CAST(c_custkey * 23 % 700 AS DOUBLE) / 10 - 10 END",
    "days_since": "CASE WHEN c_custkey % 3 = 1 THEN c_custkey * 5 % 400 END",
}
_VALUED = f"""v AS (SELECT {", ".join(f"{e} AS {c}" for c, e in VALUED.items())} FROM customer),
w AS (SELECT *, CASE WHEN days IS NOT NULL THEN DATE '{ORDERS_TODAY}' + days END AS sale_date, coalesce(price > 0 AND street >= 50000 AND price / street <= 0.3::DOUBLE, false) OR coalesce(price > 0 AND price <= 15000 AND gross > 30, false) AS tok FROM v)"""
#: Preset or order: condition, keys.
_VIEWS_SQL = {
    "top-picks": ("score >= 3", "score"), "under-100k": ("price > 0 AND price < 100000", "-price"), "vacant": ("vacant", "coalesce(score, 0)"), "flats": ("kind = 'flat'", "coalesce(score, 0)"), "high-yield-8": ("gross >= 8 AND NOT warned AND NOT tok", "gross"),
    "title-splits": ("split", "coalesce(units, 0) DESC, coalesce(score, 0)"), "probate": ("opp IN ('Executor sale', 'PROBATE')", "coalesce(score, 0)"), "heavy-refurb": ("condition IN ('needs work', 'poor')", "coalesce(score, 0)"), "dev-land": ("opp = 'Development potential'", "coalesce(score, 0)"),
    "commercial": ("kind = 'commercial'", "coalesce(score, 0)"), "land-dev": ("coalesce(kind, '') = 'land' OR coalesce(opp, '') = 'Development potential'", "coalesce(score, 0)"), "hmo": ("coalesce(deal_type, '') = 'HMO' OR coalesce(signal, '') = 'hmo'", "(coalesce(signal, '') = 'investment-valuation')::INT DESC, coalesce(income, 0) DESC, coalesce(score, 0)"),
}
_ORDERS_SQL = {
    "date_asc": f"(coalesce(sale_date, DATE '9999-12-31') >= DATE '{ORDERS_TODAY}')::INT DESC, coalesce(sale_date, DATE '9999-12-31') ASC, coalesce(score, 0)", "price_asc": "-coalesce(nullif(price, 0), 1e18)", "price_desc": "coalesce(price, 0)",
    "yield": "CASE WHEN tok THEN -1e9 ELSE coalesce(gross, -1e9) END", "bmv": "CASE WHEN tok THEN -1e9 ELSE coalesce(below_market, -1e9) END", "net_yield": "CASE WHEN tok THEN -1e9 ELSE coalesce(net_yield, -1e9) END", "roce": "CASE WHEN tok THEN -1e9 ELSE coalesce(roce, -1e9) END",
    "days_unsold": "coalesce(days_since, 0)", "score": "coalesce(score, 0) DESC, -coalesce(nullif(price, 0), 1e18)",
}


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(load(spark, sf_dir, "customer").select("c_custkey")).select(*(F.expr(e).alias(c) for c, e in VALUED.items()))
    return rows.select("*", F.array("opp").alias("opps"), F.array_compact(F.array("signal")).alias("signals"), F.date_add(today(), F.col("days")).alias("sale_date"))


@query("f16_all_presets", f"WITH {_VALUED} " + " UNION ALL ".join(f"SELECT '{n}' AS view, row_number() OVER (ORDER BY {k} DESC, id) AS rank, id FROM w WHERE {where} QUALIFY rank <= 100" for n, (where, k) in _VIEWS_SQL.items()))
def all_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 rows of each of the twelve named searches."""
    return views.ranked(valued(spark, sf_dir), views.presets(), 100)


@query("t02_all_orders", f"WITH {_VALUED} " + " UNION ALL ".join(f"SELECT '{n}' AS view, row_number() OVER (ORDER BY {k} DESC, id) AS rank, id FROM w QUALIFY rank <= 100" for n, k in _ORDERS_SQL.items()))
def all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 rows in each of the nine browse orders."""
    return views.ranked(valued(spark, sf_dir), views.orders(today()), 100)
