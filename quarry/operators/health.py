"""Source health, spend and fleet reports over event logs and listings.

Every report is one pass of conditional aggregates. Times are compared with an explicit clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import EVENTS, EVENTS_NOW, LISTINGS, ORDERS_TODAY, events, listings, load, now, today

FAILED, PERSISTED, SEEN = "error", "purchase", "view"


def since(days: int, at: str = "ts") -> Column:
    """Rows of the last ``days`` days before the clock."""
    return (F.col(at) >= now() - F.expr(f"INTERVAL {days} DAY")) & (F.col(at) < now())


def is_(kind: str, at: str = "event_type") -> Column:
    return F.col(at) == kind


def percent(part: Column, whole: Column) -> Column:
    """A percentage as a double, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0))


_LAST = f"ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 1 DAY AND ts < TIMESTAMP '{EVENTS_NOW}'"
_WEEK = f"ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{EVENTS_NOW}'"


@query("a01_source_health_24h", f"""
WITH g AS (SELECT count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type IN ('purchase', 'error')) AS a FROM events WHERE {_LAST})
SELECT user_id AS house, max(ts) FILTER (event_type = 'purchase') AS last_success, max(ts) FILTER (event_type = 'error') AS last_failure,
  count(*) FILTER (event_type = 'view') AS seen, count(*) FILTER (event_type = 'purchase') AS persisted,
  count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'purchase') AS dropped,
  coalesce(any_value(g.p)::DOUBLE * 100 / nullif(any_value(g.a), 0), 0) AS fleet_success_pct
FROM events, g WHERE {_LAST} GROUP BY user_id""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = events(spark, sf_dir).where(since(1))
    fleet = day.agg(percent(F.count_if(is_(PERSISTED)), F.count_if(is_(PERSISTED) | is_(FAILED))).alias("fleet_success_pct"))
    per = day.groupBy(F.col("user_id").alias("house")).agg(
        F.max(F.when(is_(PERSISTED), F.col("ts"))).alias("last_success"),
        F.max(F.when(is_(FAILED), F.col("ts"))).alias("last_failure"),
        F.count_if(is_(SEEN)).alias("seen"),
        F.count_if(is_(PERSISTED)).alias("persisted"),
        (F.count_if(is_(SEEN)) - F.count_if(is_(PERSISTED))).alias("dropped"),
    )
    return per.crossJoin(F.broadcast(fleet))  # j02: one row


@query("a02_circuit_state_7d", f"""
SELECT count(*) AS n, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'error') AS failed,
  max(ts) FILTER (event_type = 'error') AS last_open, max(ts) FILTER (event_type = 'purchase') AS last_closed,
  CASE WHEN max(ts) FILTER (event_type = 'error') IS NULL THEN 'closed' WHEN max(ts) FILTER (event_type = 'purchase') > max(ts) FILTER (event_type = 'error') THEN 'closed' ELSE 'open' END AS circuit
FROM events WHERE {_WEEK}""")
def circuit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened, closed = F.max(F.when(is_(FAILED), F.col("ts"))), F.max(F.when(is_(PERSISTED), F.col("ts")))
    state = F.when(opened.isNull() | (closed > opened), "closed").otherwise("open")
    return events(spark, sf_dir).where(since(7)).agg(F.count("*").alias("n"), F.count_if(is_(PERSISTED)).alias("ok"), F.count_if(is_(FAILED)).alias("failed"), opened.alias("last_open"), closed.alias("last_closed"), state.alias("circuit"))


@query("a03_dormant_sources", f"""
SELECT user_id AS house, max(ts) FILTER (event_type = 'purchase') AS last_ok, date_diff('day', (max(ts) FILTER (event_type = 'purchase'))::DATE, DATE '2024-01-31') AS days
FROM events GROUP BY 1 HAVING last_ok IS NULL OR last_ok < TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY""")
def dormant_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = events(spark, sf_dir).groupBy(F.col("user_id").alias("house")).agg(F.max(F.when(is_(PERSISTED), F.col("ts"))).alias("last_ok"))
    return last.where(F.col("last_ok").isNull() | (F.col("last_ok") < now() - F.expr("INTERVAL 7 DAY"))).withColumn("days", F.datediff(now().cast("date"), F.col("last_ok").cast("date")).cast("bigint"))


@query("a04_spend_by_endpoint_24h", f"""
WITH {EVENTS} SELECT event_type AS endpoint, k % 10 AS caller, count(*) AS calls, sum(value::DECIMAL(18,4))::DOUBLE AS spend,
  count(*) FILTER (value > 50) AS good, count(*) FILTER (value <= 50) AS bad, sum(k)::DOUBLE / count(*) AS avg_latency, max(ts) AS last_call
FROM ev WHERE {_LAST} GROUP BY 1, 2""")
def spend_by_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(since(1)).groupBy(F.col("event_type").alias("endpoint"), (F.col("k") % 10).alias("caller")).agg(
        F.count("*").alias("calls"),
        F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("spend"),
        F.count_if(F.col("value") > 50).alias("good"),
        F.count_if(F.col("value") <= 50).alias("bad"),
        (F.sum("k").cast("double") / F.count("*")).alias("avg_latency"),
        F.max("ts").alias("last_call"),
    )


@query("a05_spend_rollup_7d", f"""
WITH {EVENTS} SELECT event_type AS endpoint, count(*) AS calls, sum(k)::BIGINT AS weight, sum(k)::DOUBLE / nullif(count(*) FILTER (k > 500), 0) AS weight_per_heavy_call
FROM ev WHERE {_WEEK} GROUP BY 1""")
def spend_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(since(7)).groupBy(F.col("event_type").alias("endpoint")).agg(F.count("*").alias("calls"), F.sum("k").alias("weight"), F.try_divide(F.sum("k").cast("double"), F.count_if(F.col("k") > 500)).alias("weight_per_heavy_call"))


@query("a06_local_day_success", """
SELECT user_id AS house, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London')::DATE AS local_day, count(*) FILTER (event_type IN ('purchase', 'error')) AS attempts,
  coalesce(count(*) FILTER (event_type = 'purchase')::DOUBLE * 100 / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0), 0) AS success_pct
FROM events GROUP BY 1, 2""")
def local_day_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date(F.from_utc_timestamp("ts", "Europe/London"))
    tried = is_(PERSISTED) | is_(FAILED)
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("house"), day.alias("local_day")).agg(F.count_if(tried).alias("attempts"), percent(F.count_if(is_(PERSISTED)), F.count_if(tried)).alias("success_pct"))


@query("a07_experiment_pivot", """
WITH {e} SELECT event_type AS metric, sum(k) FILTER (user_id % 2 = 0)::DOUBLE / count(*) FILTER (user_id % 2 = 0) AS control, sum(k) FILTER (user_id % 2 = 1)::DOUBLE / count(*) FILTER (user_id % 2 = 1) AS treatment,
  sum(k) FILTER (user_id % 2 = 1)::DOUBLE / count(*) FILTER (user_id % 2 = 1) - sum(k) FILTER (user_id % 2 = 0)::DOUBLE / count(*) FILTER (user_id % 2 = 0) AS delta
FROM ev GROUP BY 1""".format(e=EVENTS))
def experiment_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment")
    wide = events(spark, sf_dir).withColumn("arm", arm).groupBy(F.col("event_type").alias("metric")).pivot("arm", ["control", "treatment"])
    return wide.agg(F.sum("k").cast("double") / F.count("k")).withColumn("delta", F.col("treatment") - F.col("control"))


@query("a08_daily_stats", """
WITH {e} SELECT ts::DATE AS day, count(*) AS n, sum(k)::DOUBLE / count(*) AS mean, round(stddev_samp(k), 6) AS sd FROM ev GROUP BY 1""".format(e=EVENTS))
def daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), (F.sum("k").cast("double") / F.count("*")).alias("mean"), F.round(F.stddev_samp("k"), 6).alias("sd"))


@query("a09_spend_since", "SELECT coalesce(sum(value::DECIMAL(18,4)), 0)::DOUBLE AS spend FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def spend_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).agg(F.coalesce(F.sum(F.col("value").cast("decimal(18,4)")), F.lit(0)).cast("double").alias("spend"))


@query("a10_invariant_findings", f"""
WITH {LISTINGS}, r AS (
  SELECT 'stc_in_feed' AS symptom, house AS subject, count(*) AS n FROM listings WHERE status = 'stc' AND sale_date >= DATE '2001-07-02' GROUP BY house
  UNION ALL SELECT 'feed_floor', 'feed', count(*) FROM listings WHERE status = 'available' AND sale_date >= DATE '2001-07-02' HAVING count(*) < 2000
  UNION ALL SELECT 'scoring_coverage', house, count(*) FILTER (price < 100000) FROM listings GROUP BY house HAVING count(*) FILTER (price < 100000) * 2 > count(*)
  UNION ALL SELECT 'house_dark', house, count(*) FROM listings GROUP BY house HAVING max(sale_date) < DATE '2001-07-31')
SELECT * FROM r UNION ALL SELECT 'degraded', 'fleet', sum(n)::BIGINT FROM r WHERE symptom = 'house_dark' HAVING count(*) >= 5""")
def invariant_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    recent = F.col("sale_date") >= F.lit("2001-07-02").cast("date")
    per = rows.groupBy("house").agg(
        F.count_if((F.col("status") == "stc") & recent).alias("stc"), F.count_if((F.col("status") == "available") & recent).alias("feed"), F.count_if(F.col("price") < 100000).alias("unscored"), F.count("*").alias("n"), F.max("sale_date").alias("last")
    )  # one pass; every rule reads these few rows
    rule = lambda symptom, subject, n: F.struct(F.lit(symptom).alias("symptom"), subject.alias("subject"), n.alias("n"))
    dark = F.col("last") < F.lit("2001-07-31").cast("date")
    house = F.col("house")
    found = per.select(F.explode(F.array_compact(F.array(F.when(F.col("stc") > 0, rule("stc_in_feed", house, F.col("stc"))), F.when(F.col("unscored") * 2 > F.col("n"), rule("scoring_coverage", house, F.col("unscored"))), F.when(dark, rule("house_dark", house, F.col("n")))))).alias("r")).select("r.*")
    feed = per.agg(F.coalesce(F.sum("feed"), F.lit(0)).alias("n")).where(F.col("n") < 2000).select(F.lit("feed_floor").alias("symptom"), F.lit("feed").alias("subject"), "n")
    fleet = per.agg(F.sum(F.when(dark, F.col("n"))).alias("n"), F.count_if(dark).alias("c")).where(F.col("c") >= 5).select(F.lit("degraded").alias("symptom"), F.lit("fleet").alias("subject"), "n")
    return found.unionByName(feed).unionByName(fleet)


@query("a11_coverage_percentages", """
SELECT coalesce(avg((quality IS NOT NULL)::INT) * 100, 0) AS labelled_pct, coalesce(avg((quality = 1)::INT::DOUBLE) * 100, 0) AS good_pct, coalesce(count(*) FILTER (toxic = 0)::DOUBLE * 100 / nullif(count(*), 0), 0) AS clean_pct, coalesce(count(*) FILTER (n_chars > 500)::DOUBLE * 100 / nullif(count(*), 0), 0) AS long_pct
FROM documents LEFT JOIN labels USING (doc_id)""")
def coverage_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.agg(
        (F.avg(F.col("quality").isNotNull().cast("int")) * 100).alias("labelled_pct"),
        F.coalesce(F.avg((F.col("quality") == 1).cast("double")) * 100, F.lit(0.0)).alias("good_pct"),
        percent(F.count_if(F.col("toxic") == 0), F.count("*")).alias("clean_pct"),
        percent(F.count_if(F.col("n_chars") > 500), F.count("*")).alias("long_pct"),
    )


@query("a12_worst_groups", """
SELECT source, count(*) AS n, count(*) FILTER (quality IS NULL)::DOUBLE * 100 / count(*) AS gap FROM documents LEFT JOIN labels USING (doc_id)
GROUP BY source HAVING count(*) >= 8 ORDER BY gap DESC, n DESC, source LIMIT 5""")
def worst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    per = joined.groupBy("source").agg(F.count("*").alias("n"), percent(F.count_if(F.col("quality").isNull()), F.count("*")).alias("gap"))
    return per.where("n >= 8").orderBy(F.desc("gap"), F.desc("n"), "source").limit(5)


@query("a13_day_over_day", """
WITH d AS (SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE extract(day FROM ts) % 7 <> 0 GROUP BY 1)
SELECT d.day, d.n, d.n - p.n AS n_delta, d.users - p.users AS users_delta FROM d LEFT JOIN d p ON p.day = d.day - 1""")
def day_over_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = events(spark, sf_dir).where(F.dayofmonth("ts") % 7 != 0).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    before = days.select(F.date_add("day", 1).alias("day"), F.col("n").alias("n0"), F.col("users").alias("users0"))  # exactly yesterday, not the row before
    return days.join(before, "day", "left").select("day", "n", (F.col("n") - F.col("n0")).alias("n_delta"), (F.col("users") - F.col("users0")).alias("users_delta"))


@query("a14_freshness_buckets", f"""
WITH {LISTINGS} SELECT count(*) FILTER (DATE '{ORDERS_TODAY}' - sale_date < 1) AS under_1d, count(*) FILTER (DATE '{ORDERS_TODAY}' - sale_date BETWEEN 1 AND 6) AS d1_7,
  count(*) FILTER (DATE '{ORDERS_TODAY}' - sale_date BETWEEN 7 AND 13) AS d7_14, count(*) FILTER (DATE '{ORDERS_TODAY}' - sale_date >= 14) AS over_14d,
  count(*) FILTER (status <> 'sold' AND DATE '{ORDERS_TODAY}' - sale_date <= 30) AS backlog_in, count(*) FILTER (status <> 'sold' AND DATE '{ORDERS_TODAY}' - sale_date > 30) AS backlog_out FROM listings""")
def freshness_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    age, open_ = F.datediff(today(), F.col("sale_date")), F.col("status") != "sold"
    return listings(spark, sf_dir).agg(
        F.count_if(age < 1).alias("under_1d"), F.count_if(age.between(1, 6)).alias("d1_7"), F.count_if(age.between(7, 13)).alias("d7_14"), F.count_if(age >= 14).alias("over_14d"),
        F.count_if(open_ & (age <= 30)).alias("backlog_in"), F.count_if(open_ & (age > 30)).alias("backlog_out"),
    )


@query("a15_house_freshness", f"""
WITH {LISTINGS} SELECT house, count(*) FILTER (status = 'available') AS available, count(*) FILTER (status = 'available' AND sale_date >= DATE '2001-07-26') AS fresh, count(*) FILTER (nullif(price, 0) IS NULL) AS null_price, max(sale_date) AS last_seen FROM listings GROUP BY house""")
def house_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("status") == "available"
    return listings(spark, sf_dir).groupBy("house").agg(F.count_if(ok).alias("available"), F.count_if(ok & (F.col("sale_date") >= F.date_sub(today(), 7))).alias("fresh"), F.count_if(F.nullif("price", F.lit(0)).isNull()).alias("null_price"), F.max("sale_date").alias("last_seen"))


@query("a16_fleet_score", f"""
WITH {LISTINGS}, s AS (SELECT house, count(*) AS n, count(*) FILTER (status = 'available') AS live, max(sale_date) AS last FROM listings GROUP BY house),
c AS (SELECT *, CASE WHEN live = 0 THEN 'empty' WHEN last < DATE '2001-07-26' THEN 'dark' WHEN live * 3 < n THEN 'partial' ELSE 'full' END AS class FROM s)
SELECT house, class, n, live, CASE class WHEN 'full' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS credit,
  (SELECT sum(n * CASE class WHEN 'full' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) * 100 / sum(n) FROM c) AS fleet_pct FROM c""")
def fleet_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = listings(spark, sf_dir).groupBy("house").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "available").alias("live"), F.max("sale_date").alias("last"))
    kind = F.when(F.col("live") == 0, "empty").when(F.col("last") < F.date_sub(today(), 7), "dark").when(F.col("live") * 3 < F.col("n"), "partial").otherwise("full")
    graded = spine.withColumn("class", kind).withColumn("credit", F.when(F.col("class") == "full", 1.0).when(F.col("class") == "partial", 0.5).otherwise(0.0))
    fleet = graded.agg((F.sum(F.col("n") * F.col("credit")) * 100 / F.sum("n")).alias("fleet_pct"))
    return graded.drop("last").crossJoin(F.broadcast(fleet))  # one row


@query("a17_daily_snapshot", """
SELECT ts::DATE AS day, count(*) AS total, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def daily_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.count_if(is_("view")).alias("views"), F.count_if(is_("error")).alias("errors"), F.count_distinct("user_id").alias("users"))


@query("a19_weighted_coverage", """
WITH p AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars > 1000)::DOUBLE * 100 / count(*) AS pct FROM documents GROUP BY source)
SELECT source, n, pct, pct < 50 AS low, (SELECT sum(round(pct * n / 100)) * 100 / sum(n) FROM p)::DOUBLE AS weighted FROM p""")
def weighted_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("hit"))
    all_ = per.agg((F.sum("hit").cast("double") * 100 / F.sum("n")).alias("weighted"))
    pct = F.col("hit").cast("double") * 100 / F.col("n")
    return per.select("source", "n", pct.alias("pct"), (pct < 50).alias("low")).crossJoin(F.broadcast(all_))  # one row


@query("a20_liveness_buckets", f"""
WITH {LISTINGS}, h AS (SELECT house, count(*) FILTER (sale_date >= DATE '2001-07-26') AS fresh, max(sale_date) >= DATE '2001-06-01' AS reachable FROM listings GROUP BY house)
SELECT CASE WHEN fresh > 0 THEN 'live' WHEN reachable THEN 'silent' ELSE 'unreachable' END AS bucket, count(*) AS houses FROM h GROUP BY 1""")
def liveness_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = listings(spark, sf_dir).groupBy("house").agg(F.count_if(F.col("sale_date") >= F.date_sub(today(), 7)).alias("fresh"), (F.max("sale_date") >= F.lit("2001-06-01").cast("date")).alias("reachable"))
    return per.groupBy(F.when(F.col("fresh") > 0, "live").when(F.col("reachable"), "silent").otherwise("unreachable").alias("bucket")).agg(F.count("*").alias("houses"))


@query("a21_quality_issues", f"""
WITH {LISTINGS}, h AS (SELECT house, count(*) AS n, count(*) FILTER (status = 'stc') AS stc, min(price) AS low, max(sale_date) AS last FROM listings GROUP BY house)
SELECT house, 'many_stc' AS issue, 'high' AS severity FROM h WHERE stc * 20 > n UNION ALL SELECT house, 'tiny_price', 'low' FROM h WHERE low < 2000 UNION ALL SELECT house, 'stale', 'medium' FROM h WHERE last < DATE '2001-08-01'""")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = listings(spark, sf_dir).groupBy("house").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "stc").alias("stc"), F.min("price").alias("low"), F.max("sale_date").alias("last"))
    issue = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(issue(F.col("stc") * 20 > F.col("n"), "many_stc", "high"), issue(F.col("low") < 2000, "tiny_price", "low"), issue(F.col("last") < F.date_sub(today(), 1), "stale", "medium")))
    return per.select("house", F.explode(found).alias("i")).select("house", "i.*")
