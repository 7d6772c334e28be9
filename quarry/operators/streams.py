"""Batch twins of the streams as registered queries, and findings and schedules kept by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import EVENTS, EVENTS_NOW, events, load
from ..streaming import keyed
from ..streaming.changes import change_events, health


@query("r01_change_events", f"""
WITH {EVENTS}, s AS (SELECT user_id AS key, event_id AS seq, event_type AS status, CASE WHEN k % 4 = 0 THEN NULL ELSE (k % 7)::DOUBLE END AS price FROM ev),
l AS (SELECT *, row_number() OVER w AS n, lag(status) OVER w AS ps, lag(price) OVER w AS pp FROM s WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT key, seq, 'first_seen' AS change, NULL AS old_value, status AS new_value FROM l WHERE n = 1 UNION ALL SELECT key, seq, 'status', ps, status FROM l WHERE n > 1 AND status IS DISTINCT FROM ps
UNION ALL SELECT key, seq, 'price', pp::VARCHAR, price::VARCHAR FROM l WHERE n > 1 AND price IS DISTINCT FROM pp""")
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_events(events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.when(F.col("k") % 4 != 0, (F.col("k") % 7).cast("double")).alias("price")))


@query("r02_windowed_health", "SELECT user_id, ts::DATE::TIMESTAMP AS start, count(*) FILTER (event_type = 'view') AS seen, count(*) FILTER (event_type = 'purchase') AS persisted, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1, 2")
def windowed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health(events(spark, sf_dir))


@query("r05_open_findings", "SELECT user_id % 50 AS fingerprint, event_type AS symptom, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, max(ts) >= TIMESTAMP '2024-01-28' AS open FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def open_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'error'")
    return rows.groupBy((F.col("user_id") % 50).alias("fingerprint"), F.col("event_type").alias("symptom")).agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), (F.max("ts") >= F.lit("2024-01-28").cast("timestamp")).alias("open"))


@query("r08_pulse_candidates", """
WITH l AS (SELECT user_id, max(ts) AS last, count(*) FILTER (event_type = 'error' AND ts >= TIMESTAMP '2024-01-30 20:00:00') AS flaps FROM events GROUP BY 1)
SELECT CASE WHEN last > TIMESTAMP '2024-01-30 23:00:00' THEN 'too_soon' WHEN flaps > 0 THEN 'damped' ELSE 'due' END AS reason, count(*) AS n FROM l GROUP BY 1""")
def pulse_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp")
    per = events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last"), F.count_if((F.col("event_type") == "error") & (F.col("ts") >= at("2024-01-30 20:00:00"))).alias("flaps"))
    return per.groupBy(F.when(F.col("last") > at("2024-01-30 23:00:00"), "too_soon").when(F.col("flaps") > 0, "damped").otherwise("due").alias("reason")).agg(F.count("*").alias("n"))


@query("r09_daily_quota", "SELECT user_id, ts::DATE AS day, least(count(*), 5) AS used, greatest(count(*) - 5, 0) AS refused FROM events WHERE event_type = 'click' GROUP BY 1, 2")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return events(spark, sf_dir).where("event_type = 'click'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.least(n, F.lit(5)).alias("used"), F.greatest(n - 5, F.lit(0)).alias("refused"))


@query("r10_idempotent_events", "SELECT event_id, min(ts) AS ts FROM (SELECT event_id % 4000 AS event_id, ts FROM events) GROUP BY 1")
def idempotent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy((F.col("event_id") % 4000).alias("event_id")).agg(F.min("ts").alias("ts"))


@query("e13_recall_ewma", """
WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, n, value AS ewma FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.n, 0.5::DOUBLE * s.value + 0.5::DOUBLE * r.ewma FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)
SELECT user_id, n AS runs, round(ewma, 6) AS ewma, CASE WHEN n < 3 THEN 'new' WHEN ewma < 30 THEN 'weak' WHEN ewma > 60 THEN 'strong' ELSE 'middle' END AS tier FROM r QUALIFY n = max(n) OVER (PARTITION BY user_id)""")
def recall_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential mean by powers of two: the weight of a reading follows from its distance to the last."""
    w = Window.partitionBy("user_id")
    order = w.orderBy(F.desc("ts"), F.desc("event_id"))
    back = events(spark, sf_dir).where("event_type = 'error'").withColumns({"back": F.row_number().over(order) - 1, "runs": F.count("*").over(w)})
    weight = F.when(F.col("back") == F.col("runs") - 1, F.pow(F.lit(0.5), F.col("back"))).otherwise(F.pow(F.lit(0.5), F.col("back") + 1))
    per = back.groupBy("user_id").agg(F.max("runs").alias("runs"), F.sum(F.col("value") * weight).alias("e"))
    return per.select("user_id", "runs", F.round("e", 6).alias("ewma"), F.when(F.col("runs") < 3, "new").when(F.col("e") < 30, "weak").when(F.col("e") > 60, "strong").otherwise("middle").alias("tier"))


# state machines with timers, in their batch form


def _kinds(spark: SparkSession, sf_dir: str, kinds: dict[str, str]) -> DataFrame:
    """Events of some types as rows of a machine; the type decides what an event means."""
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    rows = load(spark, sf_dir, "events").select("user_id", F.unix_micros("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"))
    return rows.where("kind IS NOT NULL")


def _followed(spark: SparkSession, sf_dir: str, kinds: dict[str, str], machine: keyed.Machine, *times: str) -> DataFrame:
    """The rows of a machine for each user up to the clock, with times as timestamps."""
    until = spark.range(1).select(F.unix_micros(F.lit(EVENTS_NOW).cast("timestamp"))).head()[0]
    out = keyed.batch(_kinds(spark, sf_dir, kinds), ["user_id"], machine, until)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", *times)})


def _sql_kinds(kinds: dict[str, str]) -> str:
    case = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in kinds.items())
    return f"l AS (SELECT user_id, ts, event_id, kind, row_number() OVER w AS n, lead(ts) OVER w AS nx FROM (SELECT *, CASE event_type {case} END AS kind FROM events) WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


LOOKS = {"view": "same", "signup": "same", "purchase": "changed", "error": "error"}
TRIES = {"error": "failed", "signup": "blocked", "purchase": "ok"}
FOUND = {"error": "error", "click": "click"}
CHARGES = {"click": "charge", "view": "charge", "error": "refund"}


@query("r07_schedule_timers", f"""
WITH RECURSIVE {_sql_kinds(LOOKS)},
r AS (
  SELECT user_id, n, ts, nx, kind, (kind = 'same')::INT AS same, CASE WHEN kind = 'changed' THEN ts END AS full_at, ts + to_hours(CASE kind WHEN 'same' THEN 12 WHEN 'changed' THEN 6 ELSE 1 END) AS next_at FROM l WHERE n = 1
  UNION ALL
  SELECT user_id, n, ts, nx, kind, same, CASE WHEN kind = 'changed' THEN ts ELSE full_at END, least(ts + to_hours(CASE WHEN kind = 'error' THEN 1 ELSE [6, 12, 24, 48, 96, 168][least(same, 5) + 1] END), full_at + INTERVAL 7 DAY)
  FROM (SELECT l.*, r.full_at, CASE l.kind WHEN 'same' THEN r.same + 1 WHEN 'changed' THEN 0 ELSE r.same END AS same FROM r JOIN l ON l.user_id = r.user_id AND l.n = r.n + 1))
SELECT user_id, ts AS at, kind AS event, same, next_at FROM r
UNION ALL SELECT user_id, greatest(next_at, ts), 'due', same, greatest(next_at, ts) FROM r WHERE greatest(next_at, ts) <= coalesce(nx, TIMESTAMP '{EVENTS_NOW}')""")
def schedule_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each look at a source with its next date, and when a source falls due without a look."""
    return _followed(spark, sf_dir, LOOKS, keyed.SCHEDULE, "next_at")


@query("r06_retry_timers", f"""
WITH RECURSIVE {_sql_kinds(TRIES)},
r AS (
  SELECT user_id, n, ts, nx, kind, CASE WHEN kind <> 'ok' THEN 1 END AS attempts, NULL::INT AS before FROM l WHERE n = 1
  UNION ALL
  SELECT l.user_id, l.n, l.ts, l.nx, l.kind, CASE l.kind WHEN 'ok' THEN NULL WHEN 'blocked' THEN coalesce(r.attempts, 1) ELSE least(coalesce(r.attempts, 0) + 1, 5) END, r.attempts FROM r JOIN l ON l.user_id = r.user_id AND l.n = r.n + 1),
t AS (SELECT *, CASE WHEN attempts < 5 THEN ts + CASE WHEN kind = 'blocked' THEN INTERVAL 15 MINUTE ELSE to_hours(pow(2, attempts - 1)::INT) END END AS next_at FROM r)
SELECT user_id, ts AS at, CASE WHEN kind = 'ok' THEN 'done' WHEN attempts >= 5 THEN 'gave up' ELSE kind END AS event, coalesce(attempts, before) AS attempts, next_at FROM t WHERE attempts IS NOT NULL OR before IS NOT NULL
UNION ALL SELECT user_id, next_at, 'retry', attempts, NULL FROM t WHERE next_at <= coalesce(nx, TIMESTAMP '{EVENTS_NOW}')""")
def retry_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to each job: failures and their waits, retries that fall due, the end after five."""
    return _followed(spark, sf_dir, TRIES, keyed.RETRIES, "next_at")


@query("r05_findings_expired", f"""
WITH {_sql_kinds(FOUND)},
g AS (SELECT *, CASE WHEN lag(ts) OVER w + INTERVAL 3 DAY > ts THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY user_id, kind ORDER BY n)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, kind ORDER BY n) AS part FROM g),
f AS (SELECT user_id, kind AS symptom, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM i GROUP BY user_id, kind, part)
SELECT user_id, first_seen AS at, symptom, 'opened' AS event, 1 AS occurrences, first_seen FROM f
UNION ALL SELECT user_id, last_seen + INTERVAL 3 DAY, symptom, 'expired', n, first_seen FROM f WHERE last_seen + INTERVAL 3 DAY <= TIMESTAMP '{EVENTS_NOW}'""")
def findings_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as they open and, three days after they were seen last, close with their count."""
    return _followed(spark, sf_dir, FOUND, keyed.FINDINGS, "first_seen")


@query("r09_quota_refunds", f"""
WITH RECURSIVE {_sql_kinds(CHARGES)},
d AS (SELECT user_id, ts, event_id, kind, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY n) AS m FROM l),
r AS (
  SELECT user_id, day, m, ts, event_id, kind, (kind = 'charge')::INT AS used, 0 AS refused, 0 AS refunded, CASE kind WHEN 'charge' THEN 'charged' ELSE 'nothing' END AS event FROM d WHERE m = 1
  UNION ALL
  SELECT d.user_id, d.day, d.m, d.ts, d.event_id, d.kind, CASE d.kind WHEN 'charge' THEN least(2, r.used + 1) ELSE greatest(0, r.used - 1) END, r.refused + (d.kind = 'charge' AND r.used >= 2)::INT, r.refunded + (d.kind = 'refund' AND r.used > 0)::INT,
    CASE WHEN d.kind = 'charge' THEN CASE WHEN r.used < 2 THEN 'charged' ELSE 'refused' END WHEN r.used > 0 THEN 'refunded' ELSE 'nothing' END
  FROM r JOIN d ON d.user_id = r.user_id AND d.day = r.day AND d.m = r.m + 1)
SELECT user_id, ts AS at, event_id AS seq, event, used, refused, refunded FROM r
UNION ALL SELECT user_id, day + INTERVAL 1 DAY, NULL, 'day over', used, refused, refunded FROM r WHERE day + INTERVAL 1 DAY <= TIMESTAMP '{EVENTS_NOW}' QUALIFY m = max(m) OVER (PARTITION BY user_id, day)""")
def quota_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges against two a day, refunds of the same day, and each day's end."""
    return _followed(spark, sf_dir, CHARGES, keyed.quota(2))


@query("e13_recall_tiers", """
WITH RECURSIVE s AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, least(value, 100) / 100 AS v FROM events WHERE event_type <> 'click' AND value IS NOT NULL),
r AS (
  SELECT user_id, ts, n, floor(v * 1000 + 0.5) / 1000 AS mean, 'fast' AS tier, false AS changed FROM s WHERE n = 1
  UNION ALL
  SELECT user_id, ts, n, floor(m * 1000 + 0.5) / 1000, CASE WHEN n >= 3 AND tier = 'fast' AND m < 0.7 THEN 'capable' WHEN n >= 3 AND tier = 'capable' AND m >= 0.9 THEN 'fast' ELSE tier END, n >= 3 AND ((tier = 'fast' AND m < 0.7) OR (tier = 'capable' AND m >= 0.9))
  FROM (SELECT s.*, r.tier, 0.4::DOUBLE * s.v + (1 - 0.4::DOUBLE) * r.mean AS m FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1))
SELECT user_id, ts AS at, n AS runs, mean, tier, changed FROM r""")
def recall_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling recall after each reading and the tier that follows from it and the tier before; clicks measure nothing."""
    value = F.when(F.col("event_type") != "click", F.least("value", F.lit(100.0)) / 100)
    rows = load(spark, sf_dir, "events").select("user_id", F.unix_micros("ts").alias("at"), F.col("event_id").alias("seq"), value.cast("string").alias("kind"))
    return keyed.batch(rows, ["user_id"], keyed.recall(demote=True), 0).withColumn("at", F.timestamp_micros("at"))
