"""Schedules and state by key: circuits, budgets, alerts, retries, sessions, house classes and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import saved, search
from ..registry import query
from ..sources.tables import EVENTS, LISTINGS, ORDERS_TODAY, events, listings, load, today
from ..streaming import circuits
from ..streaming.late import late_by_batch
from .deals import TOLD, told

#: Health of a run without its history: the points of images and of the way of extraction.
_RUNS = "runs AS (SELECT user_id AS house, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_type = 'error' THEN 0 ELSE k % 40 END AS lots, (value / 2)::DOUBLE AS images, event_type = 'purchase' AS warned, event_type = 'signup' AS dom, event_type = 'error' AND k % 4 = 0 AS outage, ts FROM ev)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of a house for each event: ``house, ts, event_id, lots, images, warned, dom, outage``."""
    e = F.col("event_type")
    return events(spark, sf_dir).select(F.col("user_id").alias("house"), "ts", "event_id", F.when(e == "error", 0).otherwise(F.col("k") % 40).alias("lots"), (F.col("value") / 2).alias("images"), (e == "purchase").alias("warned"), (e == "signup").alias("dom"), ((e == "error") & (F.col("k") % 4 == 0)).alias("outage"))


@query("w19_circuits", rf"""
WITH RECURSIVE {EVENTS}, {_RUNS},
r AS (
  SELECT house, 0::BIGINT AS n, 100 AS health, 'closed' AS circuit, 0.0::DOUBLE AS fails, NULL::TIMESTAMP AS ok_at, NULL::TIMESTAMP AS opened, []::INT[] AS last, 0 AS usual, NULL::TIMESTAMP AS ts FROM runs WHERE n = 1
  UNION ALL
  SELECT house, n, CASE WHEN skip THEN health ELSE new_health END, CASE WHEN skip THEN circuit WHEN new_health <= {circuits.OPEN} THEN CASE WHEN opened IS NOT NULL AND ts - opened >= INTERVAL 24 HOUR THEN 'half-open' ELSE 'open' END WHEN new_health <= {circuits.HALF} THEN 'half-open' ELSE 'closed' END,
    CASE WHEN skip THEN fails ELSE new_fails END, CASE WHEN skip THEN ok_at ELSE new_ok END, CASE WHEN skip THEN opened WHEN new_health <= {circuits.OPEN} THEN coalesce(opened, ts) END,
    CASE WHEN skip THEN last ELSE new_last END, CASE WHEN skip OR lots = 0 THEN usual ELSE floor(list_avg(list_filter(new_last, lambda x: x > 0)) + 0.5)::INT END, ts
  FROM (SELECT *, greatest(0, least(100, floor(base - least(new_fails * 15, 45) - CASE WHEN new_ok IS NULL THEN 0 ELSE least(floor(epoch(ts - new_ok) / 86400)::INT * 5, 25) END + 0.5)::INT)) AS new_health
    FROM (SELECT r.house, s.n, s.ts, s.lots, r.health, r.circuit, r.fails, r.ok_at, r.opened, r.last, r.usual, s.outage AND s.lots = 0 AS skip,
      50 + CASE WHEN r.usual > 5 THEN CASE WHEN s.lots >= 0.8::DOUBLE * r.usual THEN 30 WHEN s.lots >= 0.5::DOUBLE * r.usual THEN 15 WHEN s.lots >= 0.2::DOUBLE * r.usual THEN -10 ELSE -30 END WHEN s.lots > 0 THEN 20 ELSE 0 END
        + CASE WHEN s.images >= 70 THEN 20 WHEN s.images >= 40 THEN 10 WHEN s.images >= 10 THEN 0 ELSE -10 END + CASE WHEN s.dom THEN 20 ELSE 10 END AS base,
      CASE WHEN s.lots = 0 THEN r.fails + 1 WHEN s.warned THEN r.fails + 0.5::DOUBLE ELSE 0 END AS new_fails, CASE WHEN s.lots > 0 AND NOT s.warned THEN s.ts ELSE r.ok_at END AS new_ok,
      list_append(r.last, s.lots::INT)[greatest(len(r.last) + 1 - 4, 1):] AS new_last FROM r JOIN runs s ON s.house = r.house AND s.n = r.n + 1)))
SELECT house, n AS runs, health, circuit, fails FROM r WHERE n > 0""")
def circuit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health and circuit of each house after each of its runs; the state is small and follows the order of the runs."""
    return circuits.circuits(runs(spark, sf_dir)).select("house", "runs", "health", "circuit", "fails")


@query("w21_budgeted_picks", """
WITH e AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'force' WHEN 1 THEN 'recheck' WHEN 2 THEN 'recheck' WHEN 3 THEN 'odd' ELSE 'dark' END AS bucket, c_custkey % 13 = 0 AS vip, c_nationkey % 5 AS age FROM customer WHERE c_acctbal > 0),
o AS (SELECT *, CASE WHEN bucket = 'force' THEN 0 ELSE 1 END AS f, CASE WHEN bucket = 'recheck' THEN 'recheck' WHEN bucket = 'force' THEN 'force' ELSE 'dark' END AS purse FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY purse ORDER BY f, age, NOT vip, id) AS place FROM o),
b AS (SELECT *, purse = 'force' OR place <= CASE purse WHEN 'dark' THEN 12 ELSE 8 END AS paid FROM r),
v AS (SELECT *, count(*) FILTER (NOT paid AND vip) OVER (ORDER BY f, age, NOT vip, id) AS extra FROM b),
c AS (SELECT *, row_number() OVER (ORDER BY f, age, NOT vip, id) AS nth FROM v WHERE paid OR (vip AND extra <= 5))
SELECT id, purse, paid FROM c WHERE nth <= 40""")
def budgeted_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forced rows, then the oldest of each purse up to its budget, with a few important ones beyond; 40 in all.

    Every rank has a literal bound, so each task keeps the few first rows that may be picked.
    """
    k, c = F.col("c_custkey"), F.col
    bucket = F.when(k % 7 == 0, "force").when((k % 7).isin(1, 2), "recheck").when(k % 7 == 3, "odd").otherwise("dark")
    rows = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(k.alias("id"), bucket.alias("bucket"), (k % 13 == 0).alias("vip"), (c("c_nationkey") % 5).alias("age"))
    rows = rows.select("id", "vip", "age", F.when(c("bucket") == "force", 0).otherwise(1).alias("f"), F.when(c("bucket").isin("recheck", "force"), c("bucket")).otherwise("dark").alias("purse"))
    order = ["f", "age", ~c("vip"), "id"]
    parts = [rows.where(c("purse") == p).orderBy(*order).limit(n).withColumn("paid", F.lit(True)) for p, n in (("force", 40), ("dark", 12), ("recheck", 8))]
    paid = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # at most 20 rows of a purse come before an important one that isn't paid
    extra = rows.where("vip AND f = 1").orderBy(*order).limit(12 + 8 + 5).join(F.broadcast(paid.select("id")), "id", "left_anti").orderBy(*order).limit(5).withColumn("paid", F.lit(False))
    return paid.unionByName(extra).orderBy(*order).limit(40).select("id", "purse", "paid")


_ALERTS = "al AS (SELECT user_id % 6 AS house, event_id % 2 AS kind, event_id, ts FROM events WHERE event_type = 'error')"


@query("w22_escalated_alerts", f"""
WITH RECURSIVE {_ALERTS}, a AS (SELECT *, row_number() OVER (PARTITION BY house, kind ORDER BY ts, event_id) AS n FROM al),
r AS (SELECT house, kind, n, event_id, ts, ts AS fired, ts AS first, 1 AS fires, true AS sent, false AS escalated FROM a WHERE n = 1
  UNION ALL SELECT a.house, a.kind, a.n, a.event_id, a.ts, CASE WHEN a.ts - r.fired < INTERVAL 6 HOUR THEN r.fired ELSE a.ts END, r.first, r.fires + CASE WHEN a.ts - r.fired < INTERVAL 6 HOUR THEN 0 ELSE 1 END, a.ts - r.fired >= INTERVAL 6 HOUR,
    a.ts - r.fired >= INTERVAL 6 HOUR AND r.fires + 1 >= 3 AND a.ts - r.first <= INTERVAL 72 HOUR FROM r JOIN a ON a.house = r.house AND a.kind = r.kind AND a.n = r.n + 1)
SELECT event_id, sent, escalated FROM r""")
def escalated_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert within six hours of the last one sent is held back; the third sent in three days is escalated."""
    rows = load(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("user_id") % 6).alias("house"), (F.col("event_id") % 2).alias("kind"), "event_id", "ts")
    return circuits.alerts(rows).select("event_id", "sent", "escalated")


@query("r03_sessions", "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS n FROM s GROUP BY user_id, s")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = load(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("until"), "n")


@query("r04_deduped_alerts", f"""
WITH RECURSIVE {_ALERTS}, a AS (SELECT *, row_number() OVER (PARTITION BY house, kind ORDER BY ts, event_id) AS n FROM al),
r AS (SELECT house, kind, n, event_id, ts AS fired, true AS sent FROM a WHERE n = 1 UNION ALL SELECT a.house, a.kind, a.n, a.event_id, CASE WHEN a.ts - r.fired < INTERVAL 6 HOUR THEN r.fired ELSE a.ts END, a.ts - r.fired >= INTERVAL 6 HOUR FROM r JOIN a ON a.house = r.house AND a.kind = r.kind AND a.n = r.n + 1)
SELECT house, kind, count(*) AS raised, count(*) FILTER (sent) AS sent FROM r GROUP BY 1, 2""")
def deduped_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("user_id") % 6).alias("house"), (F.col("event_id") % 2).alias("kind"), "event_id", "ts")
    return circuits.alerts(rows).groupBy("house", "kind").agg(F.count("*").alias("raised"), F.count_if("sent").alias("sent"))


@query("r06_retry_queue", f"""
WITH {EVENTS}, l AS (SELECT k AS job, event_type, ts, event_id, max(ts) FILTER (event_type = 'purchase') OVER (PARTITION BY k) AS done FROM ev),
q AS (SELECT job, count(*) FILTER (event_type = 'error' AND (done IS NULL OR ts > done)) AS attempts, max(ts) FILTER (event_type = 'error' AND (done IS NULL OR ts > done)) AS failed FROM l GROUP BY 1)
SELECT job, attempts, CASE WHEN attempts >= 5 THEN 'given up' ELSE 'waiting' END AS state, CASE WHEN attempts < 5 THEN failed + to_hours(least(pow(2, attempts - 1), 24)::INT) END AS next_at FROM q WHERE attempts > 0""")
def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that failed since they last succeeded, with their wait; the fifth failure ends it."""
    from ..streaming.changes import backoff_hours

    rows = events(spark, sf_dir).select(F.col("k").alias("job"), "event_type", "ts")
    done = rows.where("event_type = 'purchase'").groupBy("job").agg(F.max("ts").alias("done"))
    failed = rows.where("event_type = 'error'").join(done, "job", "left").where("done IS NULL OR ts > done")
    q = failed.groupBy("job").agg(F.count("*").alias("attempts"), F.max("ts").alias("failed"))
    wait = F.make_dt_interval(hours=backoff_hours(F.col("attempts")).cast("int"))
    return q.select("job", "attempts", F.when(F.col("attempts") >= 5, "given up").otherwise("waiting").alias("state"), F.when(F.col("attempts") < 5, F.col("failed") + wait).alias("next_at"))


@query("r11_late_rows", """
WITH s AS (SELECT event_id, ts, user_id % 9 = 0 AS slow, ts + CASE WHEN user_id % 9 = 0 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END AS arrived FROM events),
m AS (SELECT *, max(ts) OVER (ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM s)
SELECT event_id, ts FROM m WHERE ts < high - INTERVAL 1 HOUR""")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrive when a watermark of an hour has passed them.

    The highest time before a row is that of the earlier days or of its own day before it, so no
    task has more than a day's rows.
    """
    ts = F.col("ts")
    rows = load(spark, sf_dir, "events").select("event_id", "ts", (ts + F.when(F.col("user_id") % 9 == 0, F.expr("INTERVAL 3 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))).alias("arrived")).withColumn("day", F.to_date("arrived"))
    # a row for each day
    days = rows.groupBy("day").agg(F.max("ts").alias("m")).withColumn("before", F.max("m").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("day", "before")
    own = F.max("ts").over(Window.partitionBy("day").orderBy("arrived", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    high = rows.withColumn("own", own).join(days, "day").withColumn("high", F.greatest("own", "before"))
    return high.where(ts < F.col("high") - F.expr("INTERVAL 1 HOUR")).select("event_id", "ts")


@query("r11_late_batches", """
WITH s AS (SELECT event_id, ts, (ts + CASE WHEN user_id % 9 = 0 THEN INTERVAL 30 HOUR ELSE INTERVAL 0 HOUR END)::DATE AS batch FROM events),
h AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM s GROUP BY 1)
SELECT event_id, batch, coalesce(ts < high - INTERVAL 6 HOUR, false) AS late FROM s JOIN h USING (batch)""")
def late_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its side, where a batch is a day's arrivals: the batch form of the stream with two sinks."""
    slow = F.when(F.col("user_id") % 9 == 0, F.expr("INTERVAL 30 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    rows = load(spark, sf_dir, "events").select("event_id", "ts", F.to_date(F.col("ts") + slow).alias("batch"))
    return late_by_batch(rows, "batch", "6 HOURS").select("event_id", "batch", "late")


@query("m15_house_classes", f"""
WITH {LISTINGS}, g AS (SELECT owner, count(*) FILTER (deal_type = '5-LOW') > 0 AS rolling, count(*) FILTER (status <> 'sold' AND deal_type <> '5-LOW') AS dated, count(*) FILTER (status <> 'sold' AND deal_type <> '5-LOW' AND sale_date >= DATE '2001-06-01') AS upcoming FROM listings GROUP BY 1),
h AS (SELECT *, owner % 23 = 0 AS retired, owner % 11 = 0 AS configured, owner % 7 = 0 AS listed_root, owner % 5 = 0 AS next_day, owner % 10 = 0 AS next_moved FROM g)
SELECT owner, CASE WHEN retired THEN 'retired' WHEN configured OR dated > 0 OR next_moved OR (next_day AND rolling) THEN 'rotating' WHEN rolling THEN 'rolling' WHEN NOT listed_root THEN 'static' ELSE 'unknown' END AS class,
  CASE WHEN retired THEN 'retired' WHEN configured THEN 'configured' WHEN upcoming > 0 THEN 'upcoming sale' WHEN dated > 0 THEN 'dated history' WHEN next_moved THEN 'next date moved' WHEN next_day AND rolling THEN 'next date shown' WHEN rolling AND listed_root THEN 'rolling root' WHEN rolling THEN 'no dates' WHEN NOT listed_root THEN 'static root' ELSE 'unclassified' END AS reason FROM h""")
def house_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a source sells, by the first rule that fits, with its reason."""
    open_ = (F.col("status") != "sold") & (F.col("deal_type") != "5-LOW")
    g = listings(spark, sf_dir).groupBy("owner").agg((F.count_if(F.col("deal_type") == "5-LOW") > 0).alias("rolling"), F.count_if(open_).alias("dated"), F.count_if(open_ & (F.col("sale_date") >= F.lit("2001-06-01").cast("date"))).alias("upcoming"))
    of = lambda n: F.col("owner") % n == 0
    rules = [
        (of(23), "retired", "retired"),
        (of(11), "rotating", "configured"),
        (F.col("upcoming") > 0, "rotating", "upcoming sale"),
        (F.col("dated") > 0, "rotating", "dated history"),
        (of(10), "rotating", "next date moved"),
        (of(5) & F.col("rolling"), "rotating", "next date shown"),
        (F.col("rolling") & of(7), "rolling", "rolling root"),
        (F.col("rolling"), "rolling", "no dates"),
        (~of(7), "static", "static root"),
    ]
    verdict = F.coalesce(*[F.when(when, F.struct(F.lit(c).alias("class"), F.lit(r).alias("reason"))) for when, c, r in rules], F.struct(F.lit("unknown").alias("class"), F.lit("unclassified").alias("reason")))
    return g.select("owner", verdict.alias("v")).select("owner", "v.*")


@query("m21_engine_choice", f"""
WITH {EVENTS}, h AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS fails, count(*) AS n, max(k) AS k FROM ev GROUP BY 1)
SELECT user_id, CASE WHEN user_id % 17 = 0 THEN 'pinned' WHEN user_id % 5 = 0 THEN 'api' WHEN fails * 2 > n THEN 'browser' WHEN k > 98 THEN 'render' WHEN n < 5 THEN 'fetch-once' ELSE 'fetch' END AS engine FROM h""")
def engine_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("fails"), F.count("*").alias("n"), F.max("k").alias("k"))
    u = F.col("user_id")
    return h.select("user_id", F.when(u % 17 == 0, "pinned").when(u % 5 == 0, "api").when(F.col("fails") * 2 > F.col("n"), "browser").when(F.col("k") > 98, "render").when(F.col("n") < 5, "fetch-once").otherwise("fetch").alias("engine"))


def region_of(code: Column, address: Column) -> Column:
    """The region of a postcode's area, else the first one that the address names, else other."""
    area = T.area(code)
    own = F.coalesce(*[F.when(area.isin(areas), F.lit(r)) for r, areas in T.REGIONS.items()])
    named = F.coalesce(*[F.when(F.lower(address).rlike(rf"\b{r}\b"), F.lit(r)) for r in T.REGIONS])
    return F.coalesce(own, named, F.lit("other"))


_AREA = "regexp_extract(code, '^([A-Z]{1,2})[0-9]', 1)"


@query("m22_regions", f"""
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN ['BD1 1AA', 'SW1A 1AA', 'EH1 1AA', 'B7 1AA', 'ZZ9 9ZZ'][c_custkey % 5 + 1] END AS code, ['1 Dock St, Hull, Yorkshire', 'The Mill, Wales', 'Nowhere'][c_custkey % 4 + 1] AS address FROM customer)
SELECT c_custkey, coalesce(CASE {' '.join(f"WHEN {_AREA} IN ({', '.join(repr(a) for a in areas)}) THEN '{r}'" for r, areas in T.REGIONS.items())} END, CASE {' '.join(f"WHEN regexp_matches(lower(address), '{chr(92)}b{r}{chr(92)}b') THEN '{r}'" for r in T.REGIONS)} END, 'other') AS region FROM p""")
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    at = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    code = F.when(k % 3 != 0, at(["BD1 1AA", "SW1A 1AA", "EH1 1AA", "B7 1AA", "ZZ9 9ZZ"], k % 5))
    address = at(["1 Dock St, Hull, Yorkshire", "The Mill, Wales", "Nowhere"], k % 4)
    return load(spark, sf_dir, "customer").select("c_custkey", region_of(code, address).alias("region"))


#: Searches as people write them, one for each saved filter of the matcher.
SAVED = [
    {"search": 0, "min_price": 60_000, "max_price": 200_000, "beds": 3, "tenure": "Freehold"},
    {"search": 1, "type": "FLAT", "max_price": 400_000, "location": "hmo"},
    {"search": 2, "exclude_poa": True, "status": "available", "postcode": "ls 1"},
    {"search": 3, "condition": "work", "deal": "refurb"},
    {"search": 4, "town": "leeds", "beds": 1},
    {"search": 5, "tenure": "leasehold", "postcode": "BS", "status": "sold"},
]
_CODES = ["LS1 1AA", "BS6 5RT", "LS12 3AB", None]


def matchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Told listings with ``address, postcode, condition, deal, status``."""
    k = F.col("id")
    at = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    return told(spark, sf_dir).withColumns({"address": at(["1 Mill Lane, Leeds", "2 Quay, Bristol", "3 Dock St, Hull"], k % 3), "postcode": at(_CODES, k % 4), "condition": at(["needs work", "good", None], k % 5), "deal": at(["Refurb", "Refurb+Extend", "Standard"], k % 3), "status": at(["available", "sold", "stc", None], k % 6)})


def matches(f: dict) -> Column:
    """A saved filter over a listing: an unknown value never matches a bound; types, states and deals match in part."""
    c = F.col
    part = lambda col, want: F.lower(F.coalesce(c(col), F.lit(""))).contains(want.lower())
    tight = lambda x: F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", ""))
    tests = [F.lit(True)]
    tests += [c("price") >= f["min_price"]] if "min_price" in f else []
    tests += [c("price") <= f["max_price"]] if "max_price" in f else []
    tests += [F.coalesce(c("price"), F.lit(0)) != 0] if f.get("exclude_poa") else []
    tests += [c("beds") >= f["beds"]] if "beds" in f else []
    tests += [part(col, f[name]) for name, col in (("type", "kind"), ("condition", "condition"), ("deal", "deal"), ("town", "address")) if f.get(name)]
    tests += [F.coalesce(c("status"), F.lit("available")) == f["status"]] if f.get("status") else []
    tests += [F.lower(F.coalesce(c("tenure"), F.lit(""))) == f["tenure"].lower()] if f.get("tenure") else []
    tests += [part("address", f["location"]) | part("t", f["location"])] if f.get("location") else []
    tests += [tight(c("postcode")).startswith(f["postcode"].upper().replace(" ", ""))] if f.get("postcode") else []
    out = tests[0]
    for t in tests[1:]:
        out = out & F.coalesce(t, F.lit(False))
    return out


_MATCHABLE = f"""{TOLD}, m AS (SELECT *, ['1 Mill Lane, Leeds', '2 Quay, Bristol', '3 Dock St, Hull'][id % 3 + 1] AS address, ['LS1 1AA', 'BS6 5RT', 'LS12 3AB', NULL][id % 4 + 1] AS postcode, ['needs work', 'good', NULL][id % 5 + 1] AS condition, ['Refurb', 'Refurb+Extend', 'Standard'][id % 3 + 1] AS deal, ['available', 'sold', 'stc', NULL][id % 6 + 1] AS status FROM told)"""


@query("f14_all_saved_filters", f"""
WITH {_MATCHABLE} SELECT 0 AS search, id FROM m WHERE price BETWEEN 60000 AND 200000 AND beds >= 3 AND tenure = 'Freehold' UNION ALL SELECT 1, id FROM m WHERE kind LIKE '%flat%' AND price <= 400000 AND (contains(lower(address), 'hmo') OR contains(t, 'hmo'))
UNION ALL SELECT 2, id FROM m WHERE price > 0 AND coalesce(status, 'available') = 'available' AND replace(postcode, ' ', '') LIKE 'LS1%' UNION ALL SELECT 3, id FROM m WHERE condition LIKE '%work%' AND lower(deal) LIKE '%refurb%'
UNION ALL SELECT 4, id FROM m WHERE lower(address) LIKE '%leeds%' AND beds >= 1 UNION ALL SELECT 5, id FROM m WHERE tenure = 'Leasehold' AND postcode LIKE 'BS%' AND status = 'sold'""")
def all_saved_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every saved filter in one pass over the listings: a row tells which of them it meets."""
    hit = F.array_compact(F.array(*[F.when(matches(f), F.lit(f["search"])) for f in SAVED]))
    return matchable(spark, sf_dir).select(F.explode(hit).alias("search"), "id")


#: What the suppliers have stored, as expressions that Spark and DuckDB both read.
STORED = {
    "minPrice": "CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 7 * 40000 AS STRING) END",
    "maxPrice": "CASE WHEN s_suppkey % 4 <> 1 THEN CAST(s_suppkey % 7 * 40000 + 60000 AS STRING) || ' GBP' WHEN s_suppkey % 8 = 1 THEN '' END",
    "excludePOA": "CASE WHEN s_suppkey % 3 = 1 THEN 'yes' ELSE 'no' END",
    "beds": "CASE WHEN s_suppkey % 5 = 2 THEN CAST(s_suppkey % 6 AS STRING) || '+' WHEN s_suppkey % 5 = 3 THEN 'any' END",
    "type": "CASE s_suppkey % 9 WHEN 1 THEN 'FLAT' WHEN 2 THEN 'house' WHEN 5 THEN 'e' END",
    "status": "CASE s_suppkey % 11 WHEN 1 THEN 'available' WHEN 2 THEN 'sold' WHEN 3 THEN 'stc' WHEN 4 THEN 'unsold' WHEN 5 THEN 'all' WHEN 6 THEN 'recently_unsold' END",
    "tenure": "CASE s_suppkey % 8 WHEN 1 THEN 'FREEHOLD' WHEN 2 THEN 'leasehold' END",
    "location": "CASE s_suppkey % 10 WHEN 2 THEN 'HMO' WHEN 3 THEN 'mill lane' WHEN 4 THEN 'of' END",
    "town": "CASE s_suppkey % 6 WHEN 1 THEN ' Leeds ' WHEN 3 THEN 'bristol' WHEN 4 THEN 'nowhere' WHEN 5 THEN '  ' END",
    "postcode": "CASE s_suppkey % 5 WHEN 1 THEN 'ls 1' WHEN 2 THEN 'bs' WHEN 3 THEN 'LS12 3AB' END",
    "condition": "CASE s_suppkey % 7 WHEN 1 THEN 'Work' WHEN 2 THEN 'good' END",
    "deal": "CASE s_suppkey % 13 WHEN 1 THEN 'REFURB' WHEN 2 THEN 'extend' END",
}
_BOUND = lambda c: f"TRY_CAST(nullif(regexp_extract({c}, '^[+-]?[0-9]+'), '') AS BIGINT)"
_PART = lambda want, text: f"({want} IS NULL OR {want} = '' OR contains(lower({text}), lower({want})))"


@query("j10_saved_search_index", f"""
WITH {_MATCHABLE}, f AS (SELECT s_suppkey AS search_id, {", ".join(f'{e} AS f_{c.lower()}' for c, e in STORED.items())} FROM supplier),
n AS (SELECT *, {_BOUND('f_minprice')} AS low, {_BOUND('f_maxprice')} AS high, {_BOUND('f_beds')} AS rooms FROM f)
SELECT search_id, id FROM n JOIN m ON (low IS NULL OR price >= low) AND (high IS NULL OR price <= high) AND (f_excludepoa <> 'yes' OR coalesce(price, 0) <> 0) AND (rooms IS NULL OR beds >= rooms)
  AND (f_status IS NULL OR f_status IN ('all', 'recently_unsold') OR (f_status = 'unsold' AND status IN ('unsold', 'no_bid', 'not_sold')) OR (f_status = 'stc' AND status IN ('stc', 'sale_agreed')) OR (f_status IN ('available', 'sold') AND coalesce(status, 'available') = f_status))
  AND (f_tenure IS NULL OR lower(tenure) = lower(f_tenure)) AND (trim(f_town) IS NULL OR trim(f_town) = '' OR contains(lower(address), lower(trim(f_town))))
  AND (f_postcode IS NULL OR starts_with(replace(postcode, ' ', ''), upper(replace(f_postcode, ' ', ''))))
  AND {_PART('f_location', "coalesce(address, '') || ' ' || coalesce(t, '')")} AND {_PART('f_type', "coalesce(kind, '')")} AND {_PART('f_condition', "coalesce(condition, '')")} AND {_PART('f_deal', "coalesce(deal, '')")}""")
def saved_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON filters of twelve fields against all listings: found by their rarest condition, or in blocks if that has many."""
    filters = F.to_json(F.struct(*(F.expr(e).alias(c) for c, e in STORED.items())))
    searches = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("search_id"), filters.alias("filters"))
    return saved.matched(searches, matchable(spark, sf_dir))


#: What each concept of a search looks for, any of its signals being enough.
CONCEPT_SQL = {
    "multi_unit_freehold": "units > 1 OR split OR contains(t, 'flats') OR contains(t, 'apartments') OR contains(t, 'block') OR contains(t, 'units') OR kind = 'flat'",
    "title_split_potential": "split OR units > 1 OR contains(t, 'title split') OR contains(t, 'flats') OR contains(t, 'block')",
    "hmo_conversion": "contains(t, 'hmo') OR beds >= 4 OR contains(t, 'conversion')",
    "development": "contains(t, 'development') OR contains(t, 'planning') OR kind = 'land'",
    "flip": "state IN ('needs work', 'poor') OR contains(t, 'modernisation') OR contains(t, 'refurb')",
    "buy_to_let": "contains(t, 'tenant') OR contains(t, 'rental') OR contains(t, 'let')",
    "deal_stack": "split OR state IN ('needs work', 'poor')",
}


def _concepts_sql() -> str:
    from ..functions import signals as S
    from .deals import _HIT, _SIGNALS

    state = f"CASE WHEN {_HIT(T.POOR)} THEN 'poor' WHEN {_HIT(S.NEEDS_WORK)} THEN 'needs work' WHEN {_HIT(S.GOOD_ORDER)} THEN 'good' END"
    each = ", ".join(f"CASE WHEN {w} THEN '{c}' END" for c, w in CONCEPT_SQL.items())
    return f"WITH {TOLD},{_SIGNALS}, x AS (SELECT *, {state} AS state FROM sig), e AS (SELECT id, unnest(list_filter([{each}], lambda x: x IS NOT NULL)) AS concept FROM x) SELECT concept, id FROM e"


@query("f17_concepts", _concepts_sql())
def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import signals as S

    rows = S.scored(S.signalled(told(spark, sf_dir)))
    hit = F.array_compact(F.array(*[F.when(F.expr(w), F.lit(c)) for c, w in CONCEPT_SQL.items()]))
    return rows.select(F.explode(hit).alias("concept"), "id")


#: Searches in words, and what they ask for in SQL.
ASKED = {
    "3 bed freehold house under 250k in yorkshire": "price IS NULL OR price <= 250000) AND (beds >= 3) AND (kind = 'house') AND (tenure = 'Freehold') AND (area IN ('BD', 'DN', 'HD', 'HG', 'HU', 'HX', 'LS', 'S', 'WF', 'YO')",
    "flats between 100k and £300,000": "price IS NULL OR price BETWEEN 100000 AND 300000) AND (kind = 'flat'",
    "vacant land over 0.2m": "price IS NULL OR price >= 200000) AND (kind = 'land') AND (contains(t, 'vacant')",
    "leasehold probate": "tenure = 'Leasehold') AND (contains(t, 'executor') OR contains(t, 'probate') OR contains(t, 'receiver')",
}


@query("f30_asked_in_words", f"WITH {_MATCHABLE}, n AS (SELECT *, regexp_extract(postcode, '^([A-Z]{{1,2}})[0-9]', 1) AS area FROM m) " + " UNION ALL ".join(f"SELECT '{q}' AS asked, id FROM n WHERE ({w})" for q, w in ASKED.items()))
def asked_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each search is parsed to a specification and compiled to one filter; all are tested in one pass."""
    rows = matchable(spark, sf_dir).withColumns({"area": T.area(F.col("postcode")), "narrative": F.col("t")})
    hit = []
    for q in ASKED:
        every = F.lit(True)
        for part in search.conditions(search.parse(q)).values():
            every = every & part
        hit.append(F.when(every, F.lit(q)))
    return rows.select(F.explode(F.array_compact(F.array(*hit))).alias("asked"), "id")


@query("r07_adaptive_schedule", """
WITH l AS (SELECT user_id, event_type, ts, row_number() OVER w AS back, first_value(event_type) OVER w AS lt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)),
r AS (SELECT user_id, any_value(lt) AS lt, coalesce(min(back) FILTER (event_type <> lt) - 1, count(*)) AS run, max(ts) AS last FROM l GROUP BY 1)
SELECT user_id, run, CASE WHEN lt = 'error' AND run >= 2 THEN 'open' ELSE 'closed' END AS circuit, last + to_hours(CASE WHEN lt = 'error' AND run >= 2 THEN 24 ELSE least(pow(2, run - 1), 24)::INT END) AS due FROM r""")
def adaptive_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a source is due: twice as late for each like result in a row, a day where its failures open the circuit."""
    from ..streaming.changes import backoff_hours

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.row_number().over(w).alias("back"), F.first("event_type").over(w).alias("latest"))
    other = F.min(F.when(F.col("event_type") != F.col("latest"), F.col("back"))) - 1
    per = rows.groupBy("user_id").agg(F.max("latest").alias("latest"), F.coalesce(other, F.count("*")).alias("run"), F.max("ts").alias("last"))
    open_ = (F.col("latest") == "error") & (F.col("run") >= 2)
    hours = F.when(open_, 24).otherwise(backoff_hours(F.col("run")).cast("int"))
    return per.select("user_id", "run", F.when(open_, "open").otherwise("closed").alias("circuit"), (F.col("last") + F.make_dt_interval(hours=hours)).alias("due"))
