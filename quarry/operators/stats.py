"""Order statistics, quorums, backtests and product analytics.

Floor-index percentiles rank rows of a group once; every statistic of the group reads that rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import EVENTS, LISTINGS, ORDERS_TODAY, SALES, events, listings, load, sales
from .windows import with_totals


def ranked(df: DataFrame, keys: list[str], value: str, *ties: str) -> DataFrame:
    """Adds ``i`` (place from 0 by value) and ``n`` (rows of the group)."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"i": F.row_number().over(w.orderBy(value, *ties)) - 1, "n": F.count("*").over(w)})


#: Values that share a bin of the first pass of ``at_places``.
WIDTH = 1024


def at_places(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """``keys, n`` and the whole-number values at some places (columns over ``n``, from 0) of each group, exactly.

    Nothing is sorted: counts of bins, combined in each task, tell the bin of each place, and the
    rows of those bins alone are counted by value. A place outside the group gives null.
    """
    binned = df.select(*keys, F.col(value).alias("_v"), F.floor(F.col(value) / WIDTH).alias("_bin"))
    whole = Window.partitionBy(*keys)
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    bins = bins.withColumns({"n": F.sum("_n").over(whole), "_before": before("_n", whole.orderBy("_bin"))})
    wanted = bins.select(*keys, "n", "_bin", "_n", "_before", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), p.cast("bigint").alias("p")) for k, p in places.items()])).alias("w"))
    wanted = wanted.where((F.col("w.p") >= F.col("_before")) & (F.col("w.p") < F.col("_before") + F.col("_n"))).select(*keys, "n", "_bin", F.col("w.k").alias("_k"), (F.col("w.p") - F.col("_before")).alias("_at"))
    inner = binned.join(wanted.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi").groupBy(*keys, "_bin", "_v").agg(F.count("*").alias("_c"))
    inner = inner.withColumn("_ahead", before("_c", Window.partitionBy(*keys, "_bin").orderBy("_v")))
    found = wanted.join(inner, [*keys, "_bin"]).where((F.col("_at") >= F.col("_ahead")) & (F.col("_at") < F.col("_ahead") + F.col("_c")))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(k) for k in places])


def at_share(p: float, value: str = "pence") -> Column:
    """The value at place floor(n p)."""
    return F.max(F.when(F.col("i") == F.floor(F.col("n") * F.lit(p)), F.col(value)))


@query("a32_order_statistics", f"""
WITH {SALES}, r AS (SELECT district, pence, row_number() OVER (PARTITION BY district ORDER BY pence, sale_id, line) - 1 AS i, count(*) OVER (PARTITION BY district) AS n FROM sales)
SELECT district, any_value(n) AS n, max(pence) FILTER (i = floor(n * 0.25)) AS p25, max(pence) FILTER (i = floor(n * 0.75)) AS p75, min(pence) AS low, max(pence) AS high,
  CASE WHEN any_value(n) % 2 = 1 THEN max(pence) FILTER (i = n // 2) ELSE floor((max(pence) FILTER (i = n // 2) + max(pence) FILTER (i = n // 2 - 1)) / 2.0 + 0.5)::BIGINT END AS median FROM r GROUP BY district""")
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    half = F.floor(n / 2)
    r = at_places(sales(spark, sf_dir), ["district"], "pence", {"p25": F.floor(n * 0.25), "p75": F.floor(n * 0.75), "low": F.lit(0), "high": n - 1, "upper": half, "lower": half - 1})
    middle = F.when(n % 2 == 1, F.col("upper")).otherwise(F.floor((F.col("upper") + F.col("lower")) / 2 + 0.5).cast("bigint"))
    return r.select("district", "n", "p25", "p75", "low", "high", middle.alias("median"))


@query("a33_median", f"WITH {SALES} SELECT kind, median(pence) AS median FROM sales GROUP BY kind")
def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    r = at_places(sales(spark, sf_dir), ["kind"], "pence", {"upper": F.floor(n / 2), "lower": F.floor((n - 1) / 2)})
    return r.select("kind", ((F.col("upper") + F.col("lower")) / 2).alias("median"))


@query("a34_yield_band", f"""
WITH {SALES}, r AS (SELECT postcode, pence, row_number() OVER (PARTITION BY postcode ORDER BY pence, sale_id, line) - 1 AS i, count(*) OVER (PARTITION BY postcode) AS n FROM sales)
SELECT postcode, max(pence) FILTER (i = floor(n * 0.25)) * 1200::DOUBLE / 10000000 AS low, max(pence) FILTER (i = floor(n * 0.75)) * 1200::DOUBLE / 10000000 AS high FROM r GROUP BY postcode HAVING any_value(n) >= 3""")
def yield_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked(sales(spark, sf_dir), ["postcode"], "pence", "sale_id", "line").where("n >= 3")
    return r.groupBy("postcode").agg((at_share(0.25) * F.lit(1200.0) / 10000000).alias("low"), (at_share(0.75) * F.lit(1200.0) / 10000000).alias("high"))


@query("a35_trimmed_mean", f"""
WITH {SALES}, s AS (SELECT *, count(*) FILTER (line <= 2) OVER (PARTITION BY postcode) AS typed FROM sales), u AS (SELECT * FROM s WHERE line <= 2 OR typed < 2),
r AS (SELECT postcode, pence, row_number() OVER (PARTITION BY postcode ORDER BY pence, sale_id, line) - 1 AS i, count(*) OVER (PARTITION BY postcode) AS n FROM u),
q AS (SELECT postcode, any_value(n) AS n, max(pence) FILTER (i = floor(n * 0.25)) AS a, max(pence) FILTER (i = floor(n * 0.75)) AS b FROM r GROUP BY postcode),
t AS (SELECT r.postcode, count(*) AS n, count(*) FILTER (pence * 2 BETWEEN a * 2 - 3 * (b - a) AND b * 2 + 3 * (b - a)) AS m, sum(pence) AS sn, sum(pence) FILTER (pence * 2 BETWEEN a * 2 - 3 * (b - a) AND b * 2 + 3 * (b - a)) AS sm FROM r JOIN q ON q.postcode = r.postcode GROUP BY r.postcode)
SELECT postcode, CASE WHEN n >= 4 AND m >= 2 THEN sm::DOUBLE / m ELSE sn::DOUBLE / n END AS value, CASE WHEN n >= 4 AND m >= 2 THEN m ELSE n END AS used FROM t""")
def trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed sales if there are two, else all; outside 1.5 interquartile ranges go, if four or more leave two."""
    w = Window.partitionBy("postcode")
    own = F.col("line") <= 2
    used = sales(spark, sf_dir).withColumn("typed", F.count_if(own).over(w)).where(own | (F.col("typed") < 2))
    r = ranked(used, ["postcode"], "pence", "sale_id", "line")
    a, b = (F.max(F.when(F.col("i") == F.floor(F.col("n") * F.lit(p)), F.col("pence"))).over(w) for p in (0.25, 0.75))
    inside = (F.col("pence") * 2).between(F.col("a") * 2 - 3 * (F.col("b") - F.col("a")), F.col("b") * 2 + 3 * (F.col("b") - F.col("a")))
    t = r.withColumns({"a": a, "b": b}).groupBy("postcode").agg(F.count("*").alias("n"), F.count_if(inside).alias("m"), F.sum("pence").alias("sn"), F.sum(F.when(inside, F.col("pence"))).alias("sm"))
    trim = (F.col("n") >= 4) & (F.col("m") >= 2)
    return t.select("postcode", F.when(trim, F.try_divide(F.col("sm").cast("double"), F.col("m"))).otherwise(F.col("sn").cast("double") / F.col("n")).alias("value"), F.when(trim, F.col("m")).otherwise(F.col("n")).alias("used"))


@query("a36_recall_summary", f"""
WITH {EVENTS}, s AS (SELECT user_id, ts::DATE AS day, list(DISTINCT k) AS ks FROM ev GROUP BY 1, 2), r AS (SELECT user_id, ks, lag(ks) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM s),
x AS (SELECT user_id, len(list_intersect(ks, prev)) * 1000 // len(prev) AS permille FROM r WHERE prev IS NOT NULL)
SELECT user_id, count(*) AS n, sum(permille)::DOUBLE / count(*) AS mean, min(permille)::BIGINT AS low, max(permille)::BIGINT AS high, median(permille) AS median FROM x GROUP BY user_id""")
def recall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("k").alias("ks"))
    r = s.withColumn("prev", F.lag("ks").over(Window.partitionBy("user_id").orderBy("day"))).where("prev IS NOT NULL")
    x = r.select("user_id", F.expr("size(array_intersect(ks, prev)) * 1000 DIV size(prev)").alias("permille"))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), (F.sum("permille").cast("double") / F.count("*")).alias("mean"), F.min("permille").alias("low"), F.max("permille").alias("high"), F.median("permille").alias("median"))


@query("a40_majority_with_quorum", f"""
WITH {LISTINGS}, c AS (SELECT house, prop_type, count(*) AS n FROM listings GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY house)::BIGINT AS total FROM c)
SELECT house, prop_type AS value, n, total FROM t WHERE total >= 8 AND n * 100 >= 21 * total QUALIFY row_number() OVER (PARTITION BY house ORDER BY n DESC, prop_type) = 1""")
def majority_with_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = listings(spark, sf_dir).groupBy("house", F.col("prop_type").alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("house")
    t = c.withColumns({"total": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "value"))})
    return t.where("r = 1 AND total >= 8 AND n * 100 >= 21 * total").drop("r")


#: Dated rows that a consensus needs, the hundredths that its date has, years ahead that a date may lie.
QUORUM, MAJORITY, AHEAD = 8, 70, 2


def date_consensus(rows: DataFrame, today_: str) -> DataFrame:
    """``house, total, dated, majority_date, majority_count, reason`` of ``house, id, date``.

    Dates before the day or beyond the year after next don't count. Of equally frequent dates the one
    that came first (by id) is the majority. Groups are counted by date before they meet, so a large
    house is as many rows as it has dates in each task.
    """
    day = F.lit(today_).cast("date")
    near = F.col("date").between(day, F.make_date(F.year(day) + AHEAD, F.lit(12), F.lit(31)))
    per = rows.groupBy("house", F.when(near, F.col("date")).alias("date")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    # the most frequent date, then the earliest id
    best = F.max_by(F.struct("date", "n"), F.when(F.col("date").isNotNull(), F.struct("n", (-F.col("first")).alias("f"))))
    g = per.groupBy("house").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("date").isNotNull(), F.col("n")).otherwise(0)).alias("dated"), best.alias("b"))
    few = (F.col("total") < QUORUM) | (F.col("dated") < QUORUM)
    reason = F.when(few, "insufficient_lots").when(F.col("b.n") * 100 < F.col("dated") * MAJORITY, "no_majority").otherwise("majority")
    return g.select("house", "total", "dated", F.when(~few, F.col("b.date")).alias("majority_date"), F.when(few, F.lit(0).cast("bigint")).otherwise(F.col("b.n")).alias("majority_count"), reason.alias("reason"))


@query("a40_date_consensus", f"""
WITH r AS (SELECT o_custkey AS house, o_orderkey AS id, CASE WHEN o_orderkey % 10 < 7 THEN DATE '{ORDERS_TODAY}' + (o_custkey % 3 * 7)::INT WHEN o_orderkey % 10 = 8 THEN NULL WHEN o_orderkey % 10 = 9 THEN o_orderdate::DATE ELSE DATE '2098-01-01' END AS date FROM orders),
d AS (SELECT *, date BETWEEN DATE '{ORDERS_TODAY}' AND DATE '2003-12-31' AS near FROM r),
c AS (SELECT house, date, count(*) AS n, min(id) AS first FROM d WHERE near GROUP BY 1, 2),
b AS (SELECT house, date, n FROM c QUALIFY row_number() OVER (PARTITION BY house ORDER BY n DESC, first) = 1),
t AS (SELECT house, count(*) AS total, count(*) FILTER (near) AS dated FROM d GROUP BY 1)
SELECT house, total, dated, CASE WHEN dated >= 8 THEN date END AS majority_date, CASE WHEN dated >= 8 THEN n ELSE 0 END AS majority_count,
  CASE WHEN dated < 8 THEN 'insufficient_lots' WHEN n * 100 < dated * 70 THEN 'no_majority' ELSE 'majority' END AS reason FROM t LEFT JOIN b USING (house)""")
def date_consensus_of_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date that most of an owner's rows name; some rows have none, past or far ones."""
    k, day = F.col("o_orderkey") % 10, F.lit(ORDERS_TODAY).cast("date")
    date = F.when(k < 7, F.date_add(day, (F.col("o_custkey") % 3 * 7).cast("int"))).when(k == 9, F.to_date("o_orderdate")).when(k == 7, F.lit("2098-01-01").cast("date"))
    return date_consensus(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("house"), F.col("o_orderkey").alias("id"), date.alias("date")), ORDERS_TODAY)


@query("a42_bleed_lines", """
WITH l AS (SELECT DISTINCT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT source, line, count(*) AS docs FROM l WHERE length(trim(line)) >= 12 GROUP BY 1, 2 HAVING count(*) >= 3""")
def bleed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three or more documents of a source share; a document's own repeats count once."""
    lines = load(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.length(F.trim("line")) >= 12)
    return lines.groupBy("source", "line").agg(F.count("*").alias("docs")).where("docs >= 3")


@query("a44_building_sum", f"WITH {LISTINGS} SELECT id, owner, sum(price) OVER (PARTITION BY owner)::DOUBLE > 1500000 AS large FROM listings".replace("sum(price) OVER (PARTITION BY owner)::DOUBLE", "(sum(price) OVER (PARTITION BY owner))::DOUBLE"))
def building_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_totals(listings(spark, sf_dir).select("id", "owner", "price"), "owner", total=F.sum("price"))
    return rows.select("id", "owner", (F.col("total") > 1500000).alias("large"))


@query("a45_terminal_ratio", f"WITH {LISTINGS} SELECT house, count(*) FILTER (status = 'sold')::DOUBLE / count(*) > 0.48 AND count(*) >= 5 AS terminal, count(DISTINCT sale_date) AS dates FROM listings GROUP BY house")
def terminal_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).groupBy("house").agg(((F.count_if(F.col("status") == "sold").cast("double") / F.count("*") > 0.48) & (F.count("*") >= 5)).alias("terminal"), F.count_distinct("sale_date").alias("dates"))


@query("a46_catalogue_summary", f"WITH {LISTINGS} SELECT house, sale_date, count(*) AS lots, count(*) FILTER (price < 100000) AS cheap, count(*) FILTER (status = 'sold') AS sold FROM listings GROUP BY 1, 2")
def catalogue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).groupBy("house", "sale_date").agg(F.count("*").alias("lots"), F.count_if(F.col("price") < 100000).alias("cheap"), F.count_if(F.col("status") == "sold").alias("sold"))


@query("a47_facets", f"""
WITH {LISTINGS} SELECT CASE WHEN grouping(house) = 0 THEN 'house' WHEN grouping(prop_type) = 0 THEN 'type' ELSE 'deal' END AS facet, coalesce(house, prop_type, deal_type) AS value, count(*) AS n FROM listings GROUP BY GROUPING SETS ((house), (prop_type), (deal_type))""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(c).alias("value")) for k, c in (("house", "house"), ("type", "prop_type"), ("deal", "deal_type"))]))
    finest = listings(spark, sf_dir).groupBy("house", "prop_type", "deal_type").agg(F.count("*").alias("n"))
    return finest.select(pick.alias("f"), "n").groupBy("f.facet", "f.value").agg(F.sum("n").alias("n"))


@query("a49_backtest", f"""
WITH {SALES}, m AS (SELECT postcode, sum(pence)::DOUBLE / count(*) AS est, count(*) AS n FROM sales WHERE sold_on < DATE '2000-01-01' GROUP BY 1),
e AS (SELECT CASE WHEN n >= 20 THEN 'high' WHEN n >= 10 THEN 'medium' ELSE 'low' END AS confidence, round(abs(pence - est) * 1000000 / pence)::BIGINT AS ppm, sale_id, line FROM sales JOIN m ON m.postcode = sales.postcode WHERE sold_on >= DATE '2000-01-01' AND pence > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY confidence ORDER BY ppm, sale_id, line) - 1 AS i, count(*) OVER (PARTITION BY confidence) AS n FROM e)
SELECT confidence, any_value(n) AS n, sum(ppm)::DOUBLE / any_value(n) AS mae_ppm, max(ppm) FILTER (i = floor(n * 0.5)) AS p50, max(ppm) FILTER (i = floor(n * 0.9)) AS p90, count(*) FILTER (ppm <= 150000)::DOUBLE * 100 / any_value(n) AS in_band FROM r GROUP BY confidence""")
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir)
    cut = F.lit("2000-01-01").cast("date")
    m = s.where(F.col("sold_on") < cut).groupBy("postcode").agg((F.sum("pence").cast("double") / F.count("*")).alias("est"), F.count("*").alias("seen"))
    confidence = F.when(F.col("seen") >= 20, "high").when(F.col("seen") >= 10, "medium").otherwise("low")
    e = s.where((F.col("sold_on") >= cut) & (F.col("pence") > 0)).join(m, "postcode").select(confidence.alias("confidence"), F.round(F.abs(F.col("pence") - F.col("est")) * 1000000 / F.col("pence")).cast("bigint").alias("ppm"), "sale_id", "line")
    places = at_places(e, ["confidence"], "ppm", {"p50": F.floor(F.col("n") * F.lit(0.5)), "p90": F.floor(F.col("n") * F.lit(0.9))})
    sums = e.groupBy("confidence").agg((F.sum("ppm").cast("double") / F.count("*")).alias("mae_ppm"), (F.count_if(F.col("ppm") <= 150000).cast("double") * 100 / F.count("*")).alias("in_band"))
    return places.join(sums, "confidence").select("confidence", "n", "mae_ppm", "p50", "p90", "in_band")


@query("a52_scrape_diff", """
WITH o AS (SELECT o_custkey AS key, max(o_totalprice) AS price FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1), n AS (SELECT o_custkey AS key, max(o_totalprice) AS price FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT count(*) FILTER (o.key IS NULL) AS added, count(*) FILTER (n.key IS NULL) AS removed, count(*) FILTER (o.price <> n.price) AS changed, count(*) FILTER (o.price = n.price) AS same FROM o FULL JOIN n ON o.key = n.key""")
def scrape_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, price = F.to_date("o_orderdate"), F.col("o_totalprice")
    old, new = day < F.lit("2001-01-01").cast("date"), day >= F.lit("2000-01-01").cast("date")
    per = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(old, price)).alias("a"), F.max(F.when(new, price)).alias("b"))  # one pass in place of a join
    return per.agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("a") == F.col("b")).alias("same"))


# product analytics


@query("a22_active_users", """
SELECT count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-30') AS dau, count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-24') AS wau, count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-01') AS mau FROM events WHERE ts < TIMESTAMP '2024-01-31'""")
def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = events(spark, sf_dir).where(F.col("ts") < F.lit("2024-01-31").cast("timestamp")).groupBy("user_id").agg(F.max("ts").alias("ts"))  # one row a user, then plain counts
    since = lambda d: F.count_if(F.col("ts") >= F.lit(d).cast("timestamp"))
    return last.agg(since("2024-01-30").alias("dau"), since("2024-01-24").alias("wau"), since("2024-01-01").alias("mau"))


@query("a23_zero_filled_signups", """
WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS day) SELECT d.day, count(e.event_id) AS signups FROM d LEFT JOIN events e ON e.event_type = 'signup' AND e.ts::DATE = d.day GROUP BY 1""")
def zero_filled_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-05").cast("date"))).alias("day"))
    n = events(spark, sf_dir).where("event_type = 'signup'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("signups"))


@query("a24_tiers", "SELECT CASE WHEN c_acctbal < 0 THEN 'expired' WHEN c_acctbal > 7500 THEN 'pro' WHEN c_acctbal > 2500 THEN 'basic' ELSE 'free' END AS tier, count(*) AS n FROM customer GROUP BY 1")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    return load(spark, sf_dir, "customer").groupBy(F.when(b < 0, "expired").when(b > 7500, "pro").when(b > 2500, "basic").otherwise("free").alias("tier")).agg(F.count("*").alias("n"))


@query("a25_funnel", "WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS buys FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1) SELECT count(*) AS any_event, count(*) FILTER (views >= 1) AS first_search, count(*) FILTER (views >= 2) AS repeat_search, count(*) FILTER (buys >= 1) AS converted FROM u")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir).where(F.col("ts") < F.lit("2024-01-03").cast("timestamp")).groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("v"), F.count_if(F.col("event_type") == "purchase").alias("b"))
    return u.agg(F.count("*").alias("any_event"), F.count_if(F.col("v") >= 1).alias("first_search"), F.count_if(F.col("v") >= 2).alias("repeat_search"), F.count_if(F.col("b") >= 1).alias("converted"))


@query("a26_top_queries", f"WITH {EVENTS} SELECT left(lower(trim('Q' || k)), 80) AS q, count(*) AS n, count(*) FILTER (value < 5) AS none FROM ev GROUP BY 1 ORDER BY n DESC, q LIMIT 20")
def top_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.left(F.lower(F.trim(F.concat(F.lit("Q"), F.col("k").cast("string")))), F.lit(80))
    return events(spark, sf_dir).groupBy(q.alias("q")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 5).alias("none")).orderBy(F.desc("n"), "q").limit(20)


@query("a27_feature_breakdown", "SELECT event_type AS feature, count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS d7, count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS d1, max(ts) AS latest FROM events GROUP BY 1")
def feature_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = lambda d: F.count_if(F.col("ts") >= F.lit(d).cast("timestamp"))
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("feature")).agg(F.count("*").alias("total"), since("2024-01-24").alias("d7"), since("2024-01-30").alias("d1"), F.max("ts").alias("latest"))


@query("a29_league_table", f"WITH {LISTINGS} SELECT house, count(*) AS n, sum(CASE WHEN price < 200000 THEN price END)::DOUBLE / count(CASE WHEN price < 200000 THEN 1 END) AS mean_small FROM listings GROUP BY house")
def league_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.when(F.col("price") < 200000, F.col("price"))
    return listings(spark, sf_dir).groupBy("house").agg(F.count("*").alias("n"), F.try_divide(F.sum(small).cast("double"), F.count(small)).alias("mean_small"))


@query("a30_mean_of_rates", """
WITH p AS (SELECT user_id, user_id % 5 AS pattern, count(*) FILTER (event_type = 'click') * 1000 // nullif(count(*) FILTER (event_type = 'view'), 0) AS permille FROM events GROUP BY 1)
SELECT pattern, count(*) AS posts, sum(permille)::DOUBLE / count(permille) AS mean_rate FROM p GROUP BY 1""")
def mean_of_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, views = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "view")
    p = events(spark, sf_dir).groupBy("user_id").agg(clicks.alias("c"), views.alias("v")).select((F.col("user_id") % 5).alias("pattern"), F.expr("c * 1000 DIV nullif(v, 0)").alias("permille"))
    return p.groupBy("pattern").agg(F.count("*").alias("posts"), (F.sum("permille").cast("double") / F.count("permille")).alias("mean_rate"))


@query("e05_stratified_sample", f"WITH {LISTINGS} SELECT id, house, status FROM listings QUALIFY row_number() OVER (PARTITION BY house, status = 'available' ORDER BY md5(id::VARCHAR), id) <= CASE WHEN status = 'available' THEN 4 ELSE 1 END")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified(listings(spark, sf_dir).select("id", "house", "status"))


def stratified(rows: DataFrame, open_: int = 4, other: int = 1) -> DataFrame:
    """So many open rows and others of each house, by hash; the bounds are literal, so tasks drop the rest before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("house").orderBy(F.md5(F.col("id").cast("string")), "id"))
    parts = [rows.where(when).withColumn("_r", rank).where(F.col("_r") <= n).drop("_r") for when, n in ((F.col("status") == "available", open_), (F.col("status") != "available", other))]
    return parts[0].unionByName(parts[1])


@query("e14_field_coverage", "SELECT source, avg((lang IS NOT NULL AND lang <> '')::INT) AS lang, avg((n_chars > 0)::INT) AS chars, avg((text LIKE '%.%')::INT) AS stops FROM documents GROUP BY source")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c, a: F.avg(c.cast("int")).alias(a)
    return load(spark, sf_dir, "documents").groupBy("source").agg(share(F.col("lang").isNotNull() & (F.col("lang") != ""), "lang"), share(F.col("n_chars") > 0, "chars"), share(F.col("text").contains("."), "stops"))
