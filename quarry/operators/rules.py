"""Rules over listings, sources and batches: mappings, guards, gates, estimates and diverse picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..functions.text import REGIONS, area, real_date
from ..registry import query
from ..sources.tables import EVENTS, EVENTS_NOW, LISTINGS, ORDERS_TODAY, events, listings, load, now, today


def pounds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pounds", F.floor("price").cast("bigint"))


_POUNDS = f"{LISTINGS}, p AS (SELECT *, floor(price)::BIGINT AS pounds FROM listings)"


@query("f01_alias_projection", f"WITH {LISTINGS} SELECT id, house AS house_slug, sale_date AS day FROM listings")
def alias_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", F.col("house").alias("house_slug"), F.col("sale_date").alias("day"))


@query("f02_row_mapper", f"WITH {LISTINGS} SELECT id, nullif(owner % 50, 0) * 12 AS annual_rent, CASE WHEN status <> 'sold' THEN sale_date END AS day FROM listings")
def row_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("status") == "sold", F.lit("2099-12-31").cast("date")).otherwise(F.col("sale_date"))
    return listings(spark, sf_dir).select("id", (F.nullif(F.col("owner") % 50, F.lit(0)) * 12).alias("annual_rent"), real_date(day).alias("day"))


@query("f03_inverse_mapper", """
WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE o_custkey::VARCHAR END AS a, CASE WHEN o_orderkey % 5 = 0 THEN '2 or 3' ELSE (o_custkey % 7)::VARCHAR END AS b FROM orders)
SELECT id, try_cast(a AS INT) AS price, try_cast(b AS INT) AS beds, concat_ws(',', CASE WHEN try_cast(a AS INT) IS NULL THEN 'price' END, CASE WHEN try_cast(b AS INT) IS NULL THEN 'beds' END) AS audit FROM t""")
def inverse_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = load(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 == 0, "n/a").otherwise(c.cast("string")).alias("price"), F.when(k % 5 == 0, "2 or 3").otherwise((c % 7).cast("string")).alias("beds"))
    lost = [F.when(F.col(f).isNotNull() & F.col(f).try_cast("int").isNull(), F.lit(f)) for f in ("price", "beds")]
    return raw.select("id", *[F.col(f).try_cast("int").alias(f) for f in ("price", "beds")], F.concat_ws(",", *lost).alias("audit"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a made postcode (every fourth has none) and address."""
    k = F.col("c_custkey")
    code = F.concat(F.element_at(F.array(*[F.lit(a) for a in ("B", "BD", "L", "LS", "SW")]), (k % 5 + 1).cast("int")), (k % 9 + 1).cast("string"), F.lit(" 1AA"))
    town = F.element_at(F.array(*[F.lit(t) for t in ("Leeds", "Dover", "York")]), (k % 3 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", F.when(k % 4 != 0, code).alias("code"), F.concat((k % 90).cast("string"), F.lit(" High Street, "), town).alias("address"))


_PLACES = "places AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN ['B', 'BD', 'L', 'LS', 'SW'][c_custkey % 5 + 1] || (c_custkey % 9 + 1) || ' 1AA' END AS code, (c_custkey % 90) || ' High Street, ' || ['Leeds', 'Dover', 'York'][c_custkey % 3 + 1] AS address FROM customer)"
_YORKSHIRE = ", ".join(f"'{a}'" for a in REGIONS["yorkshire"])


@query("f08_region_areas", f"WITH {_PLACES} SELECT c_custkey FROM places WHERE regexp_extract(code, '^([A-Z]{{1,2}})[0-9]', 1) IN ({_YORKSHIRE})")
def region_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).where(area(F.col("code")).isin(REGIONS["yorkshire"])).select("c_custkey")


@query("f09_region_or_town", f"WITH {_PLACES} SELECT c_custkey FROM places WHERE CASE WHEN code IS NOT NULL THEN regexp_extract(code, '^([A-Z]{{1,2}})[0-9]', 1) IN ({_YORKSHIRE}) ELSE lower(address) LIKE '%leeds%' OR lower(address) LIKE '%york%' END")
def region_or_town(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A postcode decides; towns only where there is none."""
    named = F.lower("address").contains("leeds") | F.lower("address").contains("york")
    return places(spark, sf_dir).where(F.when(F.col("code").isNotNull(), area(F.col("code")).isin(REGIONS["yorkshire"])).otherwise(named)).select("c_custkey")


@query("f10_town_match", f"WITH {_PLACES} SELECT c_custkey FROM places WHERE contains(lower(address), 'leeds') OR coalesce(regexp_extract(code, '^([A-Z]{{1,2}})[0-9]', 1) = 'LS', FALSE)")
def town_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).where(F.lower("address").contains("leeds") | F.coalesce(area(F.col("code")) == "LS", F.lit(False))).select("c_custkey")


FAMILIES = {"available": ["available"], "sold": ["sold"], "stc": ["stc"], "ended": ["sold", "stc"], "everything": ["available", "sold", "stc"]}


@query("f12_status_families", f"WITH {LISTINGS}, t AS (SELECT unnest(CASE status WHEN 'available' THEN ['available', 'everything'] WHEN 'sold' THEN ['sold', 'ended', 'everything'] ELSE ['stc', 'ended', 'everything'] END) AS family FROM listings) SELECT family, count(*) AS n FROM t GROUP BY 1")
def status_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families in one pass: each row counts in every family that has its status."""
    of = F.array_compact(F.array(*[F.when(F.col("status").isin(members), F.lit(name)) for name, members in FAMILIES.items()]))
    return listings(spark, sf_dir).select(F.explode(of).alias("family")).groupBy("family").agg(F.count("*").alias("n"))


#: Named searches: predicate, order.
PRESETS = {"cheap": ("pounds < 60000", [("pounds", True)]), "urgent": ("deal_type = '1-URGENT'", [("sale_date", False)]), "in debt": ("balance < 0 AND status <> 'sold'", [("balance", True)])}


@query("f16_presets", f"""WITH {_POUNDS}
(SELECT 'cheap' AS preset, id FROM p WHERE pounds < 60000 ORDER BY pounds, id LIMIT 10) UNION ALL (SELECT 'urgent', id FROM p WHERE deal_type = '1-URGENT' ORDER BY sale_date DESC, id LIMIT 10)
UNION ALL (SELECT 'in debt', id FROM p WHERE balance < 0 AND status <> 'sold' ORDER BY balance, id LIMIT 10)""")
def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = pounds(listings(spark, sf_dir)), None
    for name, (where, order) in PRESETS.items():
        top = rows.where(where).orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in order], "id").limit(10).select(F.lit(name).alias("preset"), "id")
        out = top if out is None else out.unionByName(top)
    return out


@query("f21_phantoms", f"WITH {_PLACES}, t AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'Lot ' || c_custkey ELSE address END AS address FROM places) SELECT c_custkey FROM t WHERE NOT (regexp_matches(address, '^[0-9]+[A-Za-z]? [A-Za-z]') AND contains(address, ','))")
def phantoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose address is none: no house number before a name, or no second part."""
    k = F.col("c_custkey")
    address = F.when(k % 6 == 0, F.concat(F.lit("Lot "), k.cast("string"))).otherwise(F.col("address"))
    return places(spark, sf_dir).where(~(address.rlike(r"^[0-9]+[A-Za-z]? [A-Za-z]") & address.contains(","))).select("c_custkey")


@query("f22_url_guards", r"""
SELECT page_id, CASE WHEN url IS NULL OR NOT regexp_matches(lower(url), '^https?://') THEN 'not_a_url' WHEN regexp_matches(lower(url), '^https?://([^/]*\.)?example\.(com|net|org)(/|$)') THEN 'placeholder'
  WHEN regexp_matches(lower(url), '\.(jpe?g|png|gif|pdf)([?#]|$)') THEN 'media' WHEN regexp_matches(lower(url), '/(event|tag|login|category)s?(/|$)') THEN 'not_a_listing' ELSE 'ok' END AS verdict FROM pages""")
def url_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.lower("url")
    verdict = F.when(u.isNull() | ~u.rlike(r"^https?://"), "not_a_url").when(u.rlike(r"^https?://([^/]*\.)?example\.(com|net|org)(/|$)"), "placeholder").when(u.rlike(r"\.(jpe?g|png|gif|pdf)([?#]|$)"), "media").when(u.rlike(r"/(event|tag|login|category)s?(/|$)"), "not_a_listing").otherwise("ok")
    return load(spark, sf_dir, "pages").select("page_id", verdict.alias("verdict"))


@query("f24_price_sanity", f"WITH {_POUNDS}, t AS (SELECT id, prop_type = 'BUILDING' AS home, pounds // 20 AS guide FROM p) SELECT id, CASE WHEN NOT (home AND guide < 5000) THEN guide END AS guide FROM t WHERE guide BETWEEN 1000 AND 50000000")
def price_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pounds(listings(spark, sf_dir)).select("id", (F.col("prop_type") == "BUILDING").alias("home"), F.expr("pounds DIV 20").alias("guide"))
    return rows.where(F.col("guide").between(1_000, 50_000_000)).select("id", R.sane_price(F.col("guide"), F.col("home")).alias("guide"))


@query("f28_guide_distortion", f"WITH {_POUNDS} SELECT id, CASE WHEN pounds <= 1000 THEN 'token' WHEN pounds < owner * 200 * 0.3::DOUBLE THEN 'extreme_discount' END AS reason FROM p WHERE pounds <= 1000 OR pounds < owner * 200 * 0.3::DOUBLE")
def distorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pounds(listings(spark, sf_dir)).select("id", R.guide_distortion(F.col("pounds"), F.col("owner") * 200).alias("reason")).where("reason IS NOT NULL")


@query("f29_eligible_now", f"""
WITH l AS (SELECT user_id, max(ts) AS last, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY 1)
SELECT user_id FROM l WHERE last + to_hours(least(pow(2, greatest(attempts - 1, 0)), 24)::INT) <= TIMESTAMP '{EVENTS_NOW}' AND attempts < 5""")
def eligible_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last"), F.count_if(F.col("event_type") == "error").alias("attempts"))
    wait = F.least(F.pow(F.lit(2.0), F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(24.0)).cast("int")
    return per.where((F.col("last") + F.make_interval(hours=wait) <= now()) & (F.col("attempts") < 5)).select("user_id")


@query("j06_first_match_index", "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN (SELECT s_nationkey, arg_max(s_suppkey, s_suppkey % 7 * 1000000 + s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def first_match_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry with the latest date (here a made one) of each key wins."""
    index = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max_by("s_suppkey", F.struct(F.col("s_suppkey") % 7, "s_suppkey")).alias("s_suppkey"))
    return load(spark, sf_dir, "customer").join(index, F.col("c_nationkey") == F.col("s_nationkey"), "left").select("c_custkey", "s_suppkey")


@query("j08_exists_semi", "SELECT c_custkey FROM customer a WHERE EXISTS (SELECT 1 FROM customer b WHERE b.c_custkey = a.c_custkey * 2 AND b.c_nationkey <> a.c_nationkey)")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    b = a.select(F.col("c_custkey").alias("other"), F.col("c_nationkey").alias("other_nation"))
    return a.join(b, (F.col("c_custkey") * 2 == F.col("other")) & (F.col("c_nationkey") != F.col("other_nation")), "left_semi").select("c_custkey")


@query("j11_drop_missing", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'error'")
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = load(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id")
    return errors.join(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name")


@query("j20_owner_summary", "SELECT c_nationkey, count(*) AS owners, bool_or(c_acctbal < 0) AS any_debt, bool_or(c_mktsegment = 'BUILDING') AS any_building, count(DISTINCT c_mktsegment) AS kinds FROM customer GROUP BY 1")
def owner_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("owners"), F.bool_or(F.col("c_acctbal") < 0).alias("any_debt"), F.bool_or(F.col("c_mktsegment") == "BUILDING").alias("any_building"), F.count_distinct("c_mktsegment").alias("kinds"))


@query("j21_area_index", "WITH i AS (SELECT p_brand, count(*) AS sales, max(l_orderkey) AS newest FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT p_partkey, p_brand, sales, newest FROM part LEFT JOIN i USING (p_brand)")
def area_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sold = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_orderkey").alias("top"))
    index = sold.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("n").alias("sales"), F.max("top").alias("newest"))
    return part.join(index, "p_brand", "left").select("p_partkey", "p_brand", "sales", "newest")


@query("j27_one_to_one", "SELECT d.doc_id, d.source, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", "source", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("a18_cost_by_model", f"WITH {EVENTS} SELECT event_type AS provider, k % 3 AS model, count(*) AS calls, sum(k) AS cost FROM ev GROUP BY 1, 2")
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("provider"), (F.col("k") % 3).alias("model")).agg(F.count("*").alias("calls"), F.sum("k").alias("cost"))


@query("a28_transitions_today", f"""
WITH t AS (SELECT ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
SELECT event_type AS target, count(*) AS n FROM t WHERE old IS NOT NULL AND old <> event_type AND ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 1 DAY AND ts < TIMESTAMP '{EVENTS_NOW}' GROUP BY 1""")
def transitions_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type").withColumn("old", old)
    return rows.where((F.col("old") != F.col("event_type")) & (F.col("ts") >= now() - F.expr("INTERVAL 1 DAY")) & (F.col("ts") < now())).groupBy(F.col("event_type").alias("target")).agg(F.count("*").alias("n"))


@query("a31_cache_state", f"WITH {EVENTS} SELECT CASE WHEN ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY THEN 'active' ELSE 'expired' END AS state, count(*) AS entries, sum(k) AS size FROM ev GROUP BY 1")
def cache_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.when(F.col("ts") >= now() - F.expr("INTERVAL 7 DAY"), "active").otherwise("expired").alias("state")).agg(F.count("*").alias("entries"), F.sum("k").alias("size"))


@query("a37_reduced_denominator", f"WITH {LISTINGS} SELECT house, count(*) AS n, count(*) FILTER (status = 'stc') AS excused, coalesce(100 * count(*) FILTER (status <> 'stc' AND id % 4 <> 0) // nullif(count(*) FILTER (status <> 'stc'), 0), 100) AS price_pct FROM listings GROUP BY 1")
def reduced_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose price may be missing leave the denominator; none left counts as full."""
    counted = F.col("status") != "stc"
    pct = F.expr("try_divide(100 * count_if(status <> 'stc' AND id % 4 <> 0), count_if(status <> 'stc'))")
    return listings(spark, sf_dir).groupBy("house").agg(F.count("*").alias("n"), F.count_if(~counted).alias("excused"), F.coalesce(F.floor(pct).cast("bigint"), F.lit(100)).alias("price_pct"))


@query("a39_alert_rules", """
WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type IN ('error', 'purchase')) AS attempts FROM events GROUP BY 1)
SELECT user_id, bad, attempts FROM g WHERE attempts >= 5 AND 2 * bad >= attempts""")
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    per = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(kind == "error").alias("bad"), F.count_if(kind.isin("error", "purchase")).alias("attempts"))
    return per.where((F.col("attempts") >= 5) & (2 * F.col("bad") >= F.col("attempts")))


@query("a41_dominant_value", f"""
WITH {LISTINGS}, t AS (SELECT id, house, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN 'B' ELSE 'A' END AS tenure FROM listings),
c AS (SELECT house, tenure, count(*) AS n, sum(count(*)) OVER (PARTITION BY house) AS total FROM t WHERE tenure IS NOT NULL GROUP BY 1, 2)
SELECT id, coalesce(t.tenure, c.tenure) AS tenure FROM t LEFT JOIN (SELECT house, tenure FROM c WHERE 10 * n >= 8 * total) c ON t.house = c.house""")
def dominant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks take a value that at least four fifths of the group's known rows have."""
    k = F.col("id")
    rows = listings(spark, sf_dir).select("id", "house", F.when(k % 7 != 0, F.when(k % 11 == 0, "B").otherwise("A")).alias("tenure"))
    counts = rows.where("tenure IS NOT NULL").groupBy("house", "tenure").agg(F.count("*").alias("n"))
    ruling = counts.withColumn("total", F.sum("n").over(Window.partitionBy("house"))).where("10 * n >= 8 * total").select("house", F.col("tenure").alias("usual"))
    return rows.join(ruling, "house", "left").select("id", F.coalesce("tenure", "usual").alias("tenure"))


@query("a51_map_counts", "SELECT n_name AS country, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def map_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries of nested owners, exploded and counted."""
    s = load(spark, sf_dir, "supplier").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    nested = s.select(F.array(F.struct(F.col("s_name").alias("name"), F.col("n_name").alias("country"))).alias("owners"))
    return nested.select(F.explode("owners").alias("o")).groupBy(F.col("o.country").alias("country")).agg(F.count("*").alias("n"))


@query("w15_earliest_ready", "SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 5, s_acctbal > 0 DESC, s_suppkey) = 1")
def earliest_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.struct(F.col("s_suppkey") % 5, ~(F.col("s_acctbal") > 0), "s_suppkey")
    return load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min_by("s_suppkey", first).alias("s_suppkey"))


def diverse(rows: DataFrame, order: list, caps: dict[str, int], top: int) -> DataFrame:
    """Greedy picks in order with at most ``caps`` rows for each value of a column, ``top`` in all, with ``pick`` from 1.

    A row that follows ``min(caps)`` rows with the same values in all capped columns can never be
    picked, so each task keeps only the first ones of each combination. Then ``top`` rounds take
    the first row whose values still have room: each is a top-1 over those, and one row comes back.
    """
    same = Window.partitionBy(*caps).orderBy(*order)
    few = rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= min(caps.values())).drop("_n").persist()
    picks: list = []
    for _ in range(top):
        room = F.lit(True)
        for column, most in caps.items():
            values = [p[column] for p in picks]
            for full in {v for v in values if values.count(v) >= most}:
                room = room & ~F.col(column).eqNullSafe(F.lit(full))
        rest = few.where(room)
        for p in picks:
            same_row = F.lit(True)
            for column in rows.columns:
                same_row = same_row & F.col(column).eqNullSafe(F.lit(p[column]))
            rest = rest.where(~same_row)
        picks += rest.orderBy(*order).limit(1).collect()
        if len(picks) <= _:
            break
    few.unpersist()
    schema = T.StructType([*rows.schema.fields, T.StructField("pick", T.IntegerType(), False)])
    return rows.sparkSession.createDataFrame([(*p, i) for i, p in enumerate(picks, 1)], schema)


@query("w20_diverse_picks", f"""
WITH RECURSIVE {_POUNDS}, o AS (SELECT id, house, prop_type, region, pounds, row_number() OVER (ORDER BY pounds DESC, id) AS place FROM p WHERE status <> 'sold'),
g AS (SELECT 0 AS pick, 0::BIGINT AS place, []::VARCHAR[] AS hs, []::VARCHAR[] AS ts, []::BIGINT[] AS rs
  UNION ALL SELECT pick + 1, n.place, list_append(hs, n.house), list_append(ts, n.prop_type), list_append(rs, n.region::BIGINT) FROM (
    SELECT g.*, (SELECT min(o.place) FROM o WHERE o.place > g.place AND len(list_filter(g.hs, lambda x: x = o.house)) < 2 AND len(list_filter(g.ts, lambda x: x = o.prop_type)) < 3 AND len(list_filter(g.rs, lambda x: x = o.region)) < 2) AS nxt FROM g WHERE pick < 8) s JOIN o n ON n.place = s.nxt)
SELECT id, house, prop_type, region, pounds, pick FROM g JOIN o USING (place) WHERE pick > 0""")
def diverse_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pounds(listings(spark, sf_dir)).where("status <> 'sold'").select("id", "house", "prop_type", "region", "pounds")
    return diverse(rows, [F.desc("pounds"), "id"], {"house": 2, "prop_type": 3, "region": 2}, 8)


REASONS = ["1-URGENT", "5-LOW", "2-HIGH"]


@query("t06_reason_order", f"WITH {LISTINGS}, g AS (SELECT house, deal_type AS reason, count(*) AS n FROM listings GROUP BY 1, 2) SELECT house, reason, n FROM g ORDER BY CASE reason WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, n DESC, house, reason LIMIT 60")
def reason_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = listings(spark, sf_dir).groupBy("house", F.col("deal_type").alias("reason")).agg(F.count("*").alias("n"))
    return groups.orderBy(R.ranked(F.col("reason"), REASONS), F.desc("n"), "house", "reason").limit(60)


@query("t08_horizon_top", f"WITH {LISTINGS}, o AS (SELECT owner, min(CASE WHEN sale_date >= DATE '{ORDERS_TODAY}' THEN sale_date END) AS soonest FROM listings GROUP BY 1) SELECT owner, soonest FROM o ORDER BY soonest IS NULL, soonest, owner LIMIT 40")
def horizon_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = listings(spark, sf_dir).groupBy("owner").agg(F.min(F.when(F.col("sale_date") >= today(), F.col("sale_date"))).alias("soonest"))
    return per.orderBy(F.col("soonest").asc_nulls_last(), "owner").limit(40)


@query("s03_head_counts", "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 50) AS large FROM events")
def head_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") > 50).alias("large"))


@query("s19_ttl_purge", f"SELECT event_id FROM events WHERE ts + CASE event_type WHEN 'error' THEN INTERVAL 1 DAY WHEN 'view' THEN INTERVAL 3 DAY ELSE INTERVAL 7 DAY END > TIMESTAMP '{EVENTS_NOW}'")
def ttl_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").where(F.col("ts") > now() - F.when(kind == "error", F.expr("INTERVAL 1 DAY")).when(kind == "view", F.expr("INTERVAL 3 DAY")).otherwise(F.expr("INTERVAL 7 DAY"))).select("event_id")


_THERE = {"image": "id % 3 <> 0", "price": "pounds > 60000", "postcode": "owner % 4 <> 0", "address": "TRUE", "uprn": "id % 5 = 0", "epc": "id % 2 = 0", "tenure": "owner % 2 = 0", "beds": "owner % 7 <> 0"}
_STATUS = "CASE WHEN status = 'sold' THEN 'sold' WHEN id % 9 = 0 THEN 'poa' ELSE 'unknown' END"


@query("m03_listing_quality", f"""WITH {_POUNDS}, s AS (SELECT *, {_STATUS} AS price_status FROM p) SELECT id, {" + ".join(f"CASE WHEN {w} THEN {R.WEIGHTS[f]} ELSE {"CASE price_status WHEN 'sold' THEN 25 WHEN 'poa' THEN 12 ELSE 0 END" if f == "price" else "0"} END" for f, w in _THERE.items())} AS quality,
  concat_ws(',', {", ".join(f"CASE WHEN NOT ({w}) THEN 'no_{f}' END" for f, w in _THERE.items())}) AS issues FROM s""")
def listing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = {f: F.expr(w) for f, w in _THERE.items()}
    return pounds(listings(spark, sf_dir)).select("id", R.quality_points(there, F.expr(_STATUS)).alias("quality"), F.array_join(R.issues(there), ",").alias("issues"))


_SIGNALS = {"Poor condition": 5, "Sitting tenant": 7, "Knotweed": 11, "Needs modernisation": 2, "Vacant": 3}
_PCT = "greatest(-45, least(20, " + " + ".join(f"CASE WHEN id % {n} = 0 THEN {R.ADJUST[s]} ELSE 0 END" for s, n in _SIGNALS.items()) + "))"


@query("m07_value_estimate", f"""
WITH {_POUNDS}, a AS (SELECT id, CASE WHEN id % 13 <> 0 THEN pounds END AS anchor, owner % 8 AS comps, {_PCT} AS pct, CASE WHEN id % 4 = 0 THEN owner * 10 ELSE 0 END AS works, id % 2 = 0 AS sized FROM p WHERE TRUE),
e AS (SELECT *, greatest(1, floor((anchor * (1 + pct / 100.0::DOUBLE) - floor(works * 0.7::DOUBLE + 0.5)) / 100 + 0.5) * 100)::BIGINT AS estimate,
  (CASE WHEN comps >= 5 THEN 2 WHEN comps >= 2 THEN 1 ELSE 0 END) + (CASE WHEN comps < 2 THEN -1 WHEN comps >= 5 AND sized THEN 1 ELSE 0 END) + (CASE WHEN sized THEN 1 ELSE -1 END) AS points FROM a WHERE anchor IS NOT NULL),
s AS (SELECT *, CASE WHEN points >= 3 THEN 'high' WHEN points >= 1 THEN 'medium' ELSE 'low' END AS sure, CASE WHEN points >= 3 THEN 5 WHEN points >= 1 THEN 10 ELSE 20 END AS band FROM e)
SELECT id, estimate, sure, greatest(1, floor(estimate * (100 - band) / 100.0::DOUBLE / 100 + 0.5) * 100)::BIGINT AS low, (floor(estimate * (100 + band) / 100.0::DOUBLE / 100 + 0.5) * 100)::BIGINT AS high FROM s""")
def value_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    signals = F.array_compact(F.array(*[F.when(k % n == 0, F.lit(s)) for s, n in _SIGNALS.items()]))
    rows = pounds(listings(spark, sf_dir)).where(k % 13 != 0)
    value = R.estimate(F.col("pounds").cast("double"), signals, F.when(k % 4 == 0, F.col("owner") * 10).otherwise(0))
    comps = F.col("owner") % 8
    sure = R.confidence(comps, comps < 2, F.when(k % 2 == 0, 1))
    rows = rows.select("id", value.alias("estimate"), sure.alias("sure"))
    low, high = R.band(F.col("estimate").cast("double"), F.col("sure"))
    return rows.select("id", "estimate", "sure", low.alias("low"), high.alias("high"))


@query("m16_count_regressions", """
WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER p AS before, count(*) OVER p AS days FROM d WINDOW p AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT user_id, day, CASE WHEN before > 2 * days AND n * 2 * days < before THEN 'regression' WHEN before > 2 * days AND n * 5 * days < before * 4 THEN 'degraded' ELSE 'healthy' END AS verdict FROM w WHERE days > 0""")
def count_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's count against the mean of up to five earlier days; a mean of two or less is no baseline."""
    past = Window.partitionBy("user_id").orderBy("day").rowsBetween(-5, -1)
    rows = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).withColumns({"before": F.sum("n").over(past), "days": F.count("*").over(past)}).where("days > 0")
    verdict = F.when(F.col("before") > 2 * F.col("days"), R.count_verdict(F.col("n") * F.col("days") * 1000, F.col("before") * 1000)).otherwise("healthy")
    return rows.select("user_id", "day", verdict.alias("verdict"))


@query("m17_recall_gate", """
WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS got, count(*) FILTER (event_type IN ('purchase', 'error')) AS wanted FROM events GROUP BY 1)
SELECT user_id, wanted - got AS missing, CASE WHEN wanted = 0 OR got / wanted::DOUBLE >= 0.98::DOUBLE THEN 'info' WHEN got / wanted::DOUBLE < 0.85::DOUBLE THEN 'error' ELSE 'warning' END AS severity FROM g""")
def recall_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    per = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(kind == "purchase").alias("got"), F.count_if(kind.isin("purchase", "error")).alias("wanted"))
    return per.select("user_id", (F.col("wanted") - F.col("got")).alias("missing"), R.recall_severity(F.try_divide(F.col("got").cast("double"), F.col("wanted"))).alias("severity"))


@query("m18_batch_gate", f"""
WITH {LISTINGS}, b AS (SELECT owner, count(*) AS rows_n, count(*) FILTER (id % 3 <> 0) / count(*)::DOUBLE AS quality FROM listings GROUP BY 1)
SELECT owner, CASE WHEN rows_n < 3 THEN 'warn' WHEN quality < 0.60::DOUBLE THEN 'warn' WHEN owner % 20 = 0 THEN 'warn' ELSE 'cache' END AS decision FROM b""")
def batch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = listings(spark, sf_dir).groupBy("owner").agg(F.count("*").alias("rows_n"), (F.count_if(F.col("id") % 3 != 0) / F.count("*")).alias("quality"))
    verdict = F.when(F.col("owner") % 20 == 0, "degraded").otherwise("healthy")
    return b.select("owner", R.batch_gate(F.col("rows_n"), F.col("quality"), verdict, F.lit(0)).alias("decision"))


@query("m20_silent_failures", "SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase') > 0 AND arg_max(event_type, (ts, event_id)) = 'error'")
def silent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("fed"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return per.where("fed > 0 AND last = 'error'").select("user_id")


@query("d05_stale_dates", f"WITH {LISTINGS} SELECT id, coalesce(CASE WHEN id % 3 <> 0 THEN sale_date END, CASE WHEN sale_date + 14 < DATE '{ORDERS_TODAY}' THEN sale_date + 14 END) AS day FROM listings")
def stale_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", R.stale_date(F.when(F.col("id") % 3 != 0, F.col("sale_date")), F.col("sale_date"), today()).alias("day"))


@query("d07_cache_hours", f"""
WITH {LISTINGS}, t AS (SELECT id, CASE deal_type WHEN '1-URGENT' THEN 6 WHEN '2-HIGH' THEN 24 ELSE 72 END AS own, datediff('day', DATE '{ORDERS_TODAY}', sale_date) * 24 AS hours_left FROM listings)
SELECT id, CASE WHEN hours_left > 0 AND hours_left < 48 THEN least(own, 6) ELSE own END AS ttl FROM t""")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.datediff("sale_date", today()) * 24
    return listings(spark, sf_dir).select("id", R.cache_hours(F.col("deal_type"), left, {"1-URGENT": 6, "2-HIGH": 24, "other": 72}).alias("ttl"))


@query("d10_retire_past", f"WITH {LISTINGS} SELECT house, count(*) AS retired FROM listings WHERE status = 'available' AND sale_date < DATE '{ORDERS_TODAY}' - 30 GROUP BY 1")
def retire_past(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).where((F.col("status") == "available") & (F.col("sale_date") < F.date_sub(today(), 30))).groupBy("house").agg(F.count("*").alias("retired"))
