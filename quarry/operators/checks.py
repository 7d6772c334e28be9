"""Checks of listings and of runs: addresses, formats, gates, drift, cohorts and change events in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..registry import query
from ..sources.tables import EVENTS, LISTINGS, ORDERS_TODAY, SALES, events, listings, load, sales, today
from ..streaming.changes import change_events
from .deals import TOLD, _pick, told
from .vocab import _written, _written_sql

#: What makes a line an address, and what never is one.
STREET = r"\b(road|rd|street|st|lane|ln|avenue|ave|close|drive|dr|way|court|crt|ct|place|pl|terrace|ter|crescent|cres|gardens|gdns|grove|grv|hill|park|mews|square|sq|row|walk|parade|rise|end|view|green)\b"
SITE = r"\b(plot|land|site|unit|warehouse|office|shop|hotel|pub|inn|manor|lodge|hall|chapel|church|school|works|mill|barn|stables?|garage|yard|depot|factory|centre|center|building|block|tower|house)\b"
PLACEHOLDER = r"^(properties?\s+coming\s+soon|coming\s+soon|t\.?\s*b\.?\s*a\.?|to\s+be\s+advised|various\s+locations?|multiple\s+locations?|see\s+catalogue|full\s+details|lot\s*\d+|view\s+lot|more\s+details)$"
PORTFOLIO, SHELL = r"\bportfolio\b", r"^(bristol|teesside|manchester|birmingham|liverpool|leeds|london|glasgow|edinburgh|cardiff|belfast|newcastle|sheffield|york)$"
COUNTY = r"^[a-z][a-z'.\s-]{1,40}(?:\s*[-,]\s*|\s+)(?:kent|hampshire|sussex|surrey|essex|devon|cornwall|somerset|dorset|wiltshire)(?:\s+area)?$"
CODE = r"\b[a-z]{1,2}[0-9][a-z0-9]?\s*[0-9][a-z]{2}\b"
ADDRESSES = ["14 Mill Lane, Leeds LS1 1AA", "Leeds", "Dover - Kent", "Lot 12", "Properties coming soon", "HMO Portfolio LS6", "info@house.test", "£120,000 guide", "View details here", "Heathfield Area", "Whitstable", "The Old Chapel", "Hut", None, "a b, c, d, e", "Flat 2 Quay House", "BS6 5RT"]


def address_verdict(address: Column) -> Column:
    """Why a line is no address that can be shown, or ``ok``; the first rule that fits."""
    a = F.lower(F.trim(F.regexp_replace(F.coalesce(address, F.lit("")), r"\s+", " ")))
    digit, code, street = a.rlike("[0-9]"), a.rlike(CODE), a.rlike(STREET)
    words = F.size(F.filter(F.split(a, r"[\s,/-]+"), lambda w: w != ""))
    return (
        F.when(F.length(a) < 5, "missing_or_too_short")
        .when(a.rlike(r"^(enquiries|info|sales|contact|admin|hello)@"), "email_address")
        .when(a.rlike(r"^£[\d,]+") | a.rlike(r"^propert(y|ies)$"), "price_or_label")
        .when(a.rlike(r"^(lot\s*\d+|view|more|see|click|browse)\s"), "ui_chrome_label")
        .when(a.rlike(PLACEHOLDER), "placeholder")
        .when(a.rlike(PORTFOLIO) & ~street, "portfolio_title_shell")
        .when(a.rlike(SHELL), "city_region_shell")
        .when((words == 1) & ~digit & ~code, "single_token_shell")
        .when(~code & ~digit & ~street & a.rlike(COUNTY), "town_county_label")
        .when(~code & ~digit & ~street & ~a.rlike(SITE) & (F.length(a) <= 40) & (words <= 4) & ~a.rlike(",.*,"), "locality_only_no_street")
        .otherwise("ok")
    )


@query("f20_address_verdict", rf"""
WITH {_written_sql(ADDRESSES)}, a AS (SELECT id, lower(trim(regexp_replace(coalesce(v, ''), '\s+', ' ', 'g'))) AS a FROM v),
t AS (SELECT *, regexp_matches(a, '[0-9]') AS d, regexp_matches(a, '{CODE}') AS p, regexp_matches(a, '{STREET}') AS s, len(list_filter(regexp_split_to_array(a, '[\s,/-]+'), lambda w: w <> '')) AS n FROM a)
SELECT id, CASE WHEN length(a) < 5 THEN 'missing_or_too_short' WHEN regexp_matches(a, '^(enquiries|info|sales|contact|admin|hello)@') THEN 'email_address' WHEN regexp_matches(a, '^£[\d,]+') OR regexp_matches(a, '^propert(y|ies)$') THEN 'price_or_label'
  WHEN regexp_matches(a, '^(lot\s*\d+|view|more|see|click|browse)\s') THEN 'ui_chrome_label' WHEN regexp_matches(a, '{PLACEHOLDER}') THEN 'placeholder' WHEN regexp_matches(a, '{PORTFOLIO}') AND NOT s THEN 'portfolio_title_shell' WHEN regexp_matches(a, '{SHELL}') THEN 'city_region_shell'
  WHEN n = 1 AND NOT d AND NOT p THEN 'single_token_shell' WHEN NOT p AND NOT d AND NOT s AND regexp_matches(a, '{COUNTY.replace(chr(39), chr(39) * 2)}') THEN 'town_county_label' WHEN NOT p AND NOT d AND NOT s AND NOT regexp_matches(a, '{SITE}') AND length(a) <= 40 AND n <= 4 AND NOT regexp_matches(a, ',.*,') THEN 'locality_only_no_street' ELSE 'ok' END AS reason FROM t""")
def address_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, ADDRESSES).select("id", address_verdict(F.col("v")).alias("reason"))


#: Risks that buyers see first, and how a sale without reserve is told.
RED_FLAGS, NIL = ["Knotweed", "Subsidence", "Cladding/EWS1", "Contamination", "Non-std construction"], r"\b(nil|no|without|zero)[\s-]*reserve|unreserved\b"


@query("f27_red_flag_lots", f"""
WITH {TOLD}, r AS (SELECT id, {' OR '.join(f"regexp_matches(t, '{p}')" for n, _, p in T.SIGNALS if n in RED_FLAGS)} AS red_flag, price IS NULL AND regexp_matches(t || CASE WHEN id % 5 = 0 THEN ' offered without reserve' ELSE '' END, '{NIL}') AS nil_reserve FROM told) SELECT id, red_flag, nil_reserve FROM r WHERE red_flag OR nil_reserve""")
def red_flag_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    risks = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, pts, p in T.SIGNALS if pts < 0]))
    words = F.concat(t, F.when(F.col("id") % 5 == 0, " offered without reserve").otherwise(""))
    rows = told(spark, sf_dir).select("id", F.arrays_overlap(risks, F.array(*[F.lit(x) for x in RED_FLAGS])).alias("red_flag"), (F.col("price").isNull() & words.rlike(NIL)).alias("nil_reserve"))
    return rows.where("red_flag OR nil_reserve")


def first_of(tiers: list[tuple[str, Column, Column]], least: int = 3) -> tuple[Column, Column]:
    """The value and name of the first tier with enough behind it."""
    return F.coalesce(*[F.when(n >= least, v) for _, n, v in tiers]), F.coalesce(*[F.when(n >= least, F.lit(k)) for k, n, _ in tiers], F.lit("static"))


@query("j16_room_tiers", f"""
WITH {SALES}, s AS (SELECT postcode, district, kind, pence // 3 AS v, line >= 4 AS room FROM sales),
a AS (SELECT postcode, count(*) FILTER (room) AS rn, sum(v) FILTER (room) AS rv, count(*) FILTER (NOT room) AS un, sum(v) FILTER (NOT room) AS uv FROM s GROUP BY 1),
d AS (SELECT district, count(*) FILTER (room) AS rn, sum(v) FILTER (room) AS rv, count(*) FILTER (NOT room) AS un, sum(v) FILTER (NOT room) AS uv FROM s GROUP BY 1),
p AS (SELECT p_partkey AS postcode, p_brand AS district, p_size % 3 = 0 AS hmo, p_size % 5 + 2 AS beds FROM part)
SELECT p.postcode, CASE WHEN hmo AND a.rn >= 3 THEN 'unit rooms' WHEN hmo AND d.rn >= 3 THEN 'district rooms' WHEN a.un >= 3 THEN 'unit' WHEN d.un >= 3 THEN 'district' ELSE 'static' END AS tier,
  CASE WHEN hmo AND a.rn >= 3 THEN beds * a.rv::DOUBLE / a.rn WHEN hmo AND d.rn >= 3 THEN beds * d.rv::DOUBLE / d.rn WHEN a.un >= 3 THEN a.uv::DOUBLE / a.un WHEN d.un >= 3 THEN d.uv::DOUBLE / d.un END AS value
FROM p LEFT JOIN a ON a.postcode = p.postcode LEFT JOIN d ON d.district = p.district""")
def room_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparables by tier: rooms first for shared houses, by the beds; coarser tiers add up the finest."""
    s = sales(spark, sf_dir).select("postcode", "district", F.expr("pence DIV 3").alias("v"), (F.col("line") >= 4).alias("room"))
    finest = s.groupBy("postcode", "district").agg(*[a for k, when in (("r", F.col("room")), ("u", ~F.col("room"))) for a in (F.count_if(when).alias(f"{k}n"), F.sum(F.when(when, F.col("v"))).alias(f"{k}v"))])
    tier = lambda name, key: finest.groupBy(key).agg(*[F.sum(c).alias(f"{name}_{c}") for c in ("rn", "rv", "un", "uv")])
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("postcode"), F.col("p_brand").alias("district"), (F.col("p_size") % 3 == 0).alias("hmo"), (F.col("p_size") % 5 + 2).alias("beds"))
    rows = p.join(tier("a", "postcode"), "postcode", "left").join(tier("d", "district"), "district", "left")
    mean = lambda x, k: F.col(f"{x}_{k}v").cast("double") / F.col(f"{x}_{k}n")
    rooms = lambda x: F.col("beds") * F.col(f"{x}_rv").cast("double") / F.col(f"{x}_rn")
    for_hmo = lambda n: F.when(F.col("hmo"), F.col(n))
    value, name = first_of([("unit rooms", for_hmo("a_rn"), rooms("a")), ("district rooms", for_hmo("d_rn"), rooms("d")), ("unit", F.col("a_un"), mean("a", "u")), ("district", F.col("d_un"), mean("d", "u"))])
    return rows.select("postcode", name.alias("tier"), value.alias("value"))


#: Streets of the fuzzy join's two sides; the second spells them in its own way.
_STREETS, _SPELT = ["mill lane", "old mill road", "high street north", "quay view", "station road"], ["mill lane", "the old mill road", "high street", "quay", "mill road"]


@query("j17_fuzzy_addresses", f"""
WITH l AS (SELECT c_custkey AS id, c_nationkey AS code, (c_custkey % 12)::VARCHAR AS no, string_split({_STREETS}[c_custkey % 5 + 1], ' ') AS w FROM customer),
e AS (SELECT o_orderkey AS cert, c_nationkey AS code, (o_orderkey % 12)::VARCHAR AS no, string_split({_SPELT}[o_orderkey % 5 + 1], ' ') AS w, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT id, cert, day, len(list_intersect(l.w, e.w))::DOUBLE / len(l.w) AS score FROM l JOIN e USING (code, no))
SELECT id, cert, round(score, 6) AS score FROM m WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, day DESC, cert) = 1""")
def fuzzy_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The certificate of a place: same postcode and number, half of the street's words or more; best, then latest."""
    k = F.col("c_custkey")
    words = lambda v, i: F.split(_pick(v, i), " ")
    c = load(spark, sf_dir, "customer")
    lots = c.select(k.alias("id"), F.col("c_nationkey").alias("code"), (k % 12).alias("no"), words(_STREETS, k % 5).alias("w"))
    o = F.col("o_orderkey")
    certs = load(spark, sf_dir, "orders").join(c, F.col("o_custkey") == k).select(o.alias("cert"), F.col("c_nationkey").alias("code"), (o % 12).alias("no"), words(_SPELT, o % 5).alias("v"), F.to_date("o_orderdate").alias("day"))
    # of certificates that read alike only the latest can win
    certs = certs.groupBy("code", "no", "v").agg(F.max(F.struct("day", (-F.col("cert")).alias("c"))).alias("m"))
    score = F.size(F.array_intersect("w", "v")) / F.size("w")
    best = lots.join(certs, ["code", "no"]).select("id", score.alias("score"), "m").where("score >= 0.5").groupBy("id").agg(F.max(F.struct("score", "m.day", "m.c")).alias("b"))
    return best.select("id", (-F.col("b.c")).alias("cert"), F.round("b.score", 6).alias("score"))


@query("a16_dark_list", f"""
WITH {LISTINGS}, h AS (SELECT owner, count(*) AS rows, count(*) FILTER (status = 'available') AS live, count(*) FILTER (balance > 0) AS filled, max(sale_date) AS last FROM listings GROUP BY 1),
c AS (SELECT *, CASE WHEN last < DATE '2000-01-01' THEN 'retired' WHEN live = 0 THEN 'dark' WHEN filled = 0 THEN 'thin' ELSE 'covered' END AS class FROM h), w AS (SELECT *, rows * CASE class WHEN 'covered' THEN 100 WHEN 'thin' THEN 50 ELSE 0 END AS credit FROM c WHERE class <> 'retired')
SELECT owner, class, rows, round(100.0 * rows / sum(rows) OVER (), 6)::DOUBLE AS weight_pct, round(sum(credit) OVER ()::DOUBLE / sum(rows) OVER (), 6) AS fleet_pct FROM w ORDER BY class = 'dark' DESC, rows DESC, owner LIMIT 50""".replace("sum(rows) OVER ()", "(sum(rows) OVER ())").replace("sum(credit) OVER ()", "(sum(credit) OVER ())"))
def dark_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with nothing live, the largest first, with their weight and the coverage of the fleet."""
    h = listings(spark, sf_dir).groupBy("owner").agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "available").alias("live"), F.count_if(F.col("balance") > 0).alias("filled"), F.max("sale_date").alias("last"))
    kind = F.when(F.col("last") < F.lit("2000-01-01").cast("date"), "retired").when(F.col("live") == 0, "dark").when(F.col("filled") == 0, "thin").otherwise("covered")
    w = h.withColumn("class", kind).where("class <> 'retired'").withColumn("credit", F.col("rows") * F.when(F.col("class") == "covered", 100).when(F.col("class") == "thin", 50).otherwise(0))
    whole = w.agg(F.sum("rows").alias("all"), F.sum("credit").alias("credits"))
    top = w.orderBy(F.col("class") != "dark", F.desc("rows"), "owner").limit(50)
    return top.crossJoin(F.broadcast(whole)).select("owner", "class", "rows", F.round(100.0 * F.col("rows") / F.col("all"), 6).alias("weight_pct"), F.round(F.col("credits") / F.col("all"), 6).alias("fleet_pct"))  # one row


@query("a42_stripped_texts", """
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents),
b AS (SELECT source, line FROM l WHERE length(trim(line)) >= 12 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS kept, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source = l.source AND b.line = l.line) GROUP BY 1""")
def stripped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that three or more documents of their source share; a text of nothing else goes."""
    lines = load(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    shared = lines.where(F.length(F.trim("line")) >= 12).select("source", "line", "doc_id").distinct().groupBy("source", "line").agg(F.count("*").alias("n")).where("n >= 3").drop("n")
    kept = lines.join(shared, ["source", "line"], "left_anti")
    listed = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.md5(F.array_join(F.transform(listed, lambda x: x["line"]), "\n")).alias("digest"))


@query("x03_host_pin", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, 'https://' || CASE WHEN regexp_matches(host, '^(www|m|blog)\.') THEN regexp_replace(host, '^(www|m|blog)\.', '') ELSE host END || regexp_replace(path, '/+$', '') AS url FROM p""")
def host_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One host for all variants of a house's, the path kept, query and fragment dropped."""
    host, path = F.regexp_extract("url", "://([^/?#]+)", 1), F.regexp_extract("url", "://[^/?#]+([^?#]*)", 1)
    pinned = F.regexp_replace(host, r"^(www|m|blog)\.", "")
    return load(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://"), pinned, F.regexp_replace(path, "/+$", "")).alias("url"))


def sale_format(calendar: Column, kind: Column, day: Column) -> Column:
    """mmoa for continuous sales, traditional for real dates, else unknown."""
    rolling = (calendar == "always_on") | F.lower(F.coalesce(kind, F.lit(""))).rlike("continuous|rolling|modern.?method|timed.?online|online.?only")
    return F.when(F.coalesce(rolling, F.lit(False)) | (day > F.lit("2098-01-01").cast("date")), "mmoa").when(day.isNotNull(), "traditional").otherwise("unknown")


def lifecycle(status: Column, form: Column, day: Column, now: Column) -> Column:
    """live, passed_in_play, finished or other: by status, then by the kind of sale and its day."""
    open_ = status.isin("available", "stc")
    real = F.when(day <= F.lit("2098-01-01").cast("date"), day)
    dateless = F.when(open_, "live").when(status == "unsold", "passed_in_play").otherwise("other")
    ahead = F.when(open_ | (status == "unsold"), "live").otherwise("other")
    behind = F.when(open_ | (status == "unsold"), "passed_in_play").otherwise("finished")
    return F.when(status.isin("sold", "withdrawn"), "finished").when((form == "mmoa") | real.isNull(), dateless).when(real >= now, ahead).otherwise(behind)


@query("d04_lifecycle", f"""
WITH {LISTINGS}, t AS (SELECT id, CASE id % 7 WHEN 0 THEN 'unsold' WHEN 1 THEN 'withdrawn' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN 'always_on' END AS cal, CASE WHEN id % 6 = 0 THEN 'Timed Online' WHEN id % 6 = 1 THEN 'room' END AS kind, CASE WHEN id % 8 = 0 THEN NULL WHEN id % 9 = 0 THEN DATE '2099-12-31' ELSE sale_date END AS day FROM listings),
f AS (SELECT *, CASE WHEN coalesce(cal = 'always_on', false) OR regexp_matches(lower(coalesce(kind, '')), 'continuous|rolling|modern.?method|timed.?online|online.?only') OR coalesce(day > DATE '2098-01-01', false) THEN 'mmoa' WHEN day IS NOT NULL THEN 'traditional' ELSE 'unknown' END AS form FROM t)
SELECT id, form, CASE WHEN status IN ('sold', 'withdrawn') THEN 'finished' WHEN form = 'mmoa' OR day IS NULL THEN CASE WHEN status = 'unsold' THEN 'passed_in_play' ELSE 'live' END WHEN day >= DATE '2001-06-01' THEN 'live' ELSE 'passed_in_play' END AS lifecycle FROM f""")
def lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    status = F.when(k % 7 == 0, "unsold").when(k % 7 == 1, "withdrawn").otherwise(F.col("status"))
    day = F.when(k % 8 == 0, F.lit(None)).when(k % 9 == 0, F.lit("2099-12-31").cast("date")).otherwise(F.col("sale_date"))
    form = sale_format(F.when(k % 5 == 0, "always_on"), F.when(k % 6 == 0, "Timed Online").when(k % 6 == 1, "room"), day)
    return listings(spark, sf_dir).select("id", form.alias("form"), lifecycle(status, form, day, F.lit("2001-06-01").cast("date")).alias("lifecycle"))


@query("m07_anchored_estimate", f"""
WITH {SALES}, s AS (SELECT postcode, count(*) AS n, avg(pence)::DOUBLE AS v FROM sales GROUP BY 1), a AS (SELECT district, avg(pence)::DOUBLE AS v FROM sales GROUP BY 1),
p AS (SELECT p_partkey AS id, p_brand AS district, p_size AS size, p_type AS sort FROM part),
k AS (SELECT p.*, coalesce(s.n, 0) AS n, CASE WHEN s.n >= 3 AND size % 4 <> 0 THEN 'street' WHEN a.v IS NOT NULL THEN 'area' END AS source, CASE WHEN s.n >= 3 AND size % 4 <> 0 THEN s.v WHEN a.v IS NOT NULL THEN a.v * CASE sort WHEN 'ECONOMY' THEN 0.65 WHEN 'PROMO' THEN 1.30 ELSE 1.0 END::DOUBLE END AS anchor FROM p LEFT JOIN s ON s.postcode = p.id LEFT JOIN a ON a.district = p.district)
SELECT id, source, floor(anchor / 10000 + 0.5)::BIGINT AS anchor FROM k""")
def anchored_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a value starts: the street's sales if there are three, else the area's average by kind."""
    finest = sales(spark, sf_dir).groupBy("postcode", "district").agg(F.count("*").alias("n"), F.sum("pence").alias("s"))
    street = finest.groupBy(F.col("postcode").alias("p_partkey")).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("street"))
    area = finest.groupBy(F.col("district").alias("p_brand")).agg((F.sum("s") / F.sum("n")).alias("area"))
    rows = load(spark, sf_dir, "part").join(street, "p_partkey", "left").join(area, "p_brand", "left")
    near = (F.col("n") >= 3) & (F.col("p_size") % 4 != 0)
    kind = F.when(F.col("p_type") == "ECONOMY", 0.65).when(F.col("p_type") == "PROMO", 1.30).otherwise(1.0)
    anchor = F.when(near, F.col("street")).otherwise(F.col("area") * kind)
    return rows.select(F.col("p_partkey").alias("id"), F.when(near, "street").when(F.col("area").isNotNull(), "area").alias("source"), F.floor(anchor / 10000 + 0.5).alias("anchor"))


_WEEKS = "w AS (SELECT user_id AS house, CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'base' ELSE 'now' END AS span, event_type, value FROM events), r AS (SELECT house, count(*) FILTER (span = 'base') / 2 AS usual, count(*) FILTER (span = 'now') AS lots, coalesce(round(100.0 * count(*) FILTER (span = 'base' AND value > 60) / nullif(count(*) FILTER (span = 'base'), 0)), 0)::DOUBLE AS was, coalesce(round(100.0 * count(*) FILTER (span = 'now' AND value > 60) / nullif(count(*) FILTER (span = 'now'), 0)), 0)::DOUBLE AS is_, coalesce(round(100.0 * count(*) FILTER (span = 'base' AND event_type = 'click') / nullif(count(*) FILTER (span = 'base'), 0)), 0)::DOUBLE AS had, coalesce(round(100.0 * count(*) FILTER (span = 'now' AND event_type = 'click') / nullif(count(*) FILTER (span = 'now'), 0)), 0)::DOUBLE AS has FROM w GROUP BY 1)"


def week_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usual and present rows of a house, with the percent of two fields in either."""
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("house"), (F.col("ts") < F.lit("2024-01-21").cast("timestamp")).alias("base"), (F.col("event_type") == "click").alias("b"), (F.col("value") > 60).alias("a"))
    base = F.col("base")
    pct = lambda span, field: F.coalesce(F.round(F.try_divide(100.0 * F.count_if(span & F.col(field)), F.count_if(span))), F.lit(0.0))
    return rows.groupBy("house").agg((F.count_if(base) / 2).alias("usual"), F.count_if(~base).alias("lots"), pct(base, "a").alias("was"), pct(~base, "a").alias("is_"), pct(base, "b").alias("had"), pct(~base, "b").alias("has"))


@query("m16_regressions", f"""
WITH {_WEEKS}, v AS (SELECT house, list_filter([CASE WHEN usual > 5 AND lots < 0.5 * usual THEN 'error:lots' WHEN usual > 5 AND lots < 0.8 * usual THEN 'warning:lots' END, CASE WHEN was > 30 AND was - is_ > 10 THEN 'warning:images' END,
  CASE WHEN had >= 10 AND had - has > 15 THEN 'warning:field' END, CASE WHEN had > 15 AND has = 0 THEN 'warning:lost' END], lambda x: x IS NOT NULL) AS reasons FROM r)
SELECT house, array_to_string(reasons, ',') AS reasons, CASE WHEN list_contains(reasons, 'error:lots') THEN 'regression' WHEN len(reasons) > 0 THEN 'degraded' ELSE 'healthy' END AS verdict FROM v""")
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fell since the weeks before: rows, images, a field, or a field wholly, and what that makes of a house."""
    return R.regressed(week_coverage(spark, sf_dir), images=10, field=15, known=10, lost=15).select("house", F.array_join("reasons", ",").alias("reasons"), "verdict")


@query("m17_gates", f"""
WITH {_WEEKS}, g AS (SELECT *, CASE WHEN usual > 0 THEN greatest(0, least(1, lots / usual)) END AS recall, CASE WHEN usual > 0 THEN greatest(0, least(1, lots * 0.9::DOUBLE / usual)) END AS rival, floor(lots * 0.9::DOUBLE + (house % 3))::INT AS found FROM r)
SELECT house, CASE WHEN recall IS NULL OR recall >= 0.98 THEN 'info' WHEN recall < 0.85 THEN 'error' ELSE 'warning' END AS severity, coalesce(recall < 0.85, false) AS escalate,
  CASE WHEN recall IS NULL THEN 'no signal' WHEN lots < 5 THEN 'too few' WHEN found < lots THEN 'found fewer' WHEN rival >= recall THEN 'parity' ELSE 'shortfall' END AS demotion,
  coalesce(recall IS NOT NULL AND lots >= 5 AND found >= lots AND rival >= recall, false) AND is_ >= was AND NOT (was > 30 AND was - is_ > 10) AS promote FROM g""")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall against the usual count: its severity, whether to climb, and whether a cheaper way may take over."""
    share = lambda n: F.when(F.col("usual") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), n / F.col("usual"))))
    rows = week_coverage(spark, sf_dir).withColumns({"recall": share(F.col("lots")), "rival": share(F.col("lots") * 0.9), "found": F.floor(F.col("lots") * 0.9 + F.col("house") % 3).cast("int")})
    demote = R.demotion(F.col("recall"), F.col("rival"), F.col("lots"), F.col("found"))
    promote = (demote == "parity") & (F.col("is_") >= F.col("was")) & ~((F.col("was") > 30) & (F.col("was") - F.col("is_") > 10))
    return rows.select("house", R.recall_severity(F.col("recall")).alias("severity"), F.coalesce(F.col("recall") < R.ERROR_FLOOR, F.lit(False)).alias("escalate"), demote.alias("demotion"), promote.alias("promote"))


@query("m19_class_drift", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, html, lead(page_id) OVER (PARTITION BY regexp_extract(url, '://([^/?#]+)', 1) ORDER BY page_id) AS nxt FROM pages),
w AS (SELECT page_id, list_sort(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(html, '(?i)class\s*=\s*["'']([^"'']+)["'']', 1), lambda x: regexp_split_to_array(x, '\s+'))), lambda x: x <> ''))) AS vocab, len(regexp_extract_all(html, '(?i)<a\s')) AS links FROM p)
SELECT p.page_id, p.nxt AS next_id, len(a.vocab)::INT AS vocab, a.links::INT AS links, CASE WHEN nxt IS NOT NULL THEN CASE WHEN len(a.vocab) + len(b.vocab) = 0 THEN 1.0 ELSE round(len(list_intersect(a.vocab, b.vocab))::DOUBLE / len(list_distinct(list_concat(a.vocab, b.vocab))), 2) END END AS similarity,
  nxt IS NOT NULL AND coalesce(CASE WHEN len(a.vocab) + len(b.vocab) = 0 THEN 1.0 ELSE round(len(list_intersect(a.vocab, b.vocab))::DOUBLE / len(list_distinct(list_concat(a.vocab, b.vocab))), 2) END < 0.5 OR (a.links >= 5 AND b.links = 0), false) AS drift FROM p JOIN w a USING (page_id) LEFT JOIN w b ON b.page_id = p.nxt""")
def class_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class words and link counts of a page against the host's next one: drift where words change or links vanish."""
    words = F.flatten(F.transform(F.regexp_extract_all("html", F.lit("(?i)class\\s*=\\s*[\"']([^\"']+)[\"']"), 1), lambda x: F.split(x, r"\s+")))
    rows = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), F.array_sort(F.array_distinct(F.filter(words, lambda x: x != ""))).alias("vocab"), F.regexp_count("html", F.lit(r"(?i)<a\s")).alias("links"))
    nxt = F.lead(F.struct("page_id", "vocab", "links")).over(Window.partitionBy("host").orderBy("page_id"))
    rows = rows.withColumn("b", nxt)
    all_ = F.size(F.array_union("vocab", "b.vocab"))
    alike = F.when(F.col("b").isNotNull(), F.when(all_ == 0, 1.0).otherwise(F.round(F.size(F.array_intersect("vocab", "b.vocab")) / all_, 2)))
    return rows.select("page_id", F.col("b.page_id").alias("next_id"), F.size("vocab").alias("vocab"), "links", alike.alias("similarity"), F.coalesce((alike < 0.5) | ((F.col("links") >= 5) & (F.col("b.links") == 0)), F.lit(False)).alias("drift"))


_STATES = "s AS (SELECT k AS key, event_id AS seq, event_type AS status, CASE WHEN value < 40 THEN NULL ELSE floor(value)::DOUBLE END AS price, CASE WHEN event_type = 'purchase' THEN floor(value)::DOUBLE END AS sold_price, CASE WHEN value < 20 THEN 'poa' WHEN value < 40 THEN 'tba' ELSE 'guide' END AS price_status FROM ev)"


@query("r01_six_changes", f"""
WITH {EVENTS}, {_STATES}, l AS (SELECT *, row_number() OVER w AS n, lag(status) OVER w AS p1, lag(price) OVER w AS p2, lag(sold_price) OVER w AS p3, lag(price_status) OVER w AS p4, max(seq) OVER (PARTITION BY key) AS last FROM s WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT key, seq, 'first_seen' AS change FROM l WHERE n = 1 UNION ALL SELECT key, seq, 'status' FROM l WHERE n > 1 AND status IS DISTINCT FROM p1 UNION ALL SELECT key, seq, 'price' FROM l WHERE n > 1 AND price IS DISTINCT FROM p2
UNION ALL SELECT key, seq, 'sold_price' FROM l WHERE n > 1 AND sold_price IS DISTINCT FROM p3 UNION ALL SELECT key, seq, 'price_status' FROM l WHERE n > 1 AND price_status IS DISTINCT FROM p4 UNION ALL SELECT key, seq, 'vanished' FROM l WHERE seq = last AND status = 'error'""")
def six_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of change between a key's states; nulls are values; a key whose last state is gone has vanished."""
    v = F.col("value")
    states = events(spark, sf_dir).select(F.col("k").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.when(v >= 40, F.floor(v).cast("double")).alias("price"), F.when(F.col("event_type") == "purchase", F.floor(v).cast("double")).alias("sold_price"), F.when(v < 20, "poa").when(v < 40, "tba").otherwise("guide").alias("price_status"))
    last = states.groupBy("key").agg(F.max_by(F.struct("seq", "status"), "seq").alias("l")).where("l.status = 'error'")
    gone = last.select("key", "l.seq", F.lit("vanished").alias("change"))
    return change_events(states, ("status", "price", "sold_price", "price_status")).select("key", "seq", "change").unionByName(gone)


@query("r05_findings_expiry", """
WITH f AS (SELECT user_id % 50 AS fingerprint, ts, row_number() OVER w AS n, ts - lag(ts) OVER w > INTERVAL 5 DAY AS lapsed FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id % 50 ORDER BY ts, event_id)),
g AS (SELECT *, sum(coalesce(lapsed, false)::INT) OVER (PARTITION BY fingerprint ORDER BY n) AS life FROM f)
SELECT fingerprint, life::BIGINT AS life, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, CASE WHEN max(ts) + INTERVAL 5 DAY < TIMESTAMP '2024-01-31' THEN 'expired' ELSE 'open' END AS state FROM g GROUP BY 1, 2""")
def findings_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by fingerprint with a count; one unseen for five days expires, and opens anew when seen again."""
    w = Window.partitionBy("fingerprint").orderBy("ts", "event_id")
    rows = load(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("user_id") % 50).alias("fingerprint"), "ts", "event_id")
    ttl = F.expr("INTERVAL 5 DAYS")
    lives = rows.withColumn("lapsed", F.coalesce(F.col("ts") - F.lag("ts").over(w) > ttl, F.lit(False))).withColumn("life", F.sum(F.col("lapsed").cast("int")).over(w))
    per = lives.groupBy("fingerprint", "life").agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return per.withColumn("state", F.when(F.col("last_seen") + ttl < F.lit("2024-01-31").cast("timestamp"), "expired").otherwise("open"))


@query("e02_six_cohorts", """
WITH l AS (SELECT c_custkey AS id, c_nationkey % 20 AS house, c_custkey % 9 AS url, c_acctbal > 5000 AS live, c_acctbal < 0 AS inactive FROM customer), c AS (SELECT s_nationkey AS house, s_suppkey % 12 AS url FROM supplier WHERE s_nationkey < 18),
e AS (SELECT house, url, count(*) AS n FROM c GROUP BY 1, 2), m AS (SELECT house, url % 3 AS norm, count(*) AS n FROM c GROUP BY 1, 2), h AS (SELECT house, count(*) AS n FROM c GROUP BY 1),
k AS (SELECT l.*, CASE WHEN e.n = 1 THEN 'exact_unique' WHEN e.n > 1 THEN 'exact_multi' WHEN m.n >= 1 THEN 'normalised_only' WHEN h.n IS NULL THEN 'no_house' ELSE 'mismatch' END AS cohort FROM l LEFT JOIN e ON e.house = l.house AND e.url = l.url LEFT JOIN m ON m.house = l.house AND m.norm = l.url % 3 LEFT JOIN h ON h.house = l.house)
SELECT cohort, count(*) AS n, count(*) FILTER (live) AS live, count(*) FILTER (NOT live AND NOT inactive) AS archival, count(*) FILTER (inactive) AS inactive FROM k GROUP BY 1""")
def six_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each listing meets a calendar: exactly once, more often, by its normal form, not at all, or its house has none."""
    c = load(spark, sf_dir, "supplier").where("s_nationkey < 18").groupBy(F.col("s_nationkey").alias("house"), (F.col("s_suppkey") % 12).alias("url")).agg(F.count("*").alias("exact"))
    norm = c.groupBy("house", (F.col("url") % 3).alias("norm")).agg(F.sum("exact").alias("normal"))
    house = c.groupBy("house").agg(F.sum("exact").alias("any"))
    lots = load(spark, sf_dir, "customer").select((F.col("c_nationkey") % 20).alias("house"), (F.col("c_custkey") % 9).alias("url"), F.col("c_acctbal").alias("b")).withColumn("norm", F.col("url") % 3)
    joined = lots.join(c, ["house", "url"], "left").join(norm, ["house", "norm"], "left").join(house, "house", "left")
    cohort = F.when(F.col("exact") == 1, "exact_unique").when(F.col("exact") > 1, "exact_multi").when(F.col("normal") >= 1, "normalised_only").when(F.col("any").isNull(), "no_house").otherwise("mismatch")
    b = F.col("b")
    return joined.groupBy(cohort.alias("cohort")).agg(F.count("*").alias("n"), F.count_if(b > 5000).alias("live"), F.count_if(b.between(0, 5000)).alias("archival"), F.count_if(b < 0).alias("inactive"))


@query("e05_status_drift", f"""
WITH {LISTINGS}, s AS (SELECT id, house, status, CASE WHEN id % 6 = 0 THEN 'sold' ELSE status END AS now FROM listings QUALIFY row_number() OVER (PARTITION BY house, status = 'available' ORDER BY md5(id::VARCHAR), id) <= CASE WHEN status = 'available' THEN 4 ELSE 1 END)
SELECT house, count(*) AS sampled, count(*) FILTER (now <> status) AS drifted, CASE WHEN count(*) FILTER (now <> status) >= 3 THEN 'error' WHEN count(*) FILTER (now <> status) >= 1 THEN 'warning' ELSE 'info' END AS severity FROM s GROUP BY 1""")
def status_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of each house read anew: how many rows have another status now."""
    from .stats import stratified

    now = F.when(F.col("id") % 6 == 0, "sold").otherwise(F.col("status"))
    rows = stratified(listings(spark, sf_dir).select("id", "house", "status")).withColumn("drifted", now != F.col("status"))
    n = F.count_if("drifted")
    return rows.groupBy("house").agg(F.count("*").alias("sampled"), n.alias("drifted"), F.when(n >= 3, "error").when(n >= 1, "warning").otherwise("info").alias("severity"))


GENERIC = ["street", "road", "avenue", "lane", "drive", "close", "court", "place", "boulevard", "house", "apartment", "flat"]
_CLAIMS = ["14 Mill Lane, Whitby LS1 1AA", "The Paddock", "2 High Street, Newquay", "9 Station Road", "Quay House, Dock Lane"]
_PAGES = ["a mill by the lane in whitby", "ls11aa is the code", "the paddock lies here", "station house on the road", "dock and quay lane", "high street in newquay"]


@query("e10_grounded_rows", f"""
WITH t AS (SELECT c_custkey AS id, {_CLAIMS}[c_custkey % 5 + 1] AS a, {_PAGES}[c_custkey % 6 + 1] AS page FROM customer),
k AS (SELECT *, lower(regexp_replace(regexp_extract(a, '\\b[A-Z]{{1,2}}[0-9]{{1,2}}[A-Z]?\\s*[0-9][A-Z]{{2}}\\b'), '\\s', '', 'g')) AS code, list_distinct(regexp_extract_all(lower(a), '[a-z]{{4,}}')) AS tokens FROM t),
h AS (SELECT *, list_filter(tokens, lambda x: contains(page, x)) AS hits FROM k)
SELECT id, (code <> '' AND contains(page, code)) OR (len(list_filter(hits, lambda x: NOT list_contains({GENERIC}, x))) > 0 AND (len(hits) >= 2 OR len(tokens) = 1)) AS grounded FROM h""")
def grounded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a row evidenced in its page: by its postcode, or by two words of which one tells."""
    k = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(k.alias("id"), _pick(_CLAIMS, k % 5).alias("a"), _pick(_PAGES, k % 6).alias("page"))
    code = F.lower(F.regexp_replace(F.regexp_extract("a", r"\b[A-Z]{1,2}[0-9]{1,2}[A-Z]?\s*[0-9][A-Z]{2}\b", 0), r"\s", ""))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("a"), F.lit("[a-z]{4,}"), 0))
    hits = F.filter(tokens, lambda x: F.col("page").contains(x))
    telling = F.filter(hits, lambda x: ~x.isin(*GENERIC))
    return rows.select("id", (((code != "") & F.col("page").contains(code)) | ((F.size(telling) > 0) & ((F.size(hits) >= 2) | (F.size(tokens) == 1)))).alias("grounded"))


@query("u07_recall_release", f"""
WITH {LISTINGS}, w AS (SELECT id, house, prop_type, sale_date FROM listings WHERE status <> 'sold' AND sale_date >= DATE '2001-06-01'),
h AS (SELECT house, max(sale_date) AS scraped, count(*) FILTER (sale_date >= DATE '2001-07-29') AS fresh, count(*) FILTER (sale_date < DATE '2001-07-29') AS ghosts FROM w GROUP BY 1), c AS (SELECT house, prop_type, max(sale_date) AS scraped FROM w GROUP BY 1, 2)
SELECT id, CASE WHEN w.sale_date >= DATE '2001-07-29' THEN 'keep' WHEN h.scraped < DATE '2001-07-30' THEN 'unconfirmed' WHEN c.scraped < DATE '2001-07-20' THEN 'catalogue unread' WHEN fresh < ghosts AND NOT contains(w.house, '1') THEN 'held' ELSE 'flip' END AS verdict
FROM w JOIN h ON h.house = w.house JOIN c ON c.house = w.house AND c.prop_type = w.prop_type""")
def recall_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ghosts as ``u07_ghosts``, but a row's own catalogue must have been read, and a reading of full recall frees a held house."""
    rows = listings(spark, sf_dir).where("status <> 'sold' AND sale_date >= DATE '2001-06-01'").select("id", "house", "prop_type", "sale_date")
    stale = F.col("sale_date") < F.date_sub(today(), 4)
    finest = rows.groupBy("house", "prop_type").agg(F.max("sale_date").alias("read"), F.count_if(~stale).alias("f"), F.count_if(stale).alias("g"))
    house = finest.groupBy("house").agg(F.max("read").alias("scraped"), F.sum("f").alias("fresh"), F.sum("g").alias("ghosts"))
    joined = rows.join(finest.select("house", "prop_type", "read"), ["house", "prop_type"]).join(house, "house")
    proven = F.col("house").contains("1")
    verdict = F.when(~stale, "keep").when(F.col("scraped") < F.date_sub(today(), 3), "unconfirmed").when(F.col("read") < F.date_sub(today(), 13), "catalogue unread").when((F.col("fresh") < F.col("ghosts")) & ~proven, "held").otherwise("flip")
    return joined.select("id", verdict.alias("verdict"))
