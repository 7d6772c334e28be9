"""Deals: what a narrative says of income, rooms and titles, the whole score, rents, and what a deal is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import deals as D
from ..functions import signals as S
from ..functions import text as T
from ..registry import query
from ..sources.tables import LISTINGS, listings, load, spread

#: Narratives of the registered queries; each listing has two of them.
TEXTS = [
    "a six bedroom hmo producing £47,700 per annum, fully let to working professionals.",
    "ground rent £250 pa and service charge £1,800 per annum payable to the freeholder.",
    "let at £975pcm on an assured shorthold. 3 ensuite bathrooms.",
    "could achieve £1,450 per calendar month when let. block of 12 flats.",
    "the shop with flats above, rent reserved £81,845 pa. freehold and arranged as 4 x two bed flats.",
    "vacant possession. requires repair throughout. 5 of 6 rooms with en-suite.",
    "sold subject to planning permission being granted for six units. scope to extend.",
    "planning permission has been granted for two dwellings, cash buyers only.",
    "by order of the mortgagees in possession. 62 years unexpired. japanese knotweed.",
    "by order of leeds city council. en-suite to every bedroom.",
    "regulated tenancy at £95 pw, registered fair rent. sitting tenant.",
    "holiday let, airbnb income of £31,200 p.a. plus service charge. 840 sq ft.",
    "executor sale, en-suites to two rooms. grade ii listed.",
    "bedroom 3 en-suite shower room. in good decorative order, move in ready.",
    "no income details. £2,000,001 pa claimed. flood zone 3.",
    "joint lpa receivers. mixed-use building, £12,000 pa service charge.",
    "a derelict cottage of 1,250 sq feet. completion within a 6 week completion.",
]
KINDS, TENURES = ["house", "flat", "land", "commercial"], ["Freehold", "Leasehold", None]


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing for each customer: ``id, beds, kind, tenure, lease, price, t``."""
    k, n = F.col("c_custkey"), len(TEXTS)
    return spread(load(spark, sf_dir, "customer").select("c_custkey")).select(
        k.alias("id"),
        F.nullif(k % 8, F.lit(0)).cast("int").alias("beds"),
        _pick(KINDS, k % 4).alias("kind"),
        _pick(TENURES, k % 3).alias("tenure"),
        F.when(k % 10 == 0, 60 + k % 50).cast("int").alias("lease"),
        F.when(k % 11 != 0, (k % 400 + 20) * 1000).cast("double").alias("price"),
        F.concat(_pick(TEXTS, k % n), F.lit(" "), _pick(TEXTS, F.floor(k / n) % n)).alias("t"),
    )


def _sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _num(x: str) -> str:
    return f"coalesce(try_cast({x} AS INT), nullif(coalesce(list_position({_sql_list(S.WORDS)}, {x}), 0), 0)::INT)"


TOLD = f"""told AS (SELECT c_custkey AS id, nullif(c_custkey % 8, 0)::INT AS beds, {_sql_list(KINDS)}[c_custkey % 4 + 1] AS kind, {_sql_list(TENURES)}[c_custkey % 3 + 1] AS tenure,
  CASE WHEN c_custkey % 10 = 0 THEN (60 + c_custkey % 50)::INT END AS lease, CASE WHEN c_custkey % 11 <> 0 THEN ((c_custkey % 400 + 20) * 1000)::DOUBLE END AS price,
  {_sql_list(TEXTS)}[c_custkey % {len(TEXTS)} + 1] || ' ' || {_sql_list(TEXTS)}[c_custkey // {len(TEXTS)} % {len(TEXTS)} + 1] AS t FROM customer)"""
_INCOME = rf"""
ms AS (SELECT id, t, regexp_split_to_array(t, '{S.INCOME}') AS gaps, regexp_extract_all(t, '{S.INCOME}', 0) AS found, regexp_extract_all(t, '{S.INCOME}', 1) AS am, regexp_extract_all(t, '{S.INCOME}', 2) AS pe FROM told),
mi AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM ms),
mw AS (SELECT id, t, found[i] AS m, am[i] AS a, replace(regexp_replace(pe[i], '\s+', ' ', 'g'), '.', '') AS p, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0))::BIGINT AS st FROM mi),
mb AS (SELECT id, m, replace(a, ',', '')::BIGINT * CASE WHEN p IN {S.MONTHLY} THEN 12 WHEN p IN {S.WEEKLY} THEN 52 ELSE 1 END AS annual, substring(t, greatest(st - {S.BEFORE}, 0) + 1, least(st, {S.BEFORE})) AS b, substring(t, st + length(m) + 1, {S.AFTER}) AS af FROM mw),
mk AS (SELECT id, annual, CASE WHEN regexp_matches(b || m || af, '{S.POTENTIAL}') THEN 'potential' WHEN regexp_matches(b || m || af, '{S.PASSING}') THEN 'passing' ELSE 'potential' END AS kind FROM mb
  WHERE NOT regexp_matches(b, '{S.COST_BEFORE}') AND NOT regexp_matches(af, '{S.COST_AFTER}') AND annual BETWEEN {S.LEAST_PA} AND {S.MOST_PA}),
mx AS (SELECT id, max(annual) FILTER (kind = 'passing') AS pas, max(annual) FILTER (kind = 'potential') AS pot FROM mk GROUP BY id),
inc AS (SELECT told.*, coalesce(pas, pot) AS income, CASE WHEN pas IS NOT NULL THEN 'passing' WHEN pot IS NOT NULL THEN 'potential' END AS income_kind FROM told LEFT JOIN mx USING (id))"""
_HIT = lambda p: f"regexp_matches(t, '{p}')"
_SIGNALS = rf"""{_INCOME},
e1 AS (SELECT *, greatest(coalesce(list_max(list_transform(regexp_extract_all(regexp_replace(t, '{S.ROOM_LABEL}', '\1\3', 'g'), '{S.ENSUITE}', 1), lambda x: {_num("x")})), 0), coalesce({_num(f"regexp_extract(t, '{S.ENSUITE_OF}', 1)")}, 0)) AS n1,
  least(100, greatest(coalesce(try_cast(regexp_extract(t, '{S.UNITS}', 1) AS INT), 0), coalesce(try_cast(regexp_extract(t, '{S.BLOCK_OF}', 1) AS INT), 0), coalesce(list_sum(list_transform(regexp_extract_all(t, '{S.TIMES_BEDS}', 1), lambda x: x::INT)), 0))) % 100 AS units FROM inc),
e2 AS (SELECT *, CASE WHEN {_HIT(S.ENSUITE_ALL)} THEN greatest(n1, coalesce(beds, 2)) ELSE n1 END AS n2, units >= 2 OR (contains(t, 'freehold') AND {_HIT(S.FLATS)}) OR {_HIT(S.SOLD_SINGLY)} AS split FROM e1),
e3 AS (SELECT *, CASE WHEN n2 > 0 THEN n2 WHEN {_HIT("en[\\s-]?suites\\b")} THEN 2 WHEN {_HIT("en[\\s-]?suite\\b")} THEN 1 ELSE 0 END AS n3 FROM e2),
e4 AS (SELECT *, CASE WHEN beds > 0 THEN least(n3, beds) ELSE n3 END AS ens FROM e3),
e5 AS (SELECT *, {_HIT(S.HMO)} OR (coalesce(beds, 0) >= 5 AND kind = 'house' AND (ens >= 3 OR {_HIT(S.MULTI_LET)})) AS hmo,
  coalesce(lease, CASE WHEN NOT coalesce(contains(lower(tenure), 'freehold'), false) THEN try_cast(regexp_extract(t, '{S.SHORT_LEASE}', 1) AS INT) END) AS years, coalesce(income_kind = 'passing', false) AS passing FROM e4),
sig AS (SELECT *, list_filter([CASE WHEN hmo THEN 'hmo' END, CASE WHEN hmo AND (coalesce(beds, 0) >= 6 OR ens >= 3 OR passing OR {_HIT(S.HMO_PLANNING)}) THEN 'investment-valuation' END,
  CASE WHEN income IS NOT NULL THEN 'income-stated' END, CASE WHEN split THEN 'title-split' END, CASE WHEN years BETWEEN 1 AND 79 THEN 'short-lease' END, CASE WHEN {_HIT(S.MIXED_USE)} OR {_HIT(S.SHOP_UPPERS)} THEN 'mixed-use' END,
  CASE WHEN {_HIT(S.CASH_ONLY)} THEN 'cash-buyers-only' END, CASE WHEN {_HIT(S.GRANTED)} AND NOT {_HIT(S.NOT_GRANTED)} THEN 'planning-granted' END, CASE WHEN {_HIT(S.REGULATED)} THEN 'regulated-tenancy' END,
  CASE WHEN {_HIT(S.HOLIDAY)} THEN 'holiday-let' END, CASE WHEN {_HIT(S.PROBATE)} THEN 'probate' END, CASE WHEN {_HIT(S.RECEIVER)} AND NOT {_HIT(S.REPOSSESSED)} THEN 'receivership' END,
  CASE WHEN {_HIT(S.REPOSSESSED)} THEN 'repossession' END, CASE WHEN {_HIT(S.PUBLIC)} THEN 'public-sector-disposal' END], lambda x: x IS NOT NULL) AS labels FROM e5)"""


@query("m05_stated_income", f"WITH {TOLD},{_INCOME} SELECT id, income, income_kind FROM inc")
def stated_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = told(spark, sf_dir).select("id", S.incomes(F.col("t")).alias("found")).select("id", S.stated_income(F.col("found")).alias("i"))
    return rows.select("id", F.col("i.annual").alias("income"), F.col("i.kind").alias("income_kind"))


@query("m06_deal_signals", f"WITH {TOLD},{_SIGNALS} SELECT id, ens AS n_ensuites, array_to_string(labels, ',') AS labels FROM sig")
def deal_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.signalled(told(spark, sf_dir)).select("id", "n_ensuites", F.array_join("labels", ",").alias("labels"))


def _points_sql() -> str:
    giy = "CASE WHEN income_kind = 'passing' AND units <= 1 THEN income / price * 100 END"
    gains = [("state = 'needs work'", 2), ("state = 'poor'", 2.5), (_HIT(S.PROBATE), 1.5), (_HIT(S.RECEIVER), 2), ("develops AND kind <> 'land'", 2), ("develops AND kind = 'land'", 0.5), (_HIT(S.EXTENDS), 1.5)]
    gains += [("empty AND kind IN ('house', 'flat')", 1), ("tenure = 'Freehold' AND kind = 'house'", 0.5), ("area < 200", 2), ("area >= 200 AND area < 300", 1), ("giy > 8", 2.5), ("giy > 6 AND giy <= 8", 1.5)]
    gains += [(_HIT("(?:4|5|6)\\s*week\\s*completion|six week"), 0.5), (f"{_HIT(S.BY_ORDER)} AND NOT {_HIT(S.PROBATE)} AND NOT {_HIT(S.RECEIVER)}", 0.5), ("split", 1), ("list_contains(labels, 'investment-valuation')", 1)]
    total = " + ".join(f"CASE WHEN {w} THEN {float(p)}::DOUBLE ELSE 0 END" for w, p in gains + [(_HIT(p), n) for _, n, p in T.SIGNALS if n < 0])
    risks = ", ".join(f"CASE WHEN {_HIT(p)} THEN '{name}' END" for name, n, p in T.SIGNALS if n < 0)
    state = f"CASE WHEN {_HIT(T.POOR)} THEN 'poor' WHEN {_HIT(S.NEEDS_WORK)} THEN 'needs work' WHEN {_HIT(S.GOOD_ORDER)} THEN 'good' END"
    deal = f"CASE WHEN develops THEN 'Development' WHEN hmo THEN 'HMO' WHEN state IN ('needs work', 'poor') AND {_HIT(S.EXTENDS)} THEN 'Refurb+Extend' WHEN state IN ('needs work', 'poor') THEN 'Refurb' WHEN split THEN 'Title Split' WHEN {_HIT(S.PROBATE)} OR {_HIT(S.RECEIVER)} THEN 'Motivated' ELSE 'Standard' END"
    return f"""
WITH {TOLD},{_SIGNALS},
f AS (SELECT *, {state} AS state, CASE WHEN {_HIT(S.EMPTY)} THEN true WHEN {_HIT(S.TENANTED)} THEN false END AS empty, {_HIT(S.DEVELOPS)} AS develops, {giy} AS giy,
  CASE WHEN kind <> 'land' THEN price / try_cast(nullif(replace(regexp_extract(t, '{S.SQFT}', 1), ',', ''), '') AS DOUBLE) END AS area FROM sig)
SELECT id, units, state AS condition, greatest(0.0::DOUBLE, least(10.0::DOUBLE, floor(({total}) * 10 + 0.5) / 10)) AS score, {deal} AS deal_type,
  array_to_string(list_filter([{risks}, CASE WHEN {_HIT(S.LISTED)} THEN 'Listed building' END, CASE WHEN price IS NULL THEN 'Guide TBA' END], lambda x: x IS NOT NULL), ',') AS risks FROM f"""


@query("m04_whole_analysis", _points_sql())
def whole_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals, points, risks and the deal type of a narrative."""
    rows = S.scored(S.signalled(told(spark, sf_dir)))
    return rows.select("id", "units", F.col("state").alias("condition"), F.col("points").alias("score"), "deal_type", F.array_join("risks", ",").alias("risks"))


@query("m08_rent_estimate", f"""
WITH t AS (SELECT c_custkey AS id, {_sql_list(D.PLACES)}[c_custkey % {len(D.PLACES)} + 1] AS address, nullif(c_custkey % 7, 6)::INT AS beds, (c_custkey % 5)::INT AS units FROM customer),
r(k, place, rents, uplift) AS (VALUES {", ".join(f"({i}, '{p}', {D.RENTS[p]}, {D.UPLIFT.get(p, D.UPLIFT[None])}::DOUBLE)" for i, p in enumerate(p for p in D.RENTS if p))}),
b AS (SELECT *, CASE WHEN units >= 2 THEN units ELSE 1 END AS n, least(greatest(CASE WHEN units >= 2 THEN CASE WHEN beds IS NULL THEN 2 ELSE greatest(1, floor(beds / units + 0.5)::INT) END ELSE coalesce(beds, 2) END, 0), 4) AS per FROM t),
f AS (SELECT b.*, min_by(rents, k) FILTER (contains(address, place)) AS rents, min_by(uplift, k) FILTER (contains(address, place)) AS uplift FROM b CROSS JOIN r GROUP BY ALL)
SELECT id, floor(coalesce(rents, {D.RENTS[None]})[per + 1] * coalesce(uplift, {D.UPLIFT[None]}::DOUBLE) * n + 0.5)::BIGINT AS rent FROM f""")
def rent_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(k.alias("id"), _pick(D.PLACES, k % len(D.PLACES)).alias("address"), F.nullif(k % 7, F.lit(6)).cast("int").alias("beds"), (k % 5).cast("int").alias("units"))
    return rows.select("id", D.monthly_rent(F.col("address"), F.col("beds"), F.col("units")).alias("rent"))


@query("m09_below_market", f"""
WITH {LISTINGS}, a AS (SELECT house, prop_type, avg(price) AS street FROM listings GROUP BY 1, 2),
t AS (SELECT id, price::DOUBLE AS p, street, prop_type IN ('BUILDING', 'FURNITURE') AS sure, owner % 9 > 6 AS block, (owner % 900 + 400) * 12 AS rent FROM listings JOIN a USING (house, prop_type)),
d AS (SELECT *, (street - p) / street * 100 AS off, floor(rent / (p / 10) * 1000 + 0.5) / 10 AS gross FROM t)
SELECT id, CASE WHEN NOT block THEN floor(off + 0.5)::BIGINT END AS below_pct,
  CASE WHEN block OR NOT sure OR off >= 70 THEN 0.0 WHEN off > 20 THEN 2.0 WHEN off > 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS points,
  CASE WHEN block THEN NULL WHEN off >= 70 THEN 'far below local prices' WHEN off < -10 THEN 'above market' END AS risk,
  CASE WHEN block OR gross > 30 OR off >= 70 THEN 0.0 WHEN gross > 8 THEN 2.5 WHEN gross > 6 THEN 1.5 ELSE 0.0 END::DOUBLE AS yield_points FROM d""")
def below_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    street = rows.groupBy("house", "prop_type").agg(F.avg("price").cast("double").alias("street"))
    t = rows.join(street, ["house", "prop_type"]).select("id", F.col("price").cast("double").alias("p"), "street", F.col("prop_type").isin("BUILDING", "FURNITURE").alias("sure"), (F.col("owner") % 9 > 6).alias("block"), ((F.col("owner") % 900 + 400) * 12).alias("rent"))
    pct, points, risk = D.below_market(F.col("p"), F.col("street"), F.col("sure"), F.col("block"))
    return t.select("id", pct.alias("below_pct"), points.alias("points"), risk.alias("risk"), D.yield_points(F.col("rent"), F.col("p") / 10, F.col("street") / 10, F.col("block")).alias("yield_points"))


_DEAL = f"""t AS (SELECT id, floor(price)::BIGINT AS price, {_sql_list(D.SORTS)}[owner % {len(D.SORTS)} + 1] AS sort, {_sql_list(D.STATES)}[id % {len(D.STATES)} + 1] AS state, {_sql_list(D.ADDRESSES)}[owner % {len(D.ADDRESSES)} + 1] AS address FROM listings),
m AS (SELECT *, coalesce({D.sql_map(D.TYPES, "lower(sort)")}, 'residential') AS kind, {D.sql_works("state")} AS works_pct, {D.sql_place("address")} AS place FROM t),
d AS (SELECT id, price, kind, place, works_pct IS NOT NULL AS refurb, floor(price * ({D.sql_map(D.LTV, "kind")} / 100.0::DOUBLE) + 0.5)::BIGINT AS loan, floor(price * works_pct + 0.5)::BIGINT AS works FROM m)"""


@query("m13_derived_deal", f"""
WITH {LISTINGS}, {_DEAL} SELECT id, kind, place, refurb, loan, works, CASE WHEN refurb THEN floor(price + works + price * 0.15::DOUBLE + 0.5)::BIGINT ELSE price END AS gdv, CASE WHEN refurb THEN 'medium' ELSE 'high' END AS confidence FROM d""")
def derived_deal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir).select("id", "kind", "place", "refurb", "loan", "works", "gdv", F.when(F.col("refurb"), "medium").otherwise("high").alias("confidence"))


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("id", F.floor("price").cast("bigint").alias("price"), _pick(D.SORTS, F.col("owner") % len(D.SORTS)).alias("sort"), _pick(D.STATES, F.col("id") % len(D.STATES)).alias("state"), _pick(D.ADDRESSES, F.col("owner") % len(D.ADDRESSES)).alias("address"))
    return D.derived(rows)


@query("m12_deal_verdict", f"""
WITH {LISTINGS}, {_DEAL},
g AS (SELECT *, CASE WHEN refurb THEN floor(price + works + price * 0.15::DOUBLE + 0.5)::BIGINT ELSE price END AS gdv, coalesce(works, 0) AS w FROM d),
c AS (SELECT *, price + w * 1.1::DOUBLE + floor(price * 0.05::DOUBLE + 0.5) + 3500 + loan * 0.0095::DOUBLE * 6 AS cost, price + w * 1.1::DOUBLE + floor(price * 0.05::DOUBLE + 0.5) + 3500 + loan * 0.0095::DOUBLE * 9 AS hard FROM g)
SELECT id, floor((gdv * 0.985::DOUBLE - cost) * 100 + 0.5) / 100 AS profit, floor((gdv * 0.9::DOUBLE * 0.985::DOUBLE - hard) * 100 + 0.5) / 100 AS stressed, gdv * 0.985::DOUBLE - cost > 0 AND gdv * 0.9::DOUBLE * 0.985::DOUBLE - hard > 0 AND (gdv * 0.985::DOUBLE - cost) / (cost - loan) * 100 >= 20 AS stacks FROM c""")
def deal_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a purchase, its works and its sale leave a fifth on the cash, also if it sells for a tenth less and later?"""
    return D.verdict(_derived(spark, sf_dir)).select("id", *[(F.floor(F.col(c) * 100 + 0.5) / 100).alias(c) for c in ("profit", "stressed")], "stacks")


@query("m14_post_fixes", f"""
WITH {LISTINGS}, t AS (SELECT id, floor(price)::BIGINT // 20 AS price, {_sql_list(D.STATES)}[id % {len(D.STATES)} + 1] AS state, prop_type AS sort, owner % 3 = 0 AS freehold, sale_date FROM listings)
SELECT id, CASE WHEN price < 1000 THEN 'token guide' WHEN price < 3000 THEN 'low guide' END AS risk, CASE WHEN sort = 'FURNITURE' THEN 'house' WHEN sort = 'MACHINERY' THEN 'commercial' ELSE lower(sort) END AS kind,
  array_to_string(list_filter([CASE WHEN freehold THEN 'Freehold' END, CASE WHEN state = 'poor' THEN 'Poor condition' END], lambda x: x IS NOT NULL), ',') AS opps, DATE '2001-08-02' - sale_date AS days_since FROM t""")
def post_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, sort = F.expr("CAST(floor(price) AS BIGINT) DIV 20"), F.col("prop_type")
    state = _pick(D.STATES, F.col("id") % len(D.STATES))
    tags = F.array_compact(F.array(F.when(F.col("owner") % 3 == 0, "Freehold"), F.when(state == "poor", "Poor condition")))
    return listings(spark, sf_dir).select(
        "id",
        F.when(price < 1000, "token guide").when(price < 3000, "low guide").alias("risk"),
        F.when(sort == "FURNITURE", "house").when(sort == "MACHINERY", "commercial").otherwise(F.lower(sort)).alias("kind"),
        F.array_join(tags, ",").alias("opps"),
        F.datediff(F.lit("2001-08-02").cast("date"), "sale_date").alias("days_since"),
    )
