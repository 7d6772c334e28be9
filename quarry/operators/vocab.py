"""Words, dates and JSON of listings: canonical forms, builders and recognisers over realistic spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import signals as S
from ..functions import text as T
from ..registry import query
from ..sources.tables import LISTINGS, ORDERS_TODAY, listings, load, spread, today
from .deals import TOLD, _pick, _sql_list, told


def _written(spark: SparkSession, sf_dir: str, values: list[str]) -> DataFrame:
    """One of some spellings for each customer: ``id, v``."""
    k = F.col("c_custkey")
    return spread(load(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("id"), _pick(values, k % len(values)).alias("v"))


def _q(v: str) -> str:
    return v.replace("'", "''")


def _written_sql(values: list[str]) -> str:
    return f"v AS (SELECT c_custkey AS id, [{', '.join('NULL' if v is None else repr_sql(v) for v in values)}][c_custkey % {len(values)} + 1] AS v FROM customer)"


def repr_sql(v: str) -> str:
    return f"'{_q(v)}'"


URLS = ["http://WWW.Example.com/Lots/12/?page=2&utm_source=x#top", "https://example.com//lots/12/", " http://house.test/a?ref=1&Page=3 ", "https://www.house.test/", "ftp://odd.test/x/#y", "", None, "HTTP://A.test/b?view=list&page=9&q=x&amp=1"]


@query("x02_calendar_url", rf"WITH {_written_sql(URLS)} SELECT id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(v), '#.*$', ''), '/+$', ''), '^http://', 'https://', 'i'), '^https://www\.', 'https://', 'i')) AS url FROM v")
def calendar_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, URLS).select("id", T.normalise_url(F.col("v")).alias("url"))


@query("x04_drop_params", rf"""
WITH {_written_sql(URLS)}, c AS (SELECT id, list_filter(string_split(split_part(split_part(v, '#', 1), '?', 2), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(page|view)=')) AS kept, split_part(split_part(v, '#', 1), '?', 1) AS head, CASE WHEN contains(v, '#') THEN '#' || split_part(v, '#', 2) ELSE '' END AS tail FROM v)
SELECT id, head || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || tail AS url FROM c""")
def dropped_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, URLS).select("id", T.drop_params(F.col("v"), ["page", "view"]).alias("url"))


ADDRESSES = ["Flat 2, 14 Mill Lane, Leeds LS1 1AA", "14A Mill Lane, Leeds", "12-14 St. John's Road , Hove", "The Old Hall", "unit 5 dock street, Hull, HU1 1AA", " ", None, "7 High St,, York"]


@query("x06_streets", rf"""
WITH {_written_sql(ADDRESSES)}, f AS (SELECT id, v, regexp_replace(lower(trim(split_part(coalesce(v, ''), ',', 1))), '^(?:flat|unit|apartment)\s+\w+\s*', '') AS s FROM v)
SELECT id, trim(regexp_replace(regexp_replace(s, '^[0-9]+[a-z]?(?:\s*-\s*[0-9]+[a-z]?)?\s+', ''), '[^a-z0-9 ]', '', 'g')) AS street, regexp_replace(lower(coalesce(v, '')), '[^a-z0-9]', '', 'g') || '|ls11aa' AS key FROM f""")
def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, ADDRESSES).select("id", T.street(F.col("v")).alias("street"), T.address_key(F.col("v"), F.lit("LS1 1AA")).alias("key"))


NAMES = ["SEMI-detached house", "o'brien's ROW", "long leasehold", "Share of Freehold", "FLAT/maisonette", "t", "F", "", None, "detached", " Bungalow "]


@query("x08_title_case", f"WITH {_written_sql(NAMES)}, w(v, titled) AS (VALUES {', '.join(f'({repr_sql(a)}, {repr_sql(b)})' for a, b in zip(NAMES, ['Semi-Detached House', chr(79) + chr(39) + 'Brien' + chr(39) + 'S Row', 'Long Leasehold', 'Share Of Freehold', 'Flat/maisonette', 'T', 'F', '', '', 'Detached', ' Bungalow ']) if a is not None)}) SELECT id, titled, CASE lower(trim(v)) {' '.join(f'WHEN {repr_sql(k)} THEN {repr_sql(x)}' for k, x in T.TENURE_NAMES.items())} WHEN '' THEN NULL ELSE lower(trim(v)) END AS tenure FROM v LEFT JOIN w USING (v)")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, NAMES).select("id", T.titled(F.col("v")).alias("titled"), T.canonical(F.col("v"), T.TENURE_NAMES).alias("tenure"))


@query("x09_canonical_kinds", f"WITH {_written_sql(NAMES)} SELECT id, CASE lower(trim(v)) {' '.join(f'WHEN {repr_sql(k)} THEN {repr_sql(x)}' for k, x in (T.KIND_CODES | T.KIND_NAMES).items())} WHEN '' THEN NULL ELSE lower(trim(v)) END AS kind FROM v")
def canonical_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, NAMES).select("id", T.canonical(F.col("v"), T.KIND_CODES, T.KIND_NAMES).alias("kind"))


def _decoded_sql(of: str) -> str:
    for ref, char in T.REFERENCES.items():
        of = f"replace({of}, {repr_sql(ref)}, {repr_sql(char)})"
    return of


@query("x10_decoded", f"SELECT page_id, length({_decoded_sql('html')}) AS n, {_decoded_sql('url')} AS url, md5({_decoded_sql('html')}) AS digest FROM pages")
def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = T.decoded(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", F.length(html).alias("n"), T.decoded(F.col("url")).alias("url"), F.md5(html).alias("digest"))


@query("x11_short_address", f"WITH {_written_sql(ADDRESSES)}, p AS (SELECT id, list_filter(list_transform(string_split(coalesce(v, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM v) SELECT id, array_to_string(p[1:2], ', ') || CASE WHEN len(p) > 2 THEN ', …' ELSE '' END AS address FROM p")
def short_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, ADDRESSES).select("id", T.shortened(F.col("v")).alias("address"))


@query("x12_search_text", f"WITH {TOLD} SELECT id, left(concat_ws('. ', nullif(trim(kind), ''), tenure, CASE WHEN beds IS NOT NULL THEN beds || ' bed' END, nullif(trim(t), '')), 120) AS text FROM told")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col("kind"), F.col("tenure"), F.concat(F.col("beds").cast("string"), F.lit(" bed")), F.col("t")]
    return told(spark, sf_dir).select("id", T.search_text(fields, 120).alias("text"))


@query("x13_formats", "SELECT c_custkey, CASE WHEN round_even(c_acctbal, 0) < 0 THEN '-' ELSE '' END || '£' || format('{:,}', abs(round_even(c_acctbal, 0))::BIGINT) AS money, printf('%s at %06d', c_name, c_custkey) AS line FROM customer")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", T.money(F.bround("c_acctbal")).alias("money"), F.format_string("%s at %06d", "c_name", "c_custkey").alias("line"))


FAMILIES = {"works": S.NEEDS_WORK, "good": S.GOOD_ORDER, "empty": S.EMPTY, "let": S.TENANTED, "develops": S.DEVELOPS, "extends": S.EXTENDS, "split": S.FLATS, "listed": S.LISTED}


@query("x14_pattern_families", f"WITH {TOLD} SELECT id, " + ", ".join(f"regexp_matches(t, '{p}') AS has_{k}" for k, p in FAMILIES.items()) + " FROM told")
def pattern_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir).select("id", *[T.found(F.col("t"), p).alias(f"has_{k}") if "\\" not in p and "(" not in p else F.col("t").rlike(p).alias(f"has_{k}") for k, p in FAMILIES.items()])


LINES = ["Sale ends: 09/08/2001", "Wednesday 14th May 2003 live sale", "20 AUG live online sale", "3 July sale", "2 bed flat in 5 parts", "31 February 2002", "1st September 2001", "", None, "Sale End: 31/12/2001 or 3 Jan 2002", "12 Foo sale"]


def _line_sql(v: str) -> str:
    """The date of a line in DuckDB."""
    months = _sql_list(D.MONTHS)
    date = lambda y, m, d: f"try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
    named = lambda p: f"nullif(coalesce(list_position({months}, lower(left(regexp_extract({v}, '{p}', 2), 3))), 0), 0)::VARCHAR"
    got = lambda p, k: f"regexp_extract({v}, '{p}', {k})"
    short = date("'2001'", named(D.SHORT), got(D.SHORT, 1))
    return f"coalesce({date(got(D.ENDS, 3), got(D.ENDS, 2), got(D.ENDS, 1))}, {date(got(D.WHOLE, 3), named(D.WHOLE), got(D.WHOLE, 1))}, CASE WHEN regexp_matches({v}, '(?i)\\bsale\\b') AND NOT regexp_matches({v}, '{D.WHOLE}') AND {short} >= DATE '{ORDERS_TODAY}' THEN {short} END)"


@query("d01_line_dates", f"WITH {_written_sql(LINES)}, w AS (SELECT id, v, {_sql_list(['no date', '9 Sept 2001'])}[id % 2 + 1] AS x FROM v) SELECT id, {_line_sql('v')} AS day, coalesce({_line_sql('v')}, {_line_sql('x')}) AS first_day FROM w")
def line_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(F.col("v"), _pick(["no date", "9 Sept 2001"], F.col("id") % 2))
    return _written(spark, sf_dir, LINES).select("id", D.sale_date(F.col("v"), today()).alias("day"), D.first_sale_date(lines, today()).alias("first_day"))


SLUGS = {"28--29-july-2026-227": ("2026-07-28", "2026-07-29", "227"), "31-march-2026-220": ("2026-03-31", "2026-03-31", "220"), "30-june--1-july-2026-231": ("2026-06-30", "2026-07-01", "231"), "1st--2nd-May-2025-9": ("2025-05-01", "2025-05-02", "9"), "about-us": None, "july-2026-1": None, "12-smarch-2026-4": None, "": None}


@query("d03_slug_dates", f"WITH {_written_sql([*SLUGS])}, s(v, first_day, last_day, sale) AS (VALUES {', '.join(f'({repr_sql(k)}, DATE {repr_sql(v[0])}, DATE {repr_sql(v[1])}, {repr_sql(v[2])})' for k, v in SLUGS.items() if v)}) SELECT id, first_day, last_day, sale FROM v LEFT JOIN s USING (v)")
def slug_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written(spark, sf_dir, [*SLUGS]).select("id", D.slug_dates(F.col("v")).alias("s"))
    return rows.select("id", F.col("s.start").alias("first_day"), F.col("s.end").alias("last_day"), F.col("s.sale").alias("sale"))


@query("d06_ages", f"WITH {LISTINGS} SELECT id, DATE '{ORDERS_TODAY}' - sale_date AS since, sale_date - DATE '{ORDERS_TODAY}' AS until, (year(DATE '{ORDERS_TODAY}') - year(sale_date)) * 12 + month(DATE '{ORDERS_TODAY}') - month(sale_date) AS months FROM listings")
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("sale_date")
    months = (F.year(today()) - F.year(day)) * 12 + F.month(today()) - F.month(day)
    return listings(spark, sf_dir).select("id", F.datediff(today(), day).alias("since"), F.datediff(day, today()).alias("until"), months.alias("months"))


@query("d08_backoff", "SELECT event_id, least(pow(2, greatest(k % 9 - 1, 0)), 24)::DOUBLE AS hours, ts + to_hours(least(pow(2, greatest(k % 9 - 1, 0)), 24)::INT) AS next_at, ts + INTERVAL 15 MINUTE AS deferred_to FROM (SELECT event_id, ts, (props->>'$.k')::INT AS k FROM events)")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import events
    from ..streaming.changes import backoff_hours

    hours = backoff_hours(F.col("k") % 9)
    return events(spark, sf_dir).select("event_id", hours.alias("hours"), (F.col("ts") + F.make_dt_interval(hours=hours.cast("int"))).alias("next_at"), (F.col("ts") + F.expr("INTERVAL 15 MINUTE")).alias("deferred_to"))


@query("d09_horizon", f"""
WITH {LISTINGS}, g AS (SELECT owner, count(*) FILTER (status <> 'sold') AS n, min(sale_date) FILTER (status <> 'sold' AND sale_date >= DATE '2001-06-15') AS nxt, max(sale_date) FILTER (status <> 'sold' AND sale_date < DATE '2001-06-15') AS last FROM listings GROUP BY 1)
SELECT owner, n AS dated, nxt AS next_day, CASE WHEN n = 0 THEN 'undated' WHEN nxt <= DATE '2001-07-15' THEN 'soon' WHEN nxt IS NOT NULL THEN 'later' WHEN last >= DATE '2001-03-17' THEN 'lapsed' ELSE 'dormant' END AS horizon FROM g""")
def horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2001-06-15").cast("date")
    open_ = F.when(F.col("status") != "sold", F.col("sale_date"))
    per = listings(spark, sf_dir).groupBy("owner").agg(F.count(open_).alias("dated"), F.min(F.when(open_ >= at, open_)).alias("next_day"), F.max(F.when(open_ < at, open_)).alias("last_day"))
    return per.select("owner", "dated", "next_day", D.horizon(F.col("dated"), F.col("next_day"), F.col("last_day"), at).alias("horizon"))


@query("k03_built_json", "SELECT event_id, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\",\"tags\":[\"' || event_type || '\",\"u' || user_id || '\"]}' AS doc FROM events")
def built_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return load(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), tags.alias("tags"))).alias("doc"))


@query("k04_json_arrays", "WITH j AS (SELECT user_id, '[' || event_id % 7 || ',' || event_id % 3 || ',' || user_id % 5 || ']' AS doc FROM events), e AS (SELECT user_id, json_array_length(doc)::INT AS n, unnest(from_json(doc, '[\"INT\"]')) AS x FROM j) SELECT user_id, x, count(*) AS uses, sum(n)::BIGINT AS of FROM e GROUP BY 1, 2")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.array(F.col("event_id") % 7, F.col("event_id") % 3, F.col("user_id") % 5))
    rows = load(spark, sf_dir, "events").select("user_id", doc.alias("doc")).select("user_id", F.json_array_length("doc").alias("n"), F.explode(F.from_json("doc", "array<int>")).alias("x"))
    return rows.groupBy("user_id", "x").agg(F.count("*").alias("uses"), F.sum("n").alias("of"))


@query("k05_array_tests", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, list_contains(w, 'the') AS has_the, len(list_filter(w, lambda x: regexp_matches(x, '^(un|re).*ing$'))) > 0 AS any_match, list_has_any(w, ['und', 'que', 'les']) AS overlaps FROM w")
def array_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = load(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    return rows.select("doc_id", F.array_contains("w", "the").alias("has_the"), F.exists("w", lambda x: x.rlike("^(un|re).*ing$")).alias("any_match"), F.arrays_overlap("w", F.array(F.lit("und"), F.lit("que"), F.lit("les"))).alias("overlaps"))


@query("k06_distinct_sets", f"WITH {LISTINGS} SELECT owner, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses, array_to_string(list_sort(list(DISTINCT prop_type)), ',') AS kinds FROM listings GROUP BY 1")
def distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of a bounded vocabulary for each owner."""
    named = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return listings(spark, sf_dir).groupBy("owner").agg(named("status").alias("statuses"), named("prop_type").alias("kinds"))
