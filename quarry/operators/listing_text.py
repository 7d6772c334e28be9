"""Queries of the text and money functions over pages, documents and listings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, text
from ..registry import query
from ..sources.tables import EVENTS, LISTINGS, events, listings, load


def _tax_sql(p: str, bands) -> str:
    highs = [b[0] for b in bands[1:]] + [None]
    return " + ".join(f"greatest({f'least({p}, {h})' if h else p} - {low}, 0) * {rate}::DOUBLE" for (low, rate), h in zip(bands, highs))


_COUNTRY = "CASE region WHEN 0 THEN 'wales' WHEN 1 THEN 'scotland' ELSE 'england' END"
_P = "price::DOUBLE"
_TAX = f"floor(CASE {_COUNTRY} WHEN 'wales' THEN {_tax_sql(_P, money.BANDS['wales'])} WHEN 'scotland' THEN {_tax_sql(_P, money.BANDS['scotland'])} ELSE {_tax_sql(_P, money.BANDS['england'])} END + 0.5)::BIGINT"


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    country = F.when(F.col("region") == 0, "wales").when(F.col("region") == 1, "scotland").otherwise("england")
    condition = F.when(F.col("deal_type") == "1-URGENT", "poor").when(F.col("deal_type") == "2-HIGH", "needs work")
    rent = F.when(F.col("owner") % 4 != 0, (F.col("owner") % 900 + 400).cast("double"))
    return listings(spark, sf_dir).select("id", F.col("price").cast("double").alias("price"), country.alias("country"), condition.alias("condition"), rent.alias("rent"))


_DEALS = f"""deals AS (SELECT id, price, region, price::DOUBLE AS p, CASE deal_type WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 15 ELSE 0 END AS works_pct, CASE WHEN owner % 4 <> 0 THEN (owner % 900 + 400)::DOUBLE END AS rent FROM listings)"""


@query("m10_purchase_tax", f"WITH {LISTINGS} SELECT id, {_TAX} AS tax FROM listings")
def purchase_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deals(spark, sf_dir).select("id", money.purchase_tax(F.col("price"), F.col("country")).alias("tax"))


@query("m11_yields", f"""
WITH {LISTINGS}, {_DEALS}, t AS (SELECT *, {_TAX} AS tax, rent * 12 * 0.82::DOUBLE - 300 AS noi, floor(p * works_pct / 100 + 0.5) AS works FROM deals)
SELECT id, p + tax + 3500 AS true_cost, round(noi / (p + tax + 3500) * 100, 6) AS net_yield, round((noi - p * 0.75::DOUBLE * 5.5::DOUBLE / 100) / (p * 0.25::DOUBLE + tax + 3500 + works) * 100, 6) AS roce, floor(rent * 12 / 0.08::DOUBLE + 0.5)::BIGINT AS max_bid FROM t""")
def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c, k, r = (F.col(x) for x in ("price", "country", "condition", "rent"))
    return _deals(spark, sf_dir).select("id", money.true_cost(p, c).alias("true_cost"), F.round(money.net_yield(p, r, c), 6).alias("net_yield"), F.round(money.roce(p, r, c, k), 6).alias("roce"), money.max_bid(r, 8).alias("max_bid"))


def _breakdown_sql() -> str:
    rows = "".join(f" + CASE WHEN regexp_matches(t, '{p}') THEN {n}::DOUBLE ELSE 0 END" for _, n, p in text.SIGNALS)
    kind = f"CASE WHEN regexp_matches(t, '{text.HOUSE}') THEN 'house' WHEN regexp_matches(t, '{text.FLAT}') THEN 'flat' WHEN regexp_matches(t, '{text.LAND}') THEN 'land' ELSE 'other' END"
    cond = f"CASE WHEN regexp_matches(t, '{text.POOR}') THEN 'poor' WHEN regexp_matches(t, '{text.NEEDS}') THEN 'needs work' WHEN regexp_matches(t, '{text.GOOD}') THEN 'good' END"
    return f"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), k AS (SELECT *, {kind} AS kind, {cond} AS condition, CASE WHEN regexp_matches(t, '{text.VACANT}') THEN true WHEN regexp_matches(t, '{text.LET}') THEN false END AS vacant FROM d),
s AS (SELECT *, CASE condition WHEN 'needs work' THEN 2.0::DOUBLE WHEN 'poor' THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(t, '{text.DEVELOP}') THEN CASE kind WHEN 'land' THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END ELSE 0 END
  + CASE WHEN vacant AND kind IN ('house', 'flat') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN contains(t, 'freehold') AND NOT contains(t, 'leasehold') AND kind = 'house' THEN 0.5::DOUBLE ELSE 0 END {rows} AS total FROM k)
SELECT doc_id, kind, condition, vacant, greatest(0.0::DOUBLE, least(10.0::DOUBLE, floor(total * 10 + 0.5) / 10)) AS score FROM s"""


@query("m04_narrative_score", _breakdown_sql())
def narrative_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text is folded once and each pattern runs once; all else is derived from the flags."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    found = docs.select("doc_id", *[c.alias(k) for k, c in text.flags(F.col("t")).items()])
    f = {k: F.col(k) for k in text.flags(F.col("t"))}
    parts = found.select("doc_id", text.kind_of(f).alias("kind"), text.condition_of(f).alias("condition"), text.vacancy_of(f).alias("vacant"), text.breakdown_of(f).alias("parts"))
    return parts.select("doc_id", "kind", "condition", "vacant", text.score(F.col("parts")).alias("score"))


@query("m02_price_status", f"""
WITH {LISTINGS} SELECT id, CASE WHEN status = 'sold' THEN 'sold' WHEN id % 7 = 0 THEN 'nil_reserve' WHEN id % 7 = 1 THEN 'poa' WHEN id % 7 = 2 THEN 'tba' WHEN id % 7 = 3 THEN 'starting_bid' WHEN id % 7 < 6 THEN 'guide' ELSE 'unknown' END AS price_status FROM listings""")
def price_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id") % 7
    words = F.when(n == 0, "No-Reserve").when(n == 1, "Price on Application").when(n == 2, "TBC").when(n == 3, "Starting Bid 1000").otherwise("Guide")
    amount = F.when(n.isin(3, 4, 5), F.col("price"))
    return listings(spark, sf_dir).select("id", text.price_status(F.col("status"), words, amount).alias("price_status"))


@query("m01_parse_price", "SELECT c_custkey, floor(abs(c_acctbal) * 100 + 0.5)::BIGINT * 10 AS price FROM customer")
def parse_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    pence = F.floor(F.abs("c_acctbal") * 100 + 0.5)
    written = F.concat(F.lit("Guide £"), F.format_number(pence / 100, 2), F.lit("k +"))
    return load(spark, sf_dir, "customer").select("c_custkey", text.price(written).alias("price"))


@query("x01_normalise_url", r"SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', ''), '^http://', 'https://', 'i'), '^https://www\.', 'https://', 'i')) AS url FROM pages")
def normalise_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text.normalise_url(F.col("url")).alias("url"))


@query("x03_drop_tracking", "SELECT page_id, regexp_replace(replace(replace(url, '?utm_source=feed', ''), '&ref=x', ''), '[?]ref=x', '') AS url FROM pages")
def drop_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text.drop_params(F.col("url"), ["utm_source", "ref"]).alias("url"))


@query("x05_postcode_area", "SELECT c_custkey, chr((65 + c_custkey % 26)::INT) || (c_custkey % 9 + 1) AS district, list_contains(['B'], chr((65 + c_custkey % 26)::INT)) AS west_midlands FROM customer")
def postcode_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    written = F.concat(F.lit("1 High St, "), F.lower(F.char(65 + k % 26)), (k % 9 + 1).cast("string"), F.lit(" 1ab, UK"))
    code = text.postcode(written)
    return load(spark, sf_dir, "customer").select("c_custkey", text.district(code).alias("district"), text.in_region(code, "west midlands").alias("west_midlands"))


@query("x07_property_key", "SELECT c_custkey, lower('P' || c_nationkey) || '|' || lower(c_name) AS key FROM customer")
def property_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", text.property_key(F.concat(F.lit("P"), F.col("c_nationkey").cast("string")), F.concat("c_name", F.lit(", Town"))).alias("key"))


@query("d02_uk_dates", "SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE AS b, o_orderdate::DATE AS c FROM orders")
def uk_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    write = lambda f: text.uk_date(F.date_format("o_orderdate", f))
    return load(spark, sf_dir, "orders").select("o_orderkey", write("'Sale: 'd'th 'MMMM yyyy").alias("a"), write("dd/MM/yyyy").alias("b"), write("yyyy-MM-dd'T'HH:mm").alias("c"))


@query("d04_sentinel_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS day FROM orders")
def sentinel_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 5 == 0, F.lit("2099-12-31").cast("date")).otherwise(F.to_date("o_orderdate"))
    return load(spark, sf_dir, "orders").select("o_orderkey", text.real_date(day).alias("day"))


_STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("s10_strip_html", f"SELECT page_id, md5({_STRIP}) AS digest, length({_STRIP}) AS n FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("t")).select("page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


@query("s13_links", """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS link FROM pages""")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1))).alias("link"))


@query("s14_chunks", "SELECT doc_id, i AS chunk, md5(substr(text, i * 900 + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 100) / 900.0)::BIGINT))) AS i FROM documents)")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 1000 characters that overlap by 100."""
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - 100) / F.lit(900.0)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("bigint").alias("chunk"), F.md5(F.substr(F.col("text"), i * 900 + 1, F.lit(1000))).alias("digest")))
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(cut).alias("c")).select("doc_id", "c.*")


def cuts(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of at most ``most`` characters: a cut goes back to the last newline in a piece's back half, the next piece begins ``overlap`` before it."""
    out, start = [], 0
    while True:
        end = min(start + most, len(text))
        if end < len(text) and (line := text.rfind("\n", start, end + 1)) > start + most * 0.5:
            end = line
        out.append((start, end))
        if end >= len(text):
            return out
        start = max(start + 1, end - overlap)


@query("s14_chunks_at_lines", """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
r AS (
  SELECT doc_id, 0 AS chunk, 0::BIGINT AS start, (SELECT CASE WHEN n <= 1000 THEN n WHEN p > 0 AND 1001 - p > 500 THEN 1001 - p ELSE 1000 END FROM (SELECT strpos(reverse(substr(text, 1, 1001)), chr(10)) AS p)) AS stop, text, n FROM t
  UNION ALL
  SELECT doc_id, chunk + 1, s, CASE WHEN s + 1000 >= n THEN n WHEN p > 0 AND 1001 - p > 500 THEN s + 1001 - p ELSE s + 1000 END, text, n
  FROM (SELECT *, strpos(reverse(substr(text, s + 1, 1001)), chr(10)) AS p FROM (SELECT *, greatest(start + 1, stop - 100) AS s FROM r WHERE stop < n)))
SELECT doc_id, chunk, start, stop, md5(substr(text, start + 1, stop - start)) AS digest FROM r""")
def chunks_at_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 1000 characters, each cut depending on the one before; null is one empty piece."""

    @F.pandas_udf("array<struct<start bigint, stop bigint>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "stop": b} for a, b in cuts(t or "", 1000, 100)] for t in texts])

    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id", "text", F.posexplode(found("text")).alias("chunk", "c"))
    piece = F.substr(F.col("text"), (F.col("c.start") + 1).cast("int"), (F.col("c.stop") - F.col("c.start")).cast("int"))
    return rows.select("doc_id", "chunk", "c.start", "c.stop", F.md5(piece).alias("digest"))


@query("m19_structure_fingerprint", """
WITH t AS (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))) AS tags, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages)
SELECT md5(array_to_string(tags, ',')) AS fingerprint, count(*) AS pages, sum(paragraphs)::BIGINT AS paragraphs FROM t GROUP BY 1""")
def structure_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)))
    return load(spark, sf_dir, "pages").groupBy(F.md5(F.array_join(tags, ",")).alias("fingerprint")).agg(F.count("*").alias("pages"), F.sum(F.regexp_count("html", F.lit("<p>"))).alias("paragraphs"))


@query("e06_status_from_text", r"SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'sold stc|subject to contract') THEN 'stc' WHEN regexp_matches(lower(text), '\bsold\b') THEN 'sold' WHEN regexp_matches(lower(text), 'withdrawn') THEN 'withdrawn' ELSE 'available' END AS status FROM documents")
def status_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.when(t.rlike("sold stc|subject to contract"), "stc").when(t.rlike(r"\bsold\b"), "sold").when(t.rlike("withdrawn"), "withdrawn").otherwise("available").alias("status"))


@query("e10_grounding", r"""
WITH b AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE length(w) > 5),
d AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+')) AS w FROM documents) WHERE length(w) > 5)
SELECT item_id, doc_id FROM b JOIN d USING (w) GROUP BY 1, 2 HAVING count(*) >= 5""")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a text bears out: five or more of its long words occur there. Only shared words meet."""
    b = load(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w")).where(F.length("w") > 5)
    d = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))).alias("w")).where(F.length("w") > 5)
    return d.join(b, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("n")).where("n >= 5").select("item_id", "doc_id")


@query("k01_json_path", f"WITH {EVENTS} SELECT event_id, k FROM ev WHERE k > 900")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("k > 900").select("event_id", "k")


@query("k02_map_merge", "SELECT user_id, count(*) FILTER (event_type = 'view') AS views, CASE WHEN bool_or(event_type = 'purchase') THEN 'buyer' ELSE 'visitor' END AS tag FROM events GROUP BY user_id")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-biased union of two maps without a session setting."""
    a = F.create_map(F.lit("tag"), F.lit("visitor"))
    b = F.when(F.bool_or(F.col("event_type") == "purchase"), F.create_map(F.lit("tag"), F.lit("buyer"))).otherwise(F.create_map().cast("map<string,string>"))
    return events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), b.alias("b")).select("user_id", "views", F.map_zip_with(a, "b", lambda _, x, y: F.coalesce(y, x))["tag"].alias("tag"))


@query("k07_digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("k08_null_safe_change", "WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AS prev FROM conversations) SELECT conv_id, turn, role IS DISTINCT FROM prev AS changed FROM l")
def null_safe_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    prev = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return load(spark, sf_dir, "conversations").withColumn("prev", prev).select("conv_id", "turn", (~F.col("role").eqNullSafe(F.col("prev"))).alias("changed"))
