"""Feeds, exports, coverage and candidates: what is read, served, checked and picked next."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import dates as D
from ..functions.cards import cards
from ..plans.recognise import LOT, lots
from ..registry import query
from ..sources import files
from ..sources.snapshots import Snapshot
from ..sources.tables import EVENTS_NOW, LISTINGS, ORDERS_TODAY, events, listings, load, now, today

#: The columns that the feed serves.
MANIFEST = ["id", "house", "price", "status", "sale_date", "prop_type"]


@query("s01_manifest_scan", f"WITH {LISTINGS} SELECT {', '.join(MANIFEST)} FROM listings")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select(*MANIFEST)


@query("s02_paged_scan", "SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) // 1000)::BIGINT AS page FROM events")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 1000 rows in the order of time: the order's ranks come from counts of each day, not from one task."""
    rows = load(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("day"))
    per = rows.groupBy("day").agg(F.count("*").alias("n"))
    # a row for each day
    ahead = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("day", "before")
    rank = F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id")) - 1
    return rows.join(ahead, "day").select("event_id", F.floor((F.col("before") + rank) / 1000).alias("page"))


@query("s04_served_feed", f"""
WITH {LISTINGS} SELECT id, '{{"id":' || id || ',"house":"' || house || '","status":"' || status || '","sale_date":"' || sale_date || '"}}' AS doc FROM listings WHERE status IN ('available', 'stc') AND sale_date >= DATE '2001-06-01'""")
def served_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).where(F.col("status").isin("available", "stc") & (F.col("sale_date") >= F.lit("2001-06-01").cast("date")))
    return rows.select("id", F.to_json(F.struct("id", "house", "status", "sale_date")).alias("doc"))


@query("s05_headed_csv", """
WITH c AS (SELECT c_custkey AS id, c_acctbal AS balance, DATE '2020-01-01' + (c_custkey % 900)::INT AS day FROM customer)
SELECT id::INT AS id, CASE WHEN id % 6 <> 0 THEN floor(abs(balance) * 10)::INT END AS price, CASE WHEN id % 7 <> 0 THEN day END AS day, CASE WHEN id % 5 <> 0 THEN 'He said "' || id || '", twice' END AS note FROM c""")
def headed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with its own headers, thousands marks, dates of two forms, quotes and gaps, read by name and kind."""
    path, k = files.scratch(spark, "headed"), F.col("c_custkey")
    price = F.when(k % 6 == 0, "n/a").otherwise(F.format_number(F.floor(F.abs("c_acctbal") * 10), 0))
    day = F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int"))
    when = F.when(k % 7 == 0, "soon").when(k % 2 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd-MM-yyyy"))
    note = F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit('He said "'), k.cast("string"), F.lit('", twice')))
    load(spark, sf_dir, "customer").select(k.alias("Ref"), price.alias("Guide Price"), when.alias("SALE DATE"), note.alias("Note")).write.csv(path, header=True, escape='"', quoteAll=True, emptyValue="")
    return files.headed_csv(spark, path, {"id": ("ref", "int"), "price": ("guide price", "int"), "day": ("sale date", "date"), "note": ("note", "text")})


@query("s06_positional_csv", "SELECT event_id::INT AS id, event_type AS kind, value FROM events WHERE event_id % 7 <> 0")
def positional_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without headers, read by place; a line of another width is dropped."""
    path, k = files.scratch(spark, "positional"), F.col("event_id")
    line = F.concat_ws(",", k.cast("string"), "event_type", F.col("value").cast("string"), F.when(k % 7 == 0, "extra"))
    load(spark, sf_dir, "events").select(line.alias("line")).write.text(path)
    return files.positional_csv(spark, path, [("id", "int"), ("kind", "text"), ("value", "num")])


@query("s07_zipped_owners", "SELECT s_suppkey AS title, (1 + (s_suppkey % 3 = 0)::INT)::INT AS n_owners, s_name AS first_owner, CASE WHEN s_suppkey % 3 = 0 THEN 'Second ' || s_suppkey END AS last_owner FROM supplier")
def zipped_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of CSV lines, 500 titles each, unzipped and their groups of columns made into owners."""
    k = F.col("s_suppkey")
    line = F.concat_ws(",", k.cast("string"), "s_name", F.lit("C1"), F.lit("UK"), F.when(k % 3 == 0, F.concat(F.lit("Second "), k.cast("string"))).otherwise(" "), F.lit("C2"), F.lit("FR"))
    rows = load(spark, sf_dir, "supplier").select(F.floor(k / 500).alias("part"), line.alias("line"))

    def zipped(frame: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("titles.csv", "\n".join(frame["line"]) + "\n")
            z.writestr("readme.txt", "none")
        return pd.DataFrame({"path": [f"part-{frame['part'].iloc[0]}.zip"], "content": [held.getvalue()]})

    lines = files.unzipped(rows.groupBy("part").applyInPandas(zipped, "path string, content binary"))
    cells = lines.select(F.from_csv("line", F.lit("title bigint, a string, b string, c string, d string, e string, f string")).alias("r")).select("r.*")
    c = F.col
    named = cells.select("title", files.owners([(c("a"), c("b"), c("c")), (c("d"), c("e"), c("f"))]).alias("o"))
    return named.select("title", F.size("o").alias("n_owners"), F.get("o", F.lit(0))["name"].alias("first_owner"), F.get("o", F.lit(1))["name"].alias("last_owner"))


@query("s09_json_items", """
WITH r AS (SELECT user_id, event_type, k FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)) SELECT user_id % 40 AS site, event_type AS kind, k AS number, count(*) AS n FROM r WHERE k % 3 <> 0 GROUP BY 1, 2, 3""")
def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with nested items, as an API gives them, read back into rows; broken ones are skipped."""
    item = F.struct(F.struct(F.col("event_type").alias("kind"), F.col("k").alias("number")).alias("attributes"))
    body = F.when(F.col("k") % 3 != 0, F.to_json(F.struct(F.array(item).alias("items")))).otherwise("{broken")
    raw = events(spark, sf_dir).select((F.col("user_id") % 40).alias("site"), body.alias("body"))
    rows = raw.select("site", F.explode(F.from_json("body", "items array<struct<attributes: struct<kind: string, number: int>>>")["items"]).alias("i"))
    return rows.groupBy("site", F.col("i.attributes.kind").alias("kind"), F.col("i.attributes.number").alias("number")).agg(F.count("*").alias("n"))


#: A line of a catalogue page: [Lot 12 - 3 Mill Lane](https://..) Guide £120,000.
CARD = r"\[Lot (\d+) - ([^\]]+)\]\((\S+)\)(?: Guide £([\d,]+))?"


@query("s11_recognised_lots", f"""
WITH {LISTINGS} SELECT house, id % 500 AS lot, owner || ' Mill Lane' AS address, 'https://x.test/' || id AS url, CASE WHEN id % 4 <> 0 THEN floor(price)::BIGINT END AS price FROM listings""")
def recognised_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue pages as markdown, eight listings on a page, recognised back into listings."""
    c = F.col
    guide = F.when(c("id") % 4 != 0, F.concat(F.lit(" Guide £"), F.format_number(F.floor("price"), 0))).otherwise("")
    line = F.concat(F.lit("* [Lot "), (c("id") % 500).cast("string"), F.lit(" - "), c("owner").cast("string"), F.lit(" Mill Lane](https://x.test/"), c("id").cast("string"), F.lit(")"), guide)
    pages = listings(spark, sf_dir).groupBy("house", F.floor(c("id") / 200).alias("page")).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    return recognised(pages.select("house", F.concat(F.lit("# Catalogue\n\n[Home](https://x.test/)\n"), "body").alias("body")))


def recognised(pages: DataFrame) -> DataFrame:
    """``house, lot, address, url, price`` of every line of a page that reads like a listing."""
    part = lambda k: F.regexp_extract_all("body", F.lit(CARD), k)
    lots = F.arrays_zip(part(1).alias("lot"), part(2).alias("address"), part(3).alias("url"), part(4).alias("price"))
    rows = pages.select("house", F.explode(lots).alias("r"))
    amount = F.nullif(F.replace(F.col("r.price"), F.lit(","), F.lit("")), F.lit("")).cast("bigint")
    return rows.select("house", F.col("r.lot").cast("bigint").alias("lot"), F.col("r.address").alias("address"), F.col("r.url").alias("url"), amount.alias("price"))


HTML_CARD = r'(?s)<article class="card" data-id="(\d+)">.*?<h2>([^<]*)</h2>.*?<span class="rent">£([\d,]+) pcm</span>(?:\s*<em>(\d+) bed)?'


@query("s12_listing_cards", f"WITH {LISTINGS} SELECT id, house AS title, owner % 900 + 400 AS rent, nullif(owner % 5, 0) AS beds FROM listings")
def listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    beds = F.when(c("owner") % 5 != 0, F.concat(F.lit(" <em>"), (c("owner") % 5).cast("string"), F.lit(" bed</em>"))).otherwise("")
    card = F.concat(F.lit('<article class="card" data-id="'), c("id").cast("string"), F.lit('">\n<h2>'), "house", F.lit('</h2><p>x</p><span class="rent">£'), F.format_number(c("owner") % 900 + 400, 0), F.lit(" pcm</span>"), beds, F.lit("</article>"))
    pages = listings(spark, sf_dir).groupBy(F.floor(c("id") / 50)).agg(F.array_join(F.collect_list(card), "\n").alias("page"))
    part = lambda k: F.regexp_extract_all("page", F.lit(HTML_CARD), k)
    rows = pages.select(F.explode(F.arrays_zip(part(1).alias("id"), part(2).alias("title"), part(3).alias("rent"), part(4).alias("beds"))).alias("r"))
    return rows.select(F.col("r.id").cast("bigint").alias("id"), F.col("r.title").alias("title"), F.replace("r.rent", F.lit(","), F.lit("")).cast("bigint").alias("rent"), F.nullif("r.beds", F.lit("")).cast("bigint").alias("beds"))


def lot_rows(pages: DataFrame) -> DataFrame:
    """``page_id, house`` and the columns of ``LOT`` for each lot in ``page_id, house, text``."""

    @F.udtf(returnType=LOT)
    class Lots:
        def eval(self, house: str, text: str):
            yield from lots(house, text)

    return pages.select("page_id", "house", "text").lateralJoin(Lots(F.col("house").outer(), F.col("text").outer())).drop("text")


#: Cards as the houses' pages have them, as expressions that Spark and DuckDB both read.
_LOTS = {
    "bondwolfe": """'[' || chr(10) || '![x](https://cdn.x/' || p_partkey || ')' || chr(10) || '##### ' || p_name || ', B1 1AA' || chr(10) || (p_size % 5 + 1) || ' bedroom house' || chr(10) || '#### £' || (p_partkey * 7 + 1000) || '+' || chr(10) || 'Sold](https://www.bondwolfe.com/auctions/properties/' || p_partkey || '-town/)'""",
    "pattinson": """'[' || p_name || '\\, NE1 4AB' || chr(10) || '£' || (p_partkey * 7 + 1000) || chr(10) || (p_size % 5 + 1) || ' bed flat' || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'Withdrawn' ELSE '' END || '](https://www.pattinson.co.uk/property/' || p_partkey || ')'""",
    "mchugh": """'[![](https://cdn.eigpropertyauctions.co.uk/' || p_partkey || ')](https://www.mchughandco.com/lot/details/' || p_partkey || ')' || chr(10) || '### Lot ' || p_size || chr(10) || '#### ' || p_name || chr(10) || 'Freehold Land Vacant' || chr(10) || 'Guide Price\\* **£' || (p_partkey * 7 + 1000) || '+**' || chr(10)""",
}


@query("s11_lots_by_rule", """
WITH p AS (SELECT *, ['bondwolfe', 'pattinson', 'mchugh'][p_partkey // 25 % 3 + 1] AS house FROM part JOIN pages ON page_id = p_partkey // 25)
SELECT page_id, house, p_partkey::VARCHAR AS lot_id, CASE house WHEN 'mchugh' THEN p_size END AS lot_number, p_name || CASE house WHEN 'bondwolfe' THEN ', B1 1AA' WHEN 'pattinson' THEN ', NE1 4AB' ELSE '' END AS address, p_partkey * 7 + 1000 AS price,
  CASE house WHEN 'bondwolfe' THEN 'residential' WHEN 'pattinson' THEN 'flat' ELSE 'land' END AS kind, CASE house WHEN 'mchugh' THEN NULL ELSE p_size % 5 + 1 END AS beds, CASE house WHEN 'mchugh' THEN 'freehold' END AS tenure,
  CASE house WHEN 'bondwolfe' THEN 'https://cdn.x/' || p_partkey WHEN 'mchugh' THEN 'https://cdn.eigpropertyauctions.co.uk/' || p_partkey END AS image, CASE WHEN house = 'pattinson' AND p_size % 2 = 0 THEN 'withdrawn' ELSE 'available' END AS state FROM p""")
def lots_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages of a house each, some with 25 parts as its cards between their text."""
    house = F.element_at(F.array(*map(F.lit, _LOTS)), (F.expr("page_id % 3") + 1).cast("int"))
    part = load(spark, sf_dir, "part").withColumn("page_id", F.expr("p_partkey DIV 25")).withColumn("house", house)
    card = F.coalesce(*(F.when(F.col("house") == h, F.expr(e)) for h, e in _LOTS.items()))
    lists = part.groupBy("page_id").agg(F.array_join(F.collect_list(card), "\n[Menu](/menu) and more\n").alias("list"))
    pages = load(spark, sf_dir, "pages").withColumn("house", house).join(lists, "page_id", "left")
    return lot_rows(pages.select("page_id", "house", F.concat("html", F.lit("\n"), F.coalesce("list", F.lit(""))).alias("text")))


def card_rows(pages: DataFrame) -> DataFrame:
    """``page_id, listing, rent, beds, kind`` of the cards in ``page_id, html``; a page without cards gives none."""

    @F.udtf(returnType="listing bigint, rent bigint, beds bigint, kind string")
    class Cards:
        def eval(self, html: str):
            yield from cards(html)

    return pages.select("page_id", "html").lateralJoin(Cards(F.col("html").outer())).select("page_id", "listing", "rent", "beds", "kind")


#: Cards in markup of several shapes, as an expression that Spark and DuckDB both read.
_CARD = """CASE p_partkey % 4 WHEN 0 THEN '<div class=pli><a href="/' || (p_partkey + 100000) || '/"><h2>' || (p_partkey % 5 + 1) || ' Bed Flat</h2><p>&pound;' || (p_partkey % 900 + 300) || ' pcm</p></a></div>'
  WHEN 1 THEN '<li><p><a href=/' || (p_partkey + 100000) || '-x>House Share</a></p><br>&#163;' || (p_partkey % 300 + 50) || ' pw</li>'
  WHEN 2 THEN '<div><a href="/' || (p_partkey + 100000) || '">Studio<b> from £' || (p_partkey % 900 + 100) || ' to £2,000 pcm</b></div>'
  ELSE '<div><a href="/' || (p_partkey + 100000) || '/">coming soon, £99 deposit</a></div>' END"""


@query("s12_cards_of_pages", """
WITH k AS (SELECT page_id, p_partkey AS p FROM pages JOIN part ON p_partkey // 25 = page_id)
SELECT page_id, p + 100000 AS listing, CASE p % 4 WHEN 0 THEN p % 900 + 300 WHEN 1 THEN floor((p % 300 + 50) * 52 / 12 + 0.5)::BIGINT ELSE p % 900 + 100 END AS rent,
  CASE p % 4 WHEN 0 THEN p % 5 + 1 WHEN 2 THEN 0 END AS beds, ['flat', 'room', 'studio'][p % 4 + 1] AS kind
FROM k WHERE p % 4 <> 3""")
def cards_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages, some of them with a list of 25 parts below the article."""
    part = load(spark, sf_dir, "part").select(F.expr("p_partkey DIV 25").alias("page_id"), F.expr(_CARD).alias("card"))
    lists = part.groupBy("page_id").agg(F.array_join(F.collect_list("card"), " text between ").alias("list"))
    pages = load(spark, sf_dir, "pages").join(lists, "page_id", "left")
    return card_rows(pages.select("page_id", F.concat("html", F.coalesce("list", F.lit(""))).alias("html")))


@query("s15_upsert", """
WITH old AS (SELECT event_id % 3000 AS key, 0 AS v, min(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1),
new AS (SELECT event_id % 3000 AS key, event_id AS v, ts FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY event_id % 3000 ORDER BY ts DESC, event_id DESC) = 1)
SELECT coalesce(new.key, old.key) AS key, coalesce(new.v, old.v) AS v FROM old FULL JOIN new USING (key)""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch over existing rows: the last of a key in the batch wins, keys that it lacks stay."""
    rows = load(spark, sf_dir, "events").withColumn("key", F.col("event_id") % 3000)
    old = rows.where("event_type = 'view'").groupBy("key").agg(F.lit(0).cast("bigint").alias("v"))
    new = rows.where("event_type = 'purchase'").groupBy("key").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("n"))
    return old.join(new, "key", "full").select("key", F.coalesce("n", "v").alias("v"))


@query("s15_upsert_sink", """
WITH b AS (SELECT user_id, event_type, CASE WHEN event_id % 4 <> 0 THEN value END AS value, ['signup', 'view', 'error'].list_position(event_type) AS batch FROM events WHERE event_type IN ('signup', 'view', 'error')
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, arg_max(event_type, batch) AS status, arg_max(value, batch) FILTER (value IS NOT NULL) AS value FROM b GROUP BY 1""")
def upsert_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches upserted by user into a bucketed snapshot, the second one sent twice; a null keeps the old value."""
    rows = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"), "ts", "event_id")
    schema = StructType([f for f in rows.schema.fields if f.name in ("user_id", "status", "value")])
    table = Snapshot(spark, files.scratch(spark, "snapshot"), schema, "user_id")
    for batch, kind in enumerate(("signup", "view", "error")):
        for _ in range(1 + (batch == 1)):
            table.upsert(rows.where(F.col("status") == kind), batch, ["ts", "event_id"], fill=("value",))
    return table.read()


@query("s16_appended", "SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to one table, then read whole; the table lies in the shared folder."""
    path = files.scratch(spark, "appended")
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for kind in ("click", "error"):
        rows.where(F.col("event_type") == kind).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("s17_exports", f"WITH {LISTINGS} SELECT id, house, price::VARCHAR AS price, 'csv' AS via FROM listings WHERE status = 'stc' UNION ALL SELECT id, house, price::VARCHAR, 'json' FROM listings WHERE status = 'stc'")
def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered set as CSV and as JSON lines, read back from both."""
    path = files.scratch(spark, "exports")
    rows = listings(spark, sf_dir).where("status = 'stc'").select("id", "house", F.col("price").cast("string").alias("price"))
    rows.write.csv(f"{path}/csv", header=True, escape='"')
    rows.write.json(f"{path}/json")
    schema = "id bigint, house string, price string"
    csv, json = spark.read.schema(schema).csv(f"{path}/csv", header=True, escape='"'), spark.read.schema(schema).json(f"{path}/json")
    return csv.withColumn("via", F.lit("csv")).unionByName(json.withColumn("via", F.lit("json")))


@query("s18_sitemap", f"""
WITH {LISTINGS}, e AS (SELECT 'https://x.test/o/' || owner AS loc, max(sale_date) AS lastmod, min(CASE status WHEN 'sold' THEN 1 ELSE 0 END) AS late FROM listings GROUP BY 1)
SELECT loc, lastmod, late = 0 AS live FROM e ORDER BY late, lastmod DESC, loc LIMIT 40000""")
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct places, live ones first, then the latest, up to the size of a file."""
    late = F.when(F.col("status") == "sold", 1).otherwise(0)
    places = listings(spark, sf_dir).groupBy(F.concat(F.lit("https://x.test/o/"), F.col("owner").cast("string")).alias("loc")).agg(F.max("sale_date").alias("lastmod"), F.min(late).alias("late"))
    return places.orderBy("late", F.desc("lastmod"), "loc").limit(40_000).select("loc", "lastmod", (F.col("late") == 0).alias("live"))


@query("s18_sitemap_files", f"WITH {LISTINGS} SELECT 'https://x.test/o/' || owner AS loc, max(sale_date)::VARCHAR AS lastmod FROM listings GROUP BY 1")
def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct places as XML, live ones first, in as many files as their limit of 40,000 needs; read back from them."""
    late = F.when(F.col("status") == "sold", 1).otherwise(0)
    places = listings(spark, sf_dir).groupBy(F.concat(F.lit("https://x.test/o/"), F.col("owner").cast("string")).alias("loc")).agg(F.max("sale_date").alias("lastmod"), F.min(late).alias("late"))
    path = files.scratch(spark, "sitemap")
    files.write_sitemaps(places.orderBy("late", F.desc("lastmod"), "loc").select("loc", F.col("lastmod").cast("string").alias("lastmod")), path)
    return spark.read.schema("loc string, lastmod string").format("xml").option("rowTag", "url").load(path)


@query("s20_result_etag", f"WITH {LISTINGS} SELECT house, count(*) AS n, sum(('0x' || left(md5(id || ':' || status || ':' || sale_date), 12))::BIGINT)::VARCHAR AS etag FROM listings GROUP BY 1")
def result_etag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of each house's rows in any order, summed in each task first: it changes when any row does."""
    part = F.conv(F.left(F.md5(F.concat_ws(":", "id", "status", "sale_date")), F.lit(12)), 16, 10).cast("decimal(20,0)")
    return listings(spark, sf_dir).groupBy("house").agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("etag"))


@query("a38_batch_validation", f"""
WITH {LISTINGS}, q AS (SELECT house, sale_date, count(*) AS n, avg(CASE WHEN balance > 0 THEN 40 ELSE 0 END + CASE WHEN status <> 'sold' THEN 30 ELSE 0 END + CASE WHEN deal_type <> '4-NOT SPECIFIED' THEN 30 ELSE 0 END)::DOUBLE AS q, avg((balance > 0)::INT)::DOUBLE AS b FROM listings GROUP BY 1, 2)
SELECT house, sale_date, n, round(q / 100 * CASE WHEN n >= 5 THEN 1.0 WHEN n >= 3 THEN 0.9 WHEN n >= 2 THEN 0.7 ELSE 0.5 END::DOUBLE, 6) AS quality, round(b, 6) AS balance_share FROM q""")
def batch_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality of a batch, less for small ones, with the coverage of a field."""
    points = lambda when, n: F.when(when, n).otherwise(0)
    quality = points(F.col("balance") > 0, 40) + points(F.col("status") != "sold", 30) + points(F.col("deal_type") != "4-NOT SPECIFIED", 30)
    per = listings(spark, sf_dir).groupBy("house", "sale_date").agg(F.count("*").alias("n"), F.avg(quality).alias("q"), F.avg((F.col("balance") > 0).cast("int")).alias("b"))
    factor = F.when(F.col("n") >= 5, 1.0).when(F.col("n") >= 3, 0.9).when(F.col("n") >= 2, 0.7).otherwise(0.5)
    return per.select("house", "sale_date", "n", F.round(F.col("q") / 100 * factor, 6).alias("quality"), F.round("b", 6).alias("balance_share"))


@query("a43_gallery_chrome", """
WITH g AS (SELECT user_id, event_id, list_distinct(['i' || event_id % 40, 'i' || user_id, 'logo']) AS images FROM events),
u AS (SELECT user_id, event_id, unnest(['i' || event_id % 40, 'i' || user_id, 'logo']) AS image, unnest([1, 2, 3]) AS place FROM g),
f AS (SELECT user_id, event_id, image, min(place) AS place FROM u GROUP BY ALL), b AS (SELECT image, count(DISTINCT user_id) >= 3 AS chrome FROM f GROUP BY 1)
SELECT event_id, coalesce(string_agg(image, ',' ORDER BY place) FILTER (NOT chrome), min_by(image, place)) AS images FROM f JOIN b USING (image) GROUP BY 1""")
def gallery_chrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that three owners or more share are chrome and go; a gallery of nothing else keeps its first image."""
    gallery = F.array_distinct(F.array(F.concat(F.lit("i"), (F.col("event_id") % 40).cast("string")), F.concat(F.lit("i"), F.col("user_id").cast("string")), F.lit("logo")))
    g = load(spark, sf_dir, "events").select("user_id", "event_id", gallery.alias("images"))
    each = g.select("user_id", "event_id", F.posexplode("images").alias("at", "image"))
    shared = each.select("image", "user_id").distinct().groupBy("image").agg((F.count("*") >= 3).alias("chrome"))
    rows = each.join(shared, "image").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("at", "image", "chrome"))).alias("r"))
    kept = F.filter("r", lambda x: ~x["chrome"])
    chosen = F.when(F.size(kept) == 0, F.slice("r", 1, 1)).otherwise(kept)
    return rows.select("event_id", F.array_join(F.transform(chosen, lambda x: x["image"]), ",").alias("images"))


@query("a48_json_documents", f"WITH {LISTINGS} SELECT owner, '[' || string_agg('{{\"id\":' || id || ',\"status\":\"' || status || '\"}}', ',' ORDER BY id) || ']' AS doc FROM listings GROUP BY 1")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an owner as one JSON array in the order of ids."""
    return listings(spark, sf_dir).groupBy("owner").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "status")))).alias("doc"))


@query("a50_fleet_coverage", f"""
WITH {LISTINGS} SELECT count(*) AS rows, round(100.0 * count(*) FILTER (balance > 0) / count(*), 4)::DOUBLE AS balance_pct, round(100.0 * count(*) FILTER (deal_type <> '4-NOT SPECIFIED') / count(*), 4)::DOUBLE AS deal_pct,
  count(*) FILTER (id % 4 = 0) AS cache_hits, count(*) FILTER (id % 4 <> 0) AS cache_misses, round(avg((balance > 0)::INT + (deal_type <> '4-NOT SPECIFIED')::INT + (status <> 'sold')::INT), 4)::DOUBLE AS provenance FROM listings""")
def fleet_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = {"balance": F.col("balance") > 0, "deal": F.col("deal_type") != "4-NOT SPECIFIED", "open": F.col("status") != "sold"}
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 4)
    hit = F.col("id") % 4 == 0
    return listings(spark, sf_dir).agg(F.count("*").alias("rows"), pct(has["balance"]).alias("balance_pct"), pct(has["deal"]).alias("deal_pct"), F.count_if(hit).alias("cache_hits"), F.count_if(~hit).alias("cache_misses"), F.round(F.avg(sum((c.cast("int") for c in has.values()), F.lit(0))), 4).alias("provenance"))


@query("j02_share_of_all", "SELECT event_type, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1")
def share_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    whole = rows.agg(F.count("*").alias("all"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(whole)).select("event_type", "n", (F.col("n") / F.col("all")).alias("share"))  # one row


@query("e01_bad_keys", f"""
WITH {LISTINGS}, m(bad, good) AS (VALUES ('NATION_3', 'NATION_4'), ('NATION_7', 'NATION_8'), ('NATION_9', 'KENYA-1')),
d AS (SELECT DISTINCT l.id FROM listings l JOIN m ON l.house = m.bad JOIN listings o ON o.house = m.good AND o.owner // 10 = l.owner // 10)
SELECT l.id, coalesce(m.good, l.house) AS house FROM listings l LEFT JOIN m ON l.house = m.bad WHERE l.id NOT IN (SELECT id FROM d)""")
def bad_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under a leaked name go where the right name has their place already; the rest are renamed."""
    rows = listings(spark, sf_dir).select("id", "house", F.floor(F.col("owner") / 10).alias("place"))
    good = F.coalesce(*[F.when(F.col("house") == a, F.lit(b)) for a, b in {"NATION_3": "NATION_4", "NATION_7": "NATION_8", "NATION_9": "KENYA-1"}.items()])
    marked = rows.withColumn("good", good)
    there = rows.select(F.col("house").alias("good"), "place").distinct()
    return marked.join(there, ["good", "place"], "left_anti").select("id", F.coalesce("good", "house").alias("house"))


@query("e03_baseline_cohorts", f"""
WITH {LISTINGS}, h AS (SELECT owner, count(*) AS rows, count(*) FILTER (status = 'available') AS live, max(sale_date) AS last FROM listings GROUP BY 1),
c AS (SELECT *, CASE WHEN rows < 3 THEN 'thin' WHEN live = 0 AND last < DATE '2001-01-01' THEN 'dark' WHEN live = 0 THEN 'ended' WHEN last >= DATE '2001-07-01' THEN 'fresh' WHEN live * 2 >= rows THEN 'live' ELSE 'mixed' END AS cohort FROM h)
SELECT cohort, count(*) AS houses, sum(rows)::BIGINT AS rows, sum(live)::BIGINT AS live FROM c GROUP BY 1""")
def baseline_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = listings(spark, sf_dir).groupBy("owner").agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "available").alias("live"), F.max("sale_date").alias("last"))
    day = lambda d: F.lit(d).cast("date")
    cohort = F.when(F.col("rows") < 3, "thin").when((F.col("live") == 0) & (F.col("last") < day("2001-01-01")), "dark").when(F.col("live") == 0, "ended").when(F.col("last") >= day("2001-07-01"), "fresh").when(F.col("live") * 2 >= F.col("rows"), "live").otherwise("mixed")
    return h.groupBy(cohort.alias("cohort")).agg(F.count("*").alias("houses"), F.sum("rows").alias("rows"), F.sum("live").alias("live"))


@query("e04_oldest_checked", "WITH c AS (SELECT c_custkey AS house, max(ts) AS checked FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'purchase' GROUP BY 1) SELECT house, checked FROM c ORDER BY checked NULLS FIRST, house LIMIT 1")
def oldest_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = load(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("house")).agg(F.max("ts").alias("checked"))
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("house")).join(last, "house", "left").orderBy(F.col("checked").asc_nulls_first(), "house").limit(1)


@query("e07_imminent_first", f"""
WITH {LISTINGS}, o AS (SELECT id, house, sale_date BETWEEN DATE '{ORDERS_TODAY}' - 7 AND DATE '{ORDERS_TODAY}' AS urgent, sale_date FROM listings WHERE status <> 'sold'),
r AS (SELECT *, row_number() OVER (PARTITION BY house, urgent ORDER BY sale_date DESC, id) AS r FROM o) SELECT id, house, urgent FROM r WHERE urgent OR r <= 3""")
def imminent_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent rows pass whole; of the rest each house has three."""
    open_ = listings(spark, sf_dir).where("status <> 'sold'").select("id", "house", "sale_date", F.col("sale_date").between(F.date_sub(today(), 7), today()).alias("urgent"))
    rest = open_.where("NOT urgent").withColumn("r", F.row_number().over(Window.partitionBy("house").orderBy(F.desc("sale_date"), "id"))).where("r <= 3")
    return open_.where("urgent").unionByName(rest.drop("r")).select("id", "house", "urgent")


@query("e08_best_candidate", r"""
WITH p AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, url, CASE WHEN regexp_matches(url, '/(en|de)/') THEN 30 ELSE 0 END + CASE WHEN NOT contains(url, '?') THEN 20 ELSE 0 END + CASE WHEN starts_with(url, 'https') THEN 10 ELSE 0 END - CASE WHEN contains(url, 'utm_') THEN 25 ELSE 0 END AS score FROM pages)
SELECT host, url, score FROM (SELECT DISTINCT * FROM p) QUALIFY row_number() OVER (PARTITION BY host ORDER BY score DESC, length(url), url) = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each host the url that looks most like a catalogue; shorter ones first among equals."""
    u = F.col("url")
    pts = lambda when, n: F.when(when, n).otherwise(0)
    score = pts(u.rlike("/(en|de)/"), 30) + pts(~u.contains("?"), 20) + pts(u.startswith("https"), 10) - pts(u.contains("utm_"), 25)
    rows = load(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), "url", score.alias("score"))
    return rows.groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("s"), F.length("url").alias("l"), "url")).alias("b")).select("host", "b.url", (-F.col("b.s")).alias("score"))


@query("e09_advertised_ids", r"""
WITH p AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS h FROM pages)
SELECT host, count(DISTINCT w) AS advertised FROM (SELECT host, unnest(regexp_extract_all(h, '(?i)\b(?:class|id)="([a-z0-9_-]+)"', 1)) AS w FROM p) GROUP BY 1""")
def advertised_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids that a host's pages show outside scripts and styles."""
    page = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    ids = F.array_distinct(F.regexp_extract_all(page, F.lit(r'(?i)\b(?:class|id)="([a-z0-9_-]+)"'), 1))
    rows = load(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), F.explode(ids).alias("w"))
    return rows.groupBy("host").agg(F.count_distinct("w").alias("advertised"))


@query("e11_repaired_json", "SELECT event_id, k AS id, event_type AS kind FROM (SELECT *, (props->>'$.k')::INT AS k FROM events) UNION ALL SELECT event_id, k + 1, 'next' FROM (SELECT *, (props->>'$.k')::INT AS k FROM events) WHERE event_id % 3 <> 0")
def repaired_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays that broke off, cut back to their last whole object and closed."""
    obj = lambda i, kind: F.struct(i.alias("id"), kind.alias("kind"))
    whole = F.to_json(F.array(obj(F.col("k"), F.col("event_type")), obj(F.col("k") + 1, F.lit("next"))))
    broken = F.when(F.col("event_id") % 3 == 0, F.left(whole, F.length(whole) - 4)).otherwise(whole)
    return repaired(events(spark, sf_dir).select("event_id", broken.alias("doc"))).select("event_id", "o.*")


def repaired(rows: DataFrame, schema: str = "array<struct<id: int, kind: string>>") -> DataFrame:
    """``event_id, o``: the objects of ``doc``, also where it breaks off within one."""
    cut = F.concat(F.regexp_extract("doc", r"(?s)^(\[.*\})\s*[,\]]?[^}]*$", 1), F.lit("]"))
    parsed = F.coalesce(F.when(F.rtrim(F.col("doc")).endswith("]"), F.from_json("doc", schema)), F.from_json(cut, schema))
    return rows.select("event_id", F.explode(parsed).alias("o"))


@query("e12_salvaged_indexes", r"""
WITH v AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"keep":[3,1,3,99]}' WHEN 1 THEN 'Verdict: keep 2, 0 and 2' WHEN 2 THEN 'none' ELSE '{"keep":[0' END AS answer FROM documents),
n AS (SELECT doc_id, list_transform(regexp_extract_all(answer, '\d+'), lambda x: x::INT) AS idx FROM v), u AS (SELECT doc_id, unnest(idx) AS i, unnest(range(1, len(idx) + 1)) AS pos FROM n)
SELECT doc_id, i, (row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)))::INT AS place FROM u WHERE i < 5 GROUP BY doc_id, i""")
def salvaged_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of an answer, from its JSON or else from its words: within bounds, once each, in order."""
    k = F.col("doc_id") % 4
    answer = F.when(k == 0, '{"keep":[3,1,3,99]}').when(k == 1, "Verdict: keep 2, 0 and 2").when(k == 2, "none").otherwise('{"keep":[0')
    rows = load(spark, sf_dir, "documents").select("doc_id", answer.alias("a"))
    told = F.from_json("a", "keep array<int>")["keep"]
    found = F.transform(F.regexp_extract_all("a", F.lit(r"\d+"), 0), lambda x: x.cast("int"))
    good = F.array_distinct(F.filter(F.coalesce(told, found), lambda i: i.between(0, 4)))
    return rows.select("doc_id", F.posexplode(good).alias("p", "i")).select("doc_id", "i", (F.col("p") + 1).alias("place"))


@query("e15_source_metrics", f"""
WITH {LISTINGS} SELECT house, sale_date, count(*) AS lots, count(*) FILTER (balance > 0) AS with_balance, round(100.0 * count(*) FILTER (balance > 0) / count(*), 2)::DOUBLE AS pct FROM listings GROUP BY 1, 2""")
def source_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues with their listings nested, measured in place without taking them apart."""
    nested = listings(spark, sf_dir).groupBy("house", "sale_date").agg(F.collect_list(F.struct("id", "balance")).alias("lots"))
    n, filled = F.size("lots"), F.size(F.filter("lots", lambda x: x["balance"] > 0))
    return nested.select("house", "sale_date", n.cast("bigint").alias("lots"), filled.cast("bigint").alias("with_balance"), F.round(100.0 * filled / n, 2).alias("pct"))


@query("e16_gem_score", """
WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS won, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)
SELECT user_id, round(log2(1 + n) * 10 + CASE WHEN won > 0 THEN 20 ELSE 0 END - least(failed * 5, 25), 6) AS gem, CASE WHEN failed > won THEN 'fix' WHEN won > 0 THEN 'grow' ELSE 'watch' END AS action, won / nullif(won + failed, 0) AS effect FROM c""")
def gem_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    c = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), n("purchase").alias("won"), n("error").alias("failed"))
    gem = F.log2(1 + F.col("n")) * 10 + F.when(F.col("won") > 0, 20).otherwise(0) - F.least(F.col("failed") * 5, F.lit(25))
    return c.select("user_id", F.round(gem, 6).alias("gem"), F.when(F.col("failed") > F.col("won"), "fix").when(F.col("won") > 0, "grow").otherwise("watch").alias("action"), F.try_divide("won", F.col("won") + F.col("failed")).alias("effect"))


@query("e17_tolerant_scores", "SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE (c_custkey % 90 * 2)::INT END AS score, CASE WHEN c_custkey % 6 = 0 THEN 'not a number: ' || 'x' || c_custkey END AS error FROM customer")
def tolerant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row that can't be scored stays, with a score of 0 and the reason."""
    k = F.col("c_custkey")
    raw = F.when(k % 6 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise((k % 90).cast("string"))
    value = raw.try_cast("int")
    return load(spark, sf_dir, "customer").select(k.alias("id"), F.coalesce(value * 2, F.lit(0)).alias("score"), F.when(value.isNull(), F.concat(F.lit("not a number: "), raw)).alias("error"))


@query("e18_action_lists", "SELECT user_id, event_type AS action, k AS lot, min(ts) AS at FROM (SELECT *, (props->>'$.k')::INT AS k FROM events) WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2, 3")
def action_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user liked or analysed; an action told twice keeps its first time."""
    return events(spark, sf_dir).where(F.col("event_type").isin("click", "purchase")).groupBy("user_id", F.col("event_type").alias("action"), F.col("k").alias("lot")).agg(F.min("ts").alias("at"))


@query("e19_resolved_alerts", f"""
WITH h AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS seen, avg((value >= 20)::INT) AS images FROM events GROUP BY 1),
a AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN 'zero_lots' WHEN event_id % 3 = 1 THEN 'image_drop' ELSE 'slow' END AS kind FROM events WHERE event_type = 'error')
SELECT event_id, CASE WHEN ts < TIMESTAMP '{EVENTS_NOW}' - INTERVAL 30 DAY THEN 'expired' WHEN kind = 'zero_lots' AND seen >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR THEN 'lots seen again' WHEN kind = 'image_drop' AND images >= 0.7 THEN 'images back' WHEN kind = 'slow' AND value_noise THEN 'noise' ELSE 'open' END AS resolution
FROM (SELECT a.*, seen, images, a.user_id % 5 = 0 AS value_noise FROM a JOIN h USING (user_id))""")
def resolved_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open alerts against the health of their source now: each kind has its own proof, all expire."""
    rows = load(spark, sf_dir, "events")
    h = rows.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("seen"), F.avg((F.col("value") >= 20).cast("int")).alias("images"))
    kind = F.when(F.col("event_id") % 3 == 0, "zero_lots").when(F.col("event_id") % 3 == 1, "image_drop").otherwise("slow")
    a = rows.where("event_type = 'error'").select("event_id", "user_id", "ts", kind.alias("kind")).join(h, "user_id")
    verdict = (
        F.when(F.col("ts") < now() - F.expr("INTERVAL 30 DAYS"), "expired")
        .when((F.col("kind") == "zero_lots") & (F.col("seen") >= now() - F.expr("INTERVAL 24 HOURS")), "lots seen again")
        .when((F.col("kind") == "image_drop") & (F.col("images") >= 0.7), "images back")
        .when((F.col("kind") == "slow") & (F.col("user_id") % 5 == 0), "noise")
        .otherwise("open")
    )
    return a.select("event_id", verdict.alias("resolution"))


@query("e20_date_candidates", f"""
WITH {LISTINGS}, f AS (SELECT id, deal_type = '1-URGENT' AS a, owner % 4 = 0 AS b, sale_date >= DATE '2001-06-01' AS c, isodow(sale_date) <= 5 AS d, id % 5 = 0 AS e FROM listings),
p AS (SELECT *, greatest(0, least(100, CASE WHEN a THEN 40 ELSE 0 END + CASE WHEN b THEN 20 ELSE 0 END + CASE WHEN c THEN 25 ELSE -30 END + CASE WHEN d THEN 5 ELSE 0 END + CASE WHEN e THEN 20 ELSE 0 END)) AS points FROM f)
SELECT id, points, CASE WHEN points >= 70 THEN 'high' WHEN points >= 40 THEN 'medium' ELSE 'low' END AS confidence, concat_ws(',', CASE WHEN a THEN 'listed' END, CASE WHEN b THEN 'title' END, CASE WHEN c THEN 'future' END, CASE WHEN d THEN 'weekday' END, CASE WHEN e THEN 'agrees' END) AS reasons FROM p""")
def date_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("sale_date")
    found = [F.col("deal_type") == "1-URGENT", F.col("owner") % 4 == 0, day >= F.lit("2001-06-01").cast("date"), F.weekday(day) < 5, F.col("id") % 5 == 0]
    points = D.date_points(*found)
    return listings(spark, sf_dir).select("id", points.alias("points"), D.confidence(points).alias("confidence"), F.array_join(D.date_reasons(*found), ",").alias("reasons"))


CODES = {"E06": "unitary", "E07": "district", "E08": "metropolitan", "E09": "london", "E10": "county", "E12": "region", "E92": "country", "W06": "unitary", "W92": "country", "S12": "council", "S92": "country", "K02": "country"}


@query("e21_area_types", f"WITH c AS (SELECT c_custkey, {[*CODES, 'X99']}[c_custkey % {len(CODES) + 1} + 1] || lpad((c_custkey % 999)::VARCHAR, 6, '0') AS code FROM customer) SELECT c_custkey, code, CASE left(code, 3) {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in CODES.items())} ELSE 'other' END AS area_type FROM c")
def area_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    prefix = F.element_at(F.array(*[F.lit(c) for c in [*CODES, "X99"]]), (k % (len(CODES) + 1) + 1).cast("int"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.concat(prefix, F.lpad((k % 999).cast("string"), 6, "0")).alias("code"))
    return rows.select("c_custkey", "code", F.coalesce(*[F.when(F.left("code", F.lit(3)) == c, F.lit(t)) for c, t in CODES.items()], F.lit("other")).alias("area_type"))


@query("e22_credit_budget", """
WITH s AS (SELECT user_id % 20 AS account, sum(value) FILTER (ts < TIMESTAMP '2024-01-20') AS spent, sum(value) FILTER (ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21') AS day FROM events GROUP BY 1)
SELECT account, round((6000 - coalesce(spent, 0)) / 12, 4) AS allowance, round(coalesce(day, 0), 4) AS used, CASE WHEN coalesce(day, 0) > (6000 - coalesce(spent, 0)) / 12 * 1.5 THEN 'stop' WHEN coalesce(day, 0) > (6000 - coalesce(spent, 0)) / 12 THEN 'essential only' ELSE 'all' END AS tier FROM s""")
def credit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's allowance from what is left of a cycle of 6000 credits with 12 days to go."""
    at = lambda t: F.lit(t).cast("timestamp")
    ts = F.col("ts")
    s = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("account")).agg(F.coalesce(F.sum(F.when(ts < at("2024-01-20"), F.col("value"))), F.lit(0.0)).alias("spent"), F.coalesce(F.sum(F.when((ts >= at("2024-01-20")) & (ts < at("2024-01-21")), F.col("value"))), F.lit(0.0)).alias("day"))
    allowance = (6000 - F.col("spent")) / 12
    return s.select("account", F.round(allowance, 4).alias("allowance"), F.round("day", 4).alias("used"), F.when(F.col("day") > allowance * 1.5, "stop").when(F.col("day") > allowance, "essential only").otherwise("all").alias("tier"))
