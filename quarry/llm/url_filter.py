"""URL filters: rules first, then trust and distrust that spread over the host graph. Native.

A rule ``host/path`` with a verdict fits its host and all subdomains where the url's path starts
with the rule's; the longest rule wins. Pages that no rule judges take their host's verdict. Hosts
are the nodes of a graph whose edges are the absolute links in the pages and a link each way
between a host and its parent host, up to the parent of two labels, whether or not that has pages.
Upwards a host passes only its share of the pages below the parent, so that one small bad host
doesn't taint a large domain and all under it. A host's seed is the share of its pages that rules
allow (trust) or block (distrust); listed hosts are seeds of weight 1. Personalised PageRank
carries trust along the links and distrust against them, ``rank = seed + DAMPING * inflow``. Beside
each runs the same PageRank with a seed of 1 at every host: a host's score is the part of that mass
which comes from the seeds, between 0 and 1, and means the same however many hosts, links or seeds
there are. A host is blocked where its distrust passes its trust by ``MARGIN``.

Edges and ranks are aggregated before each shuffle, and the loop ends when no rank changes by more
than ``STILL`` (all later changes of a host's score together are a few times that, far below the margin). A round passes on what the last one added, and no host passes on more than it got,
so the sum of all changes falls by ``DAMPING`` a round and the rounds have a bound; a loop that
goes beyond it raises. A hot host costs one row in the graph; the last join, from pages to hosts,
can be split by AQE.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

DAMPING, MARGIN, STILL = 0.75, 0.4, 1e-6
#: Rounds between two writes.
STEPS = 4
#: The rules of the registered query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//([^/"'\s>?#]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for urls without ``://``."""
    rest = F.when(url.contains("://"), F.substr(url, F.locate("://", url) + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_and_verdict(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none; ``rules`` is a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """``src, dst, n, along, against``: absolute links between hosts, and a link each way between host and parent.

    ``n`` counts links; of a link's weight ``along`` is passed from src to dst and ``against`` from
    dst to src: all of it, but from a host to its parent its share of the pages below the parent.
    ``hosts`` has ``host, pages`` where they are counted already.
    """
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).withColumns({"along": F.lit(1.0), "against": F.lit(1.0)})
    labels = F.split("host", r"\.")
    # the host and its ancestors of two labels or more, from the longest
    names = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if hosts is None:
        hosts = pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"))
    below = hosts.select("pages", F.explode(names).alias("host")).groupBy("host").agg(F.sum("pages").alias("pages"))
    up = below.withColumn("dst", F.when(F.size(labels) > 2, F.array_join(F.slice(labels, F.lit(2), F.size(labels)), ".")))
    up = up.where("dst IS NOT NULL").select(F.col("host").alias("src"), "dst", "pages")
    up = up.join(below.select(F.col("host").alias("dst"), F.col("pages").alias("all")), "dst").select("src", "dst", (F.col("pages") / F.col("all")).alias("along"), F.lit(1.0).alias("against"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("against").alias("along"), F.col("along").alias("against"))
    return links.unionByName(up).unionByName(down).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("along").alias("along"), F.sum("against").alias("against"))


def propagated(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``host, trust, distrust`` (parts of each host's mass) from ``host, trust, distrust`` seeds, over weighted edges."""
    ways = edges.select(F.lit("along").alias("way"), "src", "dst", "n", F.col("along").alias("part"))
    ways = ways.unionByName(edges.select(F.lit("against").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.col("against").alias("part")))
    out = ways.groupBy("way", "src").agg(F.sum("n").alias("all"))
    tables = Scratch(edges.sparkSession)
    nodes = seeds.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct().join(seeds, "host", "left")
    both = F.array(*[F.struct(F.lit(way).alias("way"), F.coalesce(F.col(kind).cast("double"), F.lit(0.0)).alias("seed")) for way, kind in (("along", "trust"), ("against", "distrust"))])
    ranks = nodes.select("host", F.explode(both).alias("s")).select("host", "s.way", F.col("s.seed").alias("rank"), F.col("s.seed").alias("new"), F.lit(1.0).alias("mass"), F.lit(1.0).alias("new_mass"))
    ranks = tables.save(ranks, "ranks0")
    # each node also passes what it has to itself, so a round is one join and one sum
    own = ranks.select("way", F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(0.0).alias("w"), F.lit(1.0).alias("keep"))
    flow = tables.save(ways.join(out, ["way", "src"]).select("way", "src", "dst", (F.col("part") / F.col("all")).alias("w"), F.lit(0.0).alias("keep")).unionByName(own), "flow")
    most, mass = ranks.agg(F.max("new_mass"), F.sum("new_mass")).first()
    left = math.ceil(math.log(max(mass or 0.0, STILL) / STILL, 1 / DAMPING)) + STEPS

    def stepped(ranks: DataFrame) -> DataFrame:
        sent = flow.join(ranks.withColumnRenamed("host", "src"), ["way", "src"])
        part = lambda by, name, d=1.0: F.sum(F.col(by) * F.col(name) * d)
        added = sent.groupBy(F.col("dst").alias("host"), "way").agg(part("keep", "rank").alias("rank"), part("w", "new", DAMPING).alias("new"), part("keep", "mass").alias("mass"), part("w", "new_mass", DAMPING).alias("new_mass"))
        return added.select("host", "way", (F.col("rank") + F.col("new")).alias("rank"), "new", (F.col("mass") + F.col("new_mass")).alias("mass"), "new_mass")

    round_ = 0
    while (most or 0.0) > STILL:
        if left <= 0:
            raise RuntimeError(f"ranks still change by {most}")
        for _ in range(STEPS):
            ranks = stepped(ranks)
        left, round_ = left - STEPS, round_ + 1
        ranks = tables.save(ranks, f"ranks{round_}")
        tables.drop(f"ranks{round_ - 1}")
        most = ranks.agg(F.max("new_mass")).first()[0]
    pick = lambda way, name: F.max(F.when(F.col("way") == way, F.col("rank") / F.col("mass"))).alias(name)
    return ranks.groupBy("host").agg(pick("along", "trust"), pick("against", "distrust"))


def filtered(pages: DataFrame, rules: list[tuple[str, str]], trusted: tuple[str, ...] = (), blocked: tuple[str, ...] = ()) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page.

    Null urls and urls without ``://`` have an empty host, no rule and the verdict allow. Repeated
    rows are judged alike, an empty table gives no rows, other columns are ignored.
    """
    pages = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host, path = host_and_path(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path})
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": rule, "by_rule": verdict})
    share = lambda v: F.avg(F.when(F.col("by_rule") == v, 1.0).otherwise(0.0))
    tables = Scratch(pages.sparkSession)
    hosts = tables.save(pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), share("allow").alias("trust"), share("block").alias("distrust")), "hosts")
    listed = lambda hosts: F.when(F.col("host").isin(*hosts), 1.0) if hosts else F.lit(None).cast("double")
    seeds = hosts.select("host", F.coalesce(listed(trusted), "trust").alias("trust"), F.coalesce(listed(blocked), "distrust").alias("distrust"))
    edges = tables.save(host_edges(pages, hosts.select("host", "pages")), "edges")
    scores = propagated(seeds, edges)
    judged = pages.drop("html", "url").join(scores, "host", "left")
    score = lambda k: F.coalesce(k, F.lit(0.0)).alias(k)
    by_host = F.when(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) > MARGIN, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), score("trust"), score("distrust"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(pick: int) -> str:
    out = "NULL"
    for rule in sorted(RULES, key=lambda r: (len(r[0]), r[0])):
        own, _, tail = rule[0].partition("/")
        out = f"CASE WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{tail}') THEN '{rule[pick]}' ELSE {out} END"
    return out


#: The same in DuckDB: 80 rounds over the whole graph, each summed by host.
ORACLE = rf"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
j AS (SELECT *, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS by_rule FROM q),
h AS (SELECT host, count(*) AS pages, avg((coalesce(by_rule, '') = 'allow')::INT) AS trust, avg((coalesce(by_rule, '') = 'block')::INT) AS distrust, string_split(host, '.') AS l FROM j WHERE host <> '' GROUP BY host),
b AS (SELECT host, sum(pages) AS pages, string_split(host, '.') AS l FROM (SELECT pages, unnest(list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: array_to_string(l[i:], '.'))) AS host FROM h) GROUP BY host),
up AS (SELECT b.host AS src, d.host AS dst, b.pages / d.pages AS part FROM b JOIN b d ON len(b.l) > 2 AND d.host = array_to_string(b.l[2:], '.')),
lk AS (SELECT src, translate(dst, '{_UPPER}', '{_LOWER}') AS dst FROM (SELECT host AS src, unnest(regexp_extract_all(html, '{_LINK.replace("'", "''")}', 1)) AS dst FROM j WHERE host <> '')),
e AS (
  SELECT src, dst, count(*) AS n, sum(along)::DOUBLE AS along, sum(against)::DOUBLE AS against
  FROM (SELECT src, dst, 1.0 AS along, 1.0 AS against FROM lk UNION ALL SELECT src, dst, part, 1.0 FROM up UNION ALL SELECT dst, src, 1.0, part FROM up) WHERE src <> dst GROUP BY 1, 2),
y AS (SELECT 'along' AS way, src, dst, n, along AS part FROM e UNION ALL SELECT 'against', dst, src, n, against FROM e),
f AS (SELECT way, src, dst, part / sum(n) OVER (PARTITION BY way, src) AS w FROM y),
v AS (SELECT host FROM h UNION SELECT src FROM e UNION SELECT dst FROM e),
z AS (SELECT v.host, way, coalesce(CASE way WHEN 'along' THEN trust ELSE distrust END, 0)::DOUBLE AS seed FROM v CROSS JOIN (VALUES ('along'), ('against')) t(way) LEFT JOIN h USING (host)),
r AS (
  SELECT 0 AS it, host, way, seed AS fresh, 1.0::DOUBLE AS mass FROM z UNION ALL
  SELECT r.it + 1, f.dst, f.way, sum(f.w * r.fresh * {DAMPING}), sum(f.w * r.mass * {DAMPING}) FROM r JOIN f ON f.src = r.host AND f.way = r.way WHERE r.it < 80 GROUP BY r.it, f.dst, f.way),
k AS (SELECT host, sum(fresh) FILTER (way = 'along') / sum(mass) FILTER (way = 'along') AS trust, sum(fresh) FILTER (way = 'against') / sum(mass) FILTER (way = 'against') AS distrust FROM r GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > {MARGIN} THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN k ON k.host = j.host
"""

QUERIES = {"op2_url_filter": op2_url_filter}
ORACLES = {"op2_url_filter": ORACLE}
