import datetime

from pyspark.sql import functions as F

from quarry.functions import dates, money, text
from quarry.operators.joins import as_of, merged
from quarry.operators.windows import keep_last_by_key
from quarry.plans.search import Spec, browse, parse, relaxed


def one(spark, column, **values):
    names = {k: v for k, v in values.items()}
    df = spark.range(1).select(*[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k) for k, v in names.items()])
    return df.select(column.alias("x")).first().x


def test_score_golden(spark):
    got = spark.createDataFrame([("In need of modernisation",), ("",), (None,), ("derelict house, vacant possession, knotweed",)], "t string")
    rows = got.select(text.score(text.breakdown(F.col("t"))).alias("s"), text.condition(F.lower("t")).alias("c")).collect()
    assert [r.s for r in rows] == [2.0, 0.0, 0.0, 1.5]
    assert rows[0].c == "needs work" and rows[3].c == "poor"


def test_vacancy_is_three_valued(spark):
    df = spark.createDataFrame([("vacant possession",), ("let to tenants",), ("a house",)], "t string")
    assert [r.v for r in df.select(text.vacancy(F.col("t")).alias("v")).collect()] == [True, False, None]


def test_districts(spark):
    df = spark.createDataFrame([("SW1A 1AA",), ("BS1",), ("BS164 7JQ",)], "p string")
    assert [r.d for r in df.select(text.district(F.col("p")).alias("d")).collect()] == ["SW1A", "", ""]


def test_prices_and_dates(spark):
    df = spark.createDataFrame([("£1.25m", "19th February 2026"), ("£75,000 - £80,000", "5/3/2026"), ("POA", "soon"), (None, None)], "p string, d string")
    rows = df.select(text.price(F.col("p")).alias("p"), text.uk_date(F.col("d")).alias("d")).collect()
    assert [r.p for r in rows] == [1_250_000, 75_000, None, None]
    assert [r.d for r in rows] == [datetime.date(2026, 2, 19), datetime.date(2026, 3, 5), None, None]


def test_tax_bands(spark):
    df = spark.createDataFrame([(250_000, "england"), (1_000_000, "england"), (100_000, "scotland"), (200_000, "wales")], "p int, c string")
    assert [r.t for r in df.select(money.purchase_tax(F.col("p"), F.col("c")).alias("t")).collect()] == [12_500, 91_250, 6_000, 8_700]


def test_missing_rent_gives_null(spark):
    df = spark.createDataFrame([(100_000, None)], "p int, r double")
    r = df.select(money.net_yield(F.col("p"), F.col("r"), F.lit("england")).alias("y"), money.max_bid(F.col("r"), 8).alias("m")).first()
    assert r.y is None and r.m is None


def test_parse():
    spec = parse("3 bed freehold house under £150k in west midlands near canal")
    assert spec == Spec(max_price=150_000, beds=3, kinds=["house"], tenure="Freehold", regions=["west midlands"], words=["canal"])
    assert parse("between 1.2m and 2m").max_price == 2_000_000
    assert parse("") == Spec()


def test_null_prices_pass_browsing_and_not_alerts(spark):
    df = spark.createDataFrame([(1, None), (2, 90), (3, 200)], "id int, price int")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(browse(df, Spec(max_price=100))) == [1, 2]
    assert ids(browse(df, Spec(max_price=100), strict_price=True)) == [2]


def test_relaxed_keeps_the_first_tier_with_rows(spark):
    df = spark.createDataFrame([(1, 500, "B"), (2, 500, "M")], "id int, price int, area string")
    assert [(r.id, r.tier) for r in relaxed(df, Spec(max_price=100, regions=["west midlands"])).collect()] == [(1, 1)]


def test_as_of_is_strict_or_not(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, at int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 5, 11), ("a", 3, 12)], "k string, t int, v int")
    got = {(r.k, r.at): r.r_v for r in as_of(left, right, ["k"], "at", "t", "v").collect()}
    assert got == {("a", 5): 12, ("a", 1): None, ("b", 9): None}
    got = {(r.k, r.at): r.r_v for r in as_of(left, right, ["k"], "at", "t", "v", strict=False).collect()}
    assert got[("a", 5)] == 11 and got[("a", 1)] == 10


def test_merge_policies(spark):
    old = spark.createDataFrame([(1, 10, "long text", {"a": "1", "b": "1"}, 5), (2, 20, "x", None, 6)], "k int, price int, notes string, tags map<string,string>, seen int")
    new = spark.createDataFrame([(1, None, "short", {"b": "2"}, None), (3, 30, None, {"c": "3"}, 7)], "k int, price int, notes string, tags map<string,string>, seen int")
    got = {r.k: (r.price, r.notes, r.tags, r.seen) for r in merged(old, new, "k").collect()}
    assert got == {1: (10, "long text", {"a": "1", "b": "2"}, None), 2: (20, "x", {}, 6), 3: (30, None, {"c": "3"}, 7)}


def test_keep_last_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "u"), (2, None), (3, "u"), (4, None)], "n int, url string")
    assert sorted(r.n for r in keep_last_by_key(df, "url", "n").collect()) == [2, 3, 4]


def test_found_equals_the_pattern(spark):
    patterns = [text.POOR, text.NEEDS, text.GOOD, text.DEVELOP, text.VACANT, text.LET, text.HOUSE, text.FLAT, text.LAND, *[p for _, _, p in text.SIGNALS]]
    told = ["two flats", "aflat", "flat", "semi detached", "semidetached villa", "terrace", "terraced", "plot", "plots", "land.", "vp", "mvp", "vp!", "an hmo", "6 week completion", "5weekcompletion", "non standard", "nonstandard", "ews1", "cladding issue", "cladding", "house", "houses", "warehouse", "apartments", "maisonette", ""]
    df = spark.createDataFrame([(x,) for x in told], "t string")
    wrong = [text.found(F.col("t"), p) != F.col("t").rlike(p) for p in patterns]
    assert df.where(F.exists(F.array(*wrong), lambda x: x)).collect() == []
    assert df.where(text.found(F.col("t"), text.FLAT)).count() == 4


def test_costly_work_on_a_small_file_is_many_tasks(spark):
    from quarry.operators.deals import told
    from quarry.operators.vocab import LINES, _written

    sf = "/root/testdata/sf0.001"
    assert told(spark, sf).rdd.getNumPartitions() >= 4 and _written(spark, sf, LINES).rdd.getNumPartitions() >= 4


def test_dates_are_made_without_a_parser(spark):
    parts = [(2024, 2, 29), (2023, 2, 29), (2001, 12, 31), (2001, 13, 1), (2001, 0, 1), (0, 1, 1), (2001, 1, 0), (2001, 4, 31), (None, 1, 1), (2001, None, 1), (2001, 1, None), (9999, 12, 31), (1, 1, 1)]
    made = dates.made(F.col("y"), F.col("m"), F.col("d"))
    df = spark.createDataFrame(parts, "y int, m int, d int").select(made.cast("string").alias("got"), F.try_to_date(F.format_string("%04d-%02d-%02d", "y", "m", "d"), "yyyy-MM-dd").cast("string").alias("want"))
    rows = df.collect()
    assert [r.got for r in rows] == [r.want for r in rows] and sum(r.got is None for r in rows) == 8
    plan = df.select("got")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "gettimestamp" not in plan
