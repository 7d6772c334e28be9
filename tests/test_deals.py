"""Signals, dates, gates and state machines against cases worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.functions import signals as S
from quarry.functions import text as T
from quarry.operators.checks import address_verdict
from quarry.operators.rules import diverse
from quarry.operators.stats import at_places
from quarry.streaming import circuits


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("producing £47,700 per annum", (47_700, "passing")),
        ("let at c£975pcm", (11_700, "passing")),
        ("could produce £700 pcm when fully let", (8_400, "potential")),
        ("£450 pw", (23_400, "potential")),
        ("ground rent of £2,400 pa", None),
        ("outgoings include £2,400 pa", None),
        ("£2,000 pa payable to the freeholder", None),
        ("income of £12,000 pa plus service charge", (12_000, "passing")),
        ("rent of £100 pa", None),
        ("estimated rent of £20,000 p.a. and passing rent £9,000 pa", (20_000, "potential")),
        ("", None),
    ],
)
def test_stated_income(spark, text, want):
    got = one(spark, text, lambda t: S.stated_income(S.incomes(t)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("text, beds, want", [("3 ensuite bathrooms", None, 3), ("five en-suite rooms", 4, 4), ("bedroom 3 en-suite shower room", None, 1), ("5 of 6 rooms with en-suite", None, 5), ("en-suite to every bedroom", 6, 6), ("en-suites", None, 2), ("no bathroom", 3, 0)])
def test_ensuites(spark, text, beds, want):
    df = spark.createDataFrame([(text, beds)], "t string, beds int")
    assert df.select(S.ensuites(F.col("t"), F.col("beds"))).first()[0] == want


def test_labels_and_points(spark):
    rows = [
        (1, "scope to extend and needs updating. a licensed hmo of six rooms in a street of many others, producing £60,000 pa", 6, "house", "Freehold", None, 500_000.0),
        (2, "let on a lease with 7 years unexpired", 3, "commercial", "Freehold", None, 100_000.0),
        (3, "flat with 62 years unexpired, by order of the mortgagees, lpa receivers", 2, "flat", "Leasehold", None, 90_000.0),
        (4, "sold subject to planning permission being granted", 5, "house", None, 70, None),
        (5, "derelict. japanese knotweed. grade ii listed. 1,000 sq ft. vacant", 2, "house", "Freehold", None, 150_000.0),
    ]
    df = spark.createDataFrame(rows, "id int, t string, beds int, kind string, tenure string, lease int, price double")
    got = {r.id: r for r in S.scored(S.signalled(df)).collect()}
    assert got[1].labels == ["hmo", "investment-valuation", "income-stated"] and got[1].deal_type == "HMO"
    assert got[1].points == 2 + 1.5 + 0.5 + 2.5 + 1 and "12.0% GIY" in got[1].opps
    assert got[2].labels == [] and "short-lease" in got[3].labels and "repossession" in got[3].labels and "receivership" not in got[3].labels
    assert got[4].labels == ["short-lease"] and got[4].risks == ["Guide TBA"] and got[4].deal_type == "Development"
    assert got[5].points == 2.5 + 1 + 0.5 + 2 - 2 and got[5].risks == ["Knotweed", "Listed building"] and "£150/sqft" in got[5].opps


def test_dates_of_lines_and_slugs(spark):
    today = F.lit("2026-05-12").cast("date")
    day = lambda v: one(spark, v, lambda c: D.sale_date(c, today))
    assert day("Sale Ends: 09/06/2026") == datetime.date(2026, 6, 9) and day("Wednesday 14th May 2026 sale") == datetime.date(2026, 5, 14)
    assert day("20 MAY live online sale") == datetime.date(2026, 5, 20) and day("23 April sale") is None and day("20 May") is None and day("31 June 2026") is None
    slug = lambda v: one(spark, v, D.slug_dates)
    assert tuple(slug("30-june--1-july-2026-231")) == (datetime.date(2026, 6, 30), datetime.date(2026, 7, 1), "231")
    assert slug("about-us") is None and slug("july-2026-1") is None


def test_words(spark):
    assert one(spark, "o'brien's semi-DETACHED", T.titled) == "O'Brien'S Semi-Detached"
    assert one(spark, "Flat 2, 14A Mill Lane", T.street) == "" and one(spark, "12-14 St. John's Road, Hove", T.street) == "st johns road"
    assert one(spark, "a, b , c", T.shortened) == "a, b, …" and one(spark, None, T.shortened) == ""
    assert one(spark, "x", lambda c: T.money(F.lit(-1234567))) == "-£1,234,567"
    for address, reason in (("14 Mill Lane, Leeds", "ok"), ("Leeds", "city_region_shell"), ("Dover - Kent", "town_county_label"), ("HMO Portfolio LS6", "portfolio_title_shell"), (None, "missing_or_too_short"), ("Heathfield Area", "locality_only_no_street")):
        assert one(spark, address, address_verdict) == reason


def test_places_are_exact(spark):
    values = [0, 5, 5, 5, 1023, 1024, 5000, 5000, 70_000]
    df = spark.createDataFrame([(k, v) for k in ("a", "b") for v in (values if k == "a" else values[:4])], "k string, v bigint")
    n = F.col("n")
    got = {r.k: r for r in at_places(df, ["k"], "v", {f"p{i}": F.lit(i) for i in range(10)} | {"mid": F.floor(n / 2)}).collect()}
    assert [got["a"][f"p{i}"] for i in range(9)] == values and got["a"].p9 is None and got["a"].mid == 1023
    assert [got["b"][f"p{i}"] for i in range(4)] == values[:4] and got["b"].n == 4


def test_diverse_picks_equal_a_plain_loop(spark):
    rows = [(i, f"h{i % 3}" if i % 7 else None, f"t{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, house string, kind string")
    got = [r.id for r in diverse(df, ["id"], {"house": 2, "kind": 3}, 8).orderBy("pick").collect()]
    seen, want = {}, []
    for i, h, k in rows:
        if len(want) < 8 and seen.get(("h", h), 0) < 2 and seen.get(("k", k), 0) < 3:
            want.append(i)
            seen["h", h], seen["k", k] = seen.get(("h", h), 0) + 1, seen.get(("k", k), 0) + 1
    assert got == want


def test_circuits_and_alerts_stream_as_their_batch(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    runs = [(h, at(7 * i + h), i, 0 if 5 <= i < 11 else 20 + h, 50.0, i == 3, i % 2 == 0, i == 10) for h in (1, 2) for i in range(16)]
    schema = "house bigint, ts timestamp, event_id bigint, lots int, images double, warned boolean, dom boolean, outage boolean"
    want = circuits.circuits(spark.createDataFrame(runs, schema)).collect()
    states = [r.circuit for r in sorted((r for r in want if r.house == 1), key=lambda r: r.ts)]
    assert states[0] == "closed" and "open" in states and states[-1] != "open"
    assert [r.health for r in want if r.event_id == 10] == [r.health for r in want if r.event_id == 9]  # an outage says nothing
    path = str(tmp_path / "runs")
    spark.createDataFrame(runs, schema).where("event_id < 8").coalesce(1).write.parquet(path)
    spark.createDataFrame(runs, schema).where("event_id >= 8").coalesce(1).write.mode("append").parquet(path)

    def streamed(rows, name):
        q = rows.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    got = streamed(circuits.circuit_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)), "circuits")
    assert len(got) == len(want) and {r.house for r in got} == {1, 2}
    alerts = [(1, 0, i, at(h)) for i, h in enumerate((0, 1, 7, 8, 14, 100))]
    made = circuits.alerts(spark.createDataFrame(alerts, "house bigint, kind bigint, event_id bigint, ts timestamp")).orderBy("event_id").collect()
    assert [r.sent for r in made] == [True, False, True, False, True, True] and [r.escalated for r in made] == [False] * 4 + [True, False]
