"""Diverse picks against a plain loop, and golden values of the rules."""

import random

from pyspark.sql import functions as F

from quarry.functions import rules as R
from quarry.operators.rules import diverse


def test_diverse_equals_a_plain_loop(spark):
    random.seed(3)
    rows = [(i, random.choice("abcd"), random.choice("xyz"), random.randint(0, 30)) for i in range(300)]
    caps, seen, want = {"house": 2, "kind": 3}, {}, []
    for i, h, k, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if len(want) < 8 and seen.get(h, 0) < 2 and seen.get(k, 0) < 3:
            want.append(i)
            for key in (h, k):
                seen[key] = seen.get(key, 0) + 1
    df = spark.createDataFrame(rows, "id int, house string, kind string, points int")
    got = diverse(df, [F.desc("points"), "id"], caps, 8).orderBy("pick").collect()
    assert [r.id for r in got] == want and [r.pick for r in got] == list(range(1, len(want) + 1))
    assert diverse(df.where("false"), [F.desc("points"), "id"], caps, 8).count() == 0


def test_rules_at_their_edges(spark):
    row = spark.range(1).select(
        R.recall_severity(F.lit(None).cast("double")).alias("unknown"),
        R.recall_severity(F.lit(0.9)).alias("warn"),
        R.count_verdict(F.lit(4), F.lit(5)).alias("small"),
        R.count_verdict(F.lit(4), F.lit(10)).alias("fell"),
        R.estimate(F.lit(None).cast("double"), F.array(), F.lit(0)).alias("none"),
        R.estimate(F.lit(100_000.0), F.array(F.lit("Poor condition"), F.lit("Sitting tenant"), F.lit("Knotweed")), F.lit(1000)).alias("floored"),
        R.confidence(F.lit(6), F.lit(False), F.lit(80)).alias("sure"),
        R.stale_date(F.lit(None).cast("date"), F.lit("2024-01-01").cast("date"), F.lit("2024-01-10").cast("date")).alias("fresh"),
        R.guide_distortion(F.lit(500), F.lit(None).cast("int")).alias("token"),
    ).first()
    assert tuple(row) == ("info", "warning", "healthy", "regression", None, 54_300, "high", None, "token")


def test_a_date_needs_most_of_a_quorum_and_the_first_of_equals_wins(spark):
    from quarry.operators.stats import date_consensus

    day = lambda d: None if d is None else f"2026-0{d}"
    made = lambda house, *dates: [(house, i, day(d)) for i, d in enumerate(dates)]
    rows = made("all", *["9-01"] * 8) + made("seven", *["9-01"] * 7, *["9-02"] * 3) + made("split", *["9-02", "9-01"] * 5) + made("few", *["9-01"] * 7, None)
    rows += made("past", *["1-01"] * 9, *["9-01"] * 8) + made("none", *[None] * 9)
    df = spark.createDataFrame(rows, "house string, id int, date string").withColumn("date", F.col("date").cast("date"))
    got = {r.house: (str(r.majority_date), r.majority_count, r.dated, r.reason) for r in date_consensus(df, "2026-08-01").collect()}
    assert got == {
        "all": ("2026-09-01", 8, 8, "majority"), "seven": ("2026-09-01", 7, 10, "majority"), "split": ("2026-09-02", 5, 10, "no_majority"),
        "few": ("None", 0, 7, "insufficient_lots"), "past": ("2026-09-01", 8, 8, "majority"), "none": ("None", 0, 0, "insufficient_lots"),
    }
