"""Set-similarity joins, the grid of places and cuts at lines against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.listing_text import cuts
from quarry.plans import places, similar


def drawn(rng, n, words):
    return [(i, i % 2, [rng.choice(words) for _ in range(rng.randrange(0, 9))] + ["the"] * rng.randrange(2)) for i in range(n)]


@pytest.mark.parametrize("share", [0.34, 0.5, 0.8, 1.0])
def test_similar_sets_equal_every_pair(spark, share):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(400)]
    a, b = drawn(rng, 120, words), drawn(rng, 150, words)
    odd = [(900, 0, None), (901, 0, []), (902, 0, [None]), (None, 0, ["the"]), (903, None, ["the"]), (3, 1, ["the", None, "w1", "w1"])]
    a, b = a + odd, b + odd
    schema = "id long, house int, words array<string>"
    for block in ((), ("house",)):
        got = similar.similar(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema).withColumn("other", F.lit("x")), share, block).collect()
        want = {}
        for i, h, x in a:
            for j, k, y in b:
                x_, y_ = ({w for w in s or [] if w} for s in (x, y))
                n, u = len(x_ & y_), len(x_ | y_)
                if i is not None and j is not None and n and n >= share * u - 1e-9 and (not block or (h == k and h is not None)):
                    want[i, j] = max(want.get((i, j), (0, 0)), (n / u, n))
        assert {(r.id, r.other): (r.similarity, r.shared) for r in got} == want and len(got) == len(want) > 20


def test_candidates_grow_with_the_sets(spark):
    counts = []
    for n in (500, 2000, 8000):
        # a word that all have, some that a fixed share has, and a few of their own
        words = F.array(F.lit("all"), *(F.concat(F.lit(f"c{i}_"), (F.xxhash64("id", F.lit(i)) % 20).cast("string")) for i in range(3)), *(F.concat(F.lit("r"), F.pmod(F.xxhash64("id", F.lit(9 + i)), F.lit(n)).cast("string")) for i in range(4)))
        sets = spark.range(n).select("id", words.alias("words"))
        counts.append(similar.candidates(sets, sets, 0.7, []).count() / n)
    assert max(counts) < 12 and counts[2] < 2 * counts[0]


def apart(a, b):
    (x, y), (u, v) = ([math.radians(c) for c in p] for p in (a, b))
    h = math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2
    return 2 * places.RADIUS * math.asin(min(1, math.sqrt(h)))


def globe(rng, n):
    some = [(rng.choice([90.0, -90.0, 0.0, 89.9, -89.99]), rng.choice([180.0, -180.0, 179.95, -179.95, 0.0])) for _ in range(n // 4)]
    return [(i, *p) for i, p in enumerate(some + [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n - len(some))])]


@pytest.mark.parametrize("size", [0.7, 4.0, 60.0])
def test_radius_join_equals_the_product_also_at_poles_and_the_date_line(spark, size):
    rng = random.Random(6)
    centres, points = [(*c, rng.choice([0.0, 5.0, 120.0, 900.0])) for c in globe(rng, 60)], globe(rng, 300)
    centres += [(500, 10.0, 10.0, None), (501, None, 1.0, 5.0), (502, 0.0, 0.0, -1.0), (503, 3.0, 4.0, 13_000.0 if size > 1 else 60.0)]
    got = places.within(spark.createDataFrame(centres, "centre int, lat double, lng double, radius double"), spark.createDataFrame([*points, (900, None, 1.0)], "id int, lat double, lng double"), size).collect()
    want = {(c, i) for c, x, y, r in centres if None not in (x, r) and r >= 0 for i, u, v in points if apart((x, y), (u, v)) <= r}
    assert len(got) == len(want) and {(r.centre, r.id) for r in got} == want


def test_nearest_by_rings(spark, tmp_path):
    rng = random.Random(7)
    centres, points = globe(rng, 25), globe(rng, 200)

    def save(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} int, lat double, lng double")
    got = places.nearest(frame(centres, "centre"), frame(points, "id"), 7, 400.0, save).collect()
    for c, x, y in centres:
        mine = [(r.rank, r.id) for r in sorted(got, key=lambda r: r.rank) if r.centre == c]
        want = sorted((round(apart((x, y), (u, v)), 6), i) for i, u, v in points)[:7]
        assert [r for r, _ in mine] == list(range(1, 8)) and sorted(round(apart((x, y), points[i][1:]), 6) for _, i in mine) == [d for d, _ in want]


def test_fewer_points_than_asked_for(spark, tmp_path):
    def save(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} int, lat double, lng double")
    got = places.nearest(frame([(1, 0.0, 0.0)], "centre"), frame([(1, 0.0, 179.0), (2, 50.0, 3.0)], "id"), 7, 3000.0, save)
    assert [(r.rank, r.id) for r in got.orderBy("rank").collect()] == [(1, 2), (2, 1)]


def test_cuts_hang_on_the_cuts_before():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randrange(0, 80)))
        most = rng.randrange(2, 30)
        overlap = rng.randrange(0, most // 2)
        pieces = cuts(text, most, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for (a, b), (c, d) in zip(pieces, pieces[1:]):
            line = max((i for i in range(len(text)) if text[i] == "\n" and a + most / 2 < i <= a + most), default=None)
            assert b == (a + most if line is None else line) and c == max(a + 1, b - overlap) and d > b - overlap
    assert cuts("", 10, 2) == [(0, 0)] and cuts("x" * 25, 10, 0) == [(0, 10), (10, 20), (20, 25)]


def test_copies_of_names_make_no_pairs(spark, tmp_path):
    from quarry.operators import joins

    rows = [(i, "Brand#1", "red big" if i % 3 else "red box", "SMALL") for i in range(300)] + [(900, "Brand#1", "lone", "X"), (901, "Brand#2", "red big", "SMALL")]
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_name string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = {r.id: (r.best, r.shared) for r in joins.fuzzy_names(spark, str(tmp_path)).collect()}
    assert len(got) == 300 and got[0] == (3, 2) and got[3] == (0, 2) and got[1] == (2, 2) and got[5] == (1, 2)
    got = {r.id: (r.class_id, r.links) for r in joins.similar_titles(spark, str(tmp_path)).collect()}
    assert got[0] == (0, 99) and got[1] == (1, 200) and got[901] == (1, 200) and got[900] == (900, 0) and len(got) == 302


def test_pairs_of_few_rows_and_orders_are_dealt_to_many_tasks(spark):
    from quarry.operators import filters, ranking
    from quarry.plans import places

    sf = "/root/testdata/sf0.001"
    tasks = 4 * spark.sparkContext.defaultParallelism
    near = filters.radius_join(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert near.count("RepartitionByExpression [cell") == 2 and f", {tasks}" in near
    assert ranking.valued(spark, sf).rdd.getNumPartitions() >= 4
    assert abs(places.ring(900_000, 15) - 32.3) < 0.1 and places.ring(0, 15) == places.ring(3, 15) == 2 * places.RADIUS
