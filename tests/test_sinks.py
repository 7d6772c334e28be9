"""The upsert sink and the late side output against plain Python."""

import glob
import os
import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources.snapshots import Snapshot
from quarry.sources.tables import load
from quarry.streaming import late

SF = "/root/testdata/sf0.001"
TABLE = StructType().add("key", "long").add("status", "string").add("price", "double")


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/rows/**/*.parquet", recursive=True)}


def test_upserts_touch_their_buckets_only_and_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    snap = Snapshot(spark, path, TABLE, "key", 8)
    rng, want = random.Random(4), {}
    for batch in range(4):
        rows = [(rng.randrange(40), rng.choice(["a", "b", "gone"]), rng.choice([None, 1.0, 2.0]), i) for i in range(30)] if batch < 3 else [(7, "a", 9.0, 0)]
        for k, s, p, _ in {r[0]: r for r in rows}.values():
            old = want.get(k)
            if old is None or old[0] != "gone":
                want[k] = (s, p if p is not None or old is None else old[1])
        df = spark.createDataFrame(rows, "key bigint, status string, price double, n int")
        before = files(path)
        how = dict(order=["n"], fill=("price",), guard=F.expr("old.status <> 'gone'"))
        assert snap.upsert(df, batch, **how)
        kept = files(path)
        assert {r.key: (r.status, r.price) for r in snap.read().collect()} == want
        assert not snap.upsert(df.withColumn("status", F.lit("other")), batch, **how) and files(path) == kept
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(7).cast("bigint")), F.lit(8))).head()[0]
    assert {f for f in before if f not in kept or before[f] != kept[f]} == {f for f in before if f"_bucket={bucket}/" in f}
    assert not glob.glob(f"{path}/stage*")


def test_rows_without_a_key_are_added_once_and_odd_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    snap = Snapshot(spark, path, TABLE, "key", 4)
    rows = spark.createDataFrame([(None, "a", 1.0, 1), (None, "a", 1.0, 1), (1, "x", None, 1), (1, "y", None, 2)], "key bigint, status string, price double, n int")
    assert snap.read().count() == 0 and snap.upsert(rows.limit(0), 0, ["n"]) and snap.upsert(rows, 1, ["n"])
    os.rename(f"{path}/applied/1", f"{path}/applied/lost")  # as if it broke off before its marker
    assert snap.upsert(rows, 1, ["n"])
    assert sorted((r.key or 0, r.status) for r in snap.read().collect()) == [(0, "a"), (0, "a"), (1, "y")]


def test_late_rows_go_to_their_side_in_any_file_order(spark, tmp_path):
    e = load(spark, SF, "events").select("event_id", "user_id", "ts")
    for order in ("ts", "xxhash64(event_id)"):
        at = tmp_path / order[:2]
        parts = e.repartitionByRange(5, F.expr(order)) if order == "ts" else e.orderBy(F.expr(order)).repartition(5)
        parts.write.parquet(str(at / "in"))
        source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(at / "in"))
        out = f"file://{at}/out"
        assert late.split_late(source, out, "2 DAYS", availableNow=True).awaitTermination(120)
        kept, lost = late.sides(spark, out, StructType([*e.schema.fields]))
        both = kept.unionByName(lost)
        assert sorted(r.event_id for r in both.collect()) == sorted(r.event_id for r in e.collect()) and both.agg(F.countDistinct("number")).head()[0] == 5
        want = late.late_by_batch(both, "number", "2 DAYS").where("late")
        assert {r.event_id for r in want.collect()} == {r.event_id for r in lost.collect()}
        assert lost.count() > 100 or order == "ts"  # files of one moment come in any order
        # a batch that runs again
        again = both.where("number = 2").drop("number")
        again.write.parquet(str(at / "again"))
        n = lost.count()
        late.write_batch(spark.read.parquet(str(at / "again")), 2, out, "2 DAYS")
        kept, lost = late.sides(spark, out, StructType([*e.schema.fields]))
        assert lost.count() == n and kept.count() + n == e.count()


def test_late_rows_odd_cases(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "2024-01-02")], "id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"file://{tmp_path}"
    late.write_batch(rows.limit(0), 0, out, "1 HOUR")
    late.write_batch(rows, 1, out, "1 HOUR")
    late.write_batch(rows.withColumn("ts", F.expr("ts - INTERVAL 2 HOURS")), 2, out, "1 HOUR")
    kept, lost = late.sides(spark, out, StructType([*rows.schema.fields]))
    assert sorted((r.id, r.number) for r in kept.collect()) == [(1, 1), (1, 2), (2, 1)] and [(r.id, r.number) for r in lost.collect()] == [(2, 2)]


def test_sitemaps_are_split_and_lose_nothing(spark, tmp_path):
    from quarry.sources.files import write_sitemaps

    rows = spark.range(95).select(F.concat(F.lit("https://x/?a=1&b="), F.col("id")).alias("loc"), F.lit("2026-01-01").alias("lastmod")).orderBy("loc")
    write_sitemaps(rows, str(tmp_path / "s"), 20)
    parts = [open(f).read() for f in glob.glob(f"{tmp_path}/s/part-*")]
    assert all(0 < p.count("<url>") <= 20 and p.count("<urlset>") == 1 for p in parts) and sum(p.count("<url>") for p in parts) == 95
    back = spark.read.schema("loc string, lastmod string").format("xml").option("rowTag", "url").load(str(tmp_path / "s"))
    assert sorted(r.loc for r in back.collect()) == sorted(r.loc for r in rows.collect())
