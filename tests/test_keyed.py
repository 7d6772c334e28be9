"""Machines with timers: streams in shuffled files against their batch form, timers without rows, cases by hand."""

import pytest
from oracle import rows
from pyspark.sql import functions as F

from quarry.sources.tables import load
from quarry.streaming import keyed
from quarry.streaming.keyed import DAY, HOUR, drive

SF = "/root/testdata/sf0.001"
SPEC = "key bigint, at bigint, seq bigint, kind string"


def looked(machine, *seen, until=None):
    state, _, out = drive(machine, None, None, [(int(h * HOUR), i, k) for i, (h, k) in enumerate(seen)], None if until is None else int(until * HOUR))
    return out, state


def test_schedule_climbs_resets_waits_an_hour_and_keeps_the_floor():
    out, _ = looked(keyed.SCHEDULE, (0, "same"), (1, "same"), (2, "error"), (3, "same"), (4, "changed"), (5, "same"))
    assert [(e, n, (u - at) // HOUR) for at, e, n, u in out] == [("same", 1, 12), ("same", 2, 24), ("error", 2, 1), ("due", 2, 0), ("same", 3, 48), ("changed", 0, 6), ("same", 1, 12)]
    out, _ = looked(keyed.SCHEDULE, (0, "changed"), *[(i, "same") for i in (1, 2, 3, 4)], (100, "same"), (167, "same"))
    assert [(u - at) / HOUR for at, e, n, u in out if e == "same"][-2:] == [68, 1]  # 7 days after the full reading
    out, _ = looked(keyed.SCHEDULE, (0, "changed"), (200, "same"), until=1000)
    assert [(e, at // HOUR) for at, e, n, u in out] == [("changed", 0), ("due", 6), ("same", 200), ("due", 200)]


def test_retries_double_wait_and_end():
    out, _ = looked(keyed.RETRIES, *[(i * 100, "failed") for i in range(6)], until=10_000)
    assert [(e, n, None if u is None else (u - at) // HOUR) for at, e, n, u in out] == [
        ("failed", 1, 1), ("retry", 1, None), ("failed", 2, 2), ("retry", 2, None), ("failed", 3, 4), ("retry", 3, None), ("failed", 4, 8), ("retry", 4, None), ("gave up", 5, None), ("gave up", 5, None),
    ]
    out, state = looked(keyed.RETRIES, (0, "blocked"), (0.1, "failed"), (0.2, "blocked"), (1, "ok"), (2, "ok"))
    assert [(e, n) for _, e, n, _ in out] == [("blocked", 1), ("failed", 2), ("blocked", 2), ("retry", 2), ("done", 2)] and state is None


def test_findings_open_count_expire_and_reopen():
    out, state = looked(keyed.FINDINGS, (0, "a"), (10, "a"), (20, "b"), (82, "b"), (200, "a"), until=250)
    assert [(at // HOUR, s, e, n) for at, s, e, n, _ in out] == [(0, "a", "opened", 1), (20, "b", "opened", 1), (82, "a", "expired", 2), (154, "b", "expired", 2), (200, "a", "opened", 1)]
    assert state == {"a": [200 * HOUR, 200 * HOUR, 1]}


def test_quota_never_passes_its_limit_and_a_refund_frees_one():
    out, state = looked(keyed.QUOTA, (0, "refund"), *[(1, "charge")] * 6, (2, "refund"), (3, "charge"), (4, "charge"), (25, "refund"), (26, "charge"), until=48)
    assert [(e, u) for _, _, e, u, _, _ in out] == [("nothing", 0)] + [("charged", i) for i in range(1, 6)] + [("refused", 5), ("refunded", 4), ("charged", 5), ("refused", 5), ("day over", 5), ("nothing", 0), ("charged", 1), ("day over", 1)]
    assert state is None
    again = [(HOUR, 1, "charge")] * 9
    assert len(drive(keyed.QUOTA, None, None, again, None)[2]) == 1  # a replayed event changes nothing


KINDS = {
    "SCHEDULE": {"view": "same", "signup": "same", "purchase": "changed", "error": "error"},
    "RETRIES": {"error": "failed", "signup": "blocked", "purchase": "ok"},
    "FINDINGS": {"error": "error", "click": "click"},
    "QUOTA": {"click": "charge", "view": "charge", "error": "refund"},
}


@pytest.mark.parametrize("name", sorted(KINDS))
def test_a_stream_of_shuffled_files_equals_the_batch(spark, tmp_path, name):
    machine, kinds = getattr(keyed, name), KINDS[name]
    e = load(spark, SF, "events").where(F.col("user_id") % 10 == 0)
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    df = e.select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), "ts").where("kind IS NOT NULL")
    # a row of another key moves the watermark to the end; no other key has rows after it
    far = spark.sql("SELECT -1L AS key, unix_micros(TIMESTAMP '2024-05-01') AS at, 0L AS seq, 'none' AS kind, TIMESTAMP '2024-05-01' AS ts")
    path = str(tmp_path / "in")
    df.orderBy(F.xxhash64("seq")).repartition(3).write.parquet(path)  # any order within the month
    far.write.mode("append").parquet(path)
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = keyed.stream(source, ["key"], machine, "60 days")
        q = out.writeStream.format("memory").queryName(f"keyed_{name}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
        q.awaitTermination(200)
        got = spark.table(f"keyed_{name}").where("key >= 0").toPandas()
    finally:
        spark.conf.unset(conf)
    until = 1709337600 * 1_000_000 - 1  # 60 days before the far row
    assert rows(got) == rows(keyed.batch(df, ["key"], machine, until).toPandas()) and len(got) > 10


def test_odd_rows(spark):
    made = spark.createDataFrame([(None, 5, 1, "charge"), (None, 5, 1, "charge"), (1, None, 1, "charge"), (2, 7, None, "refund")], SPEC).withColumn("used", F.lit("x"))
    got = keyed.batch(made, ["key"], keyed.QUOTA, 6 * DAY).collect()
    assert sorted((r.key or 0, r.event) for r in got) == [(0, "charged"), (0, "day over"), (2, "day over"), (2, "nothing")]
    assert keyed.batch(made.limit(0), ["key"], keyed.QUOTA, DAY).count() == 0
