from oracle import rows
from pyspark.sql import functions as F

from quarry.sources.tables import load
from quarry.streaming import changes, circuits


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).toPandas()


def _source(spark, tmp_path, df, parts=1):
    path = str(tmp_path / "in")
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_change_stream_equals_batch(spark, tmp_path):
    e = load(spark, "/root/testdata/sf0.001", "events")
    states = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 7).cast("double")).alias("price"))
    got = _run(changes.change_stream(_source(spark, tmp_path, states)), "changes")
    assert rows(got) == rows(changes.change_events(states).toPandas())


def test_windowed_health_equals_batch(spark, tmp_path):
    e = load(spark, "/root/testdata/sf0.001", "events").select("ts", "user_id", "event_type")
    got = _run(changes.health(_source(spark, tmp_path, e), late="1 hour"), "health", "complete")
    assert rows(got) == rows(changes.health(e).toPandas())


def test_duplicates_come_once(spark, tmp_path):
    e = load(spark, "/root/testdata/sf0.001", "events").select("event_id", "ts")
    got = _run(changes.events_once(_source(spark, tmp_path, e.unionByName(e)), "60 days"), "once")
    assert len(got) == e.count()


def test_alert_stream_equals_batch(spark, tmp_path):
    e = load(spark, "/root/testdata/sf0.001", "events").where("event_type = 'error'")
    rows_ = e.select((F.col("user_id") % 6).alias("house"), (F.col("event_id") % 2).alias("kind"), "event_id", "ts")
    got = _run(circuits.alert_stream(_source(spark, tmp_path, rows_)), "alerts")
    want = circuits.alerts(rows_).toPandas()
    assert rows(got) == rows(want) and 0 < want["sent"].sum() < len(want)


def test_an_alert_comes_once_within_its_time(spark, tmp_path):
    made = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (2, "2024-01-01 00:10:00"), (2, "2024-01-01 00:10:00")]
    df = spark.createDataFrame(made, "house long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = _run(changes.alerts_once(_source(spark, tmp_path, df), ["house"], "1 hour"), "once_within")
    assert sorted(got["house"]) == [1, 2]
