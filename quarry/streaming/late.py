"""Late rows as a side output: one stream, two sinks, and a watermark kept from batch to batch.

A row is late if it lies more than the allowed time before the highest time of earlier batches. Every
batch is written once, in a folder of its number with a part for rows in time and one for late ones,
so a batch that runs again replaces what it wrote; the watermark after it is a row beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def _is_late(ts: str, high, allowed: str):
    return F.coalesce(F.col(ts) < high - F.expr(f"INTERVAL {allowed}"), F.lit(False))


def late_by_batch(rows: DataFrame, batch: str, allowed: str, ts: str = "ts") -> DataFrame:
    """Batch form: ``rows`` with ``late``, against the highest time of lower batch numbers. A null time isn't late."""
    # a row for each batch
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    high = rows.groupBy(batch).agg(F.max(ts).alias("_top")).withColumn("_high", F.max("_top").over(before)).select(batch, "_high")
    return rows.join(high, batch).withColumn("late", _is_late(ts, F.col("_high"), allowed)).drop("_high")


def write_batch(rows: DataFrame, number: int, path: str, allowed: str, ts: str = "ts") -> None:
    """Write one batch to ``path``: its rows by ``late``, then the watermark after it. Running it again changes nothing."""
    spark = rows.sparkSession
    high = None
    if number:  # a row for each batch before
        known = spark.read.schema("number bigint, high timestamp").parquet(f"{path}/high")
        high = known.where(F.col("number") < number).agg(F.max("high")).head()[0]
    # a timestamp goes to the plan as microseconds, as the driver's zone may be another one
    micros = None if high is None else spark.createDataFrame([(high,)], "t timestamp").select(F.unix_micros("t")).head()[0]
    limit = F.timestamp_micros(F.lit(micros).cast("bigint"))
    target = f"{path}/rows/number={number}"
    rows.withColumn("late", _is_late(ts, limit, allowed)).write.mode("overwrite").partitionBy("late").parquet(target)
    written = spark.read.schema(rows.schema).parquet(target)
    after = written.agg(F.greatest(F.max(ts).cast("timestamp"), limit).alias("high")).select(F.lit(number).cast("bigint").alias("number"), "high")
    after.coalesce(1).write.mode("overwrite").parquet(f"{path}/high/number={number}")


def split_late(rows: DataFrame, path: str, allowed: str, ts: str = "ts", checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Streaming: each micro-batch through ``write_batch``."""
    out = rows.writeStream.foreachBatch(lambda df, number: write_batch(df, number, path, allowed, ts))
    return out.option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(**(trigger or {"processingTime": "1 minute"})).start()


def sides(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """What was written so far: rows in time and late rows, with the number of their batch."""
    rows = spark.read.schema(StructType([*schema.fields]).add("number", "long").add("late", "boolean")).parquet(f"{path}/rows")
    return rows.where("NOT late").drop("late"), rows.where("late").drop("late")
