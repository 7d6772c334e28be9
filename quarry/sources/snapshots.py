"""Tables kept by key in plain Parquet: upserts that rewrite only the buckets they touch.

A snapshot is a folder with one partition for each hash bucket of the key and a marker for each batch
that was applied. An upsert reads the old rows of its buckets (other buckets are pruned), merges the
last new row of each key, writes the result beside the snapshot and then replaces those partitions by
dynamic overwrite; a batch whose marker is there changes nothing. A batch that breaks off between the
two may be applied again: its rows give the same result, and rows without a key that it added before
are known by its number and replaced. One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@dataclass
class Snapshot:
    """A table of ``schema`` by ``key`` below ``path``; a row carries the number of the batch that wrote it as ``_batch``."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    buckets: int = 64

    @property
    def _full(self) -> StructType:
        return StructType([*self.schema.fields]).add("_batch", "long").add("_bucket", "integer")

    def _stored(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], self._full)
        return self.spark.read.schema(self._full).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def upsert(self, rows: DataFrame, batch: int, order: list[str], fill: tuple[str, ...] = (), guard: Column | None = None) -> bool:
        """Apply a batch; false if it was applied before.

        Of the rows of a key the last by ``order`` counts (columns of ``rows`` that the table need not
        have). A null in a column of ``fill`` keeps the old value. ``guard`` (over ``old.*`` and
        ``new.*``) names the updates that may happen; others keep the old row. Rows with a null key
        are all added.
        """
        marker = f"{self.path}/applied/{batch}"
        if exists(self.spark, marker):
            return False
        names = self.schema.names
        last = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_r")).select("_r.*")
        new = last.unionByName(rows.where(F.col(self.key).isNull()).select(*names))
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        stage = f"{self.path}/stage-{uuid.uuid4().hex}"
        new.withColumn("_bucket", bucket).withColumn("_batch", F.lit(batch).cast("bigint")).write.parquet(f"{stage}/new")
        new = self.spark.read.schema(self._full).parquet(f"{stage}/new")
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most as many as there are buckets
        old = self._stored().where(F.col("_bucket").isin(touched))
        old = old.where(F.col(self.key).isNotNull() | (F.col("_batch") != batch))
        both = old.alias("old").join(new.alias("new"), F.expr(f"old.{self.key} = new.{self.key}"), "full")
        update = F.col("new._bucket").isNotNull() & (F.col("old._bucket").isNull() | (F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True)))
        value = lambda c: F.when(update, F.coalesce(f"new.{c}", f"old.{c}") if c in fill else F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
        both.select(*(value(c) for c in (*names, "_batch", "_bucket"))).write.parquet(f"{stage}/merged")
        merged = self.spark.read.schema(self._full).parquet(f"{stage}/merged")
        merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/rows")
        self.spark.createDataFrame([(batch,)], "batch bigint").coalesce(1).write.mode("overwrite").parquet(marker)
        removed(self.spark, stage)
        return True
