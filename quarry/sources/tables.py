"""Readers of the library's tables, and the listing views that the operators work on.

``timestamp_ntz`` columns are read as UTC timestamps, because watermarks need them. The clock is
an argument of every operator; the registered queries use the constants below, so that a query
and its SQL agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Clocks of the registered queries.
EVENTS_NOW, ORDERS_TODAY = "2024-01-31 00:00:00", "2001-08-02"


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to twice as many tasks as there are cores, for costly work on a small file, which is one task by itself."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def now() -> Column:
    return F.lit(EVENTS_NOW).cast("timestamp")


def today() -> Column:
    return F.lit(ORDERS_TODAY).cast("date")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity events with ``k``, the number in their JSON payload."""
    return load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per listing: an order with its customer's nation as house."""
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
    status = F.when(F.col("o_orderstatus") == "O", "available").when(F.col("o_orderstatus") == "P", "stc").otherwise("sold")
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("n_name").alias("house"),
        F.col("c_custkey").alias("owner"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        status.alias("status"),
        F.to_date("o_orderdate").alias("sale_date"),
        F.col("c_mktsegment").alias("prop_type"),
        F.col("o_orderpriority").alias("deal_type"),
        F.col("n_regionkey").alias("region"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("balance"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable sales: line items with their part as place and its type."""
    line, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    joined = line.join(p, line.l_partkey == p.p_partkey)
    unit = (F.col("l_extendedprice").cast("decimal(18,2)") * 100 / F.col("l_quantity").cast("decimal(18,2)")).cast("bigint")
    return joined.select(
        F.col("l_partkey").alias("postcode"),
        F.substring_index("p_type", " ", 1).alias("kind"),
        F.col("p_brand").alias("district"),
        unit.alias("pence"),
        F.to_date("l_shipdate").alias("sold_on"),
        F.col("l_orderkey").alias("sale_id"),
        F.col("l_linenumber").alias("line"),
    )


#: The same views in DuckDB.
LISTINGS = """listings AS (
  SELECT o_orderkey AS id, n_name AS house, c_custkey AS owner, o_totalprice::DECIMAL(18,2) AS price,
    CASE o_orderstatus WHEN 'O' THEN 'available' WHEN 'P' THEN 'stc' ELSE 'sold' END AS status,
    o_orderdate::DATE AS sale_date, c_mktsegment AS prop_type, o_orderpriority AS deal_type,
    n_regionkey AS region, c_acctbal::DECIMAL(18,2) AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
EVENTS = "ev AS (SELECT *, (props->>'$.k')::INT AS k FROM events)"
SALES = """sales AS (
  SELECT l_partkey AS postcode, split_part(p_type, ' ', 1) AS kind, p_brand AS district,
    trunc(l_extendedprice::DECIMAL(18,2)::DECIMAL(30,8) * 100 / l_quantity::DECIMAL(18,2))::BIGINT AS pence,
    l_shipdate::DATE AS sold_on, l_orderkey AS sale_id, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
