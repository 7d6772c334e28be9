"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Each step is one min-aggregation and one join on the vertex; hubs are combined before the
shuffle. Every round is written to the shared folder, so lineage stays short and a lost
executor costs a task and not the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(vertex, component)`` of every vertex with an edge; the component is its least vertex.

    Null ends and loops are left out. The result is written and read back.
    """
    tables, round_ = Scratch(edges.sparkSession), 0
    edges = tables.save(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "edges0")
    mark = None
    while True:
        round_ += 1
        edges = tables.save(_small(_large(edges)), f"edges{round_}")
        tables.drop(f"edges{round_ - 1}")
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    member = edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return member.unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
