"""Places on the globe: a grid of cells, a radius join of many centres, and nearest neighbours.

Rows of cells have equal height; each has as many cells as keep their width near that height, so cells
don't thin out towards the poles, and a row's cells go on across the date line. A point lies in one cell;
a centre names the cells that its circle touches, so near pairs meet by equality of cells and only
those are measured. Coordinates are degrees, distances miles on a sphere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the earth's radius in miles.
RADIUS = 3958.8
MILES_A_DEGREE = math.pi * RADIUS / 180


def miles(lat: Column, lng: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance."""
    half = lambda d: F.sin(F.radians(d) / 2)
    h = half(lat2 - lat) * half(lat2 - lat) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * half(lng2 - lng) * half(lng2 - lng)
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _row(lat: Column, size: float) -> Column:
    return F.floor((F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat)) + 90) / size)


def _columns(row: Column, size: float) -> Column:
    """Cells of a row: by its widest parallel, one at least."""
    low = row * size - 90
    flat = F.when((low < 0) & (low + size > 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(low + size)))
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(flat, F.lit(90.0)))) / size)).cast("bigint")


def _column(lng: Column, n: Column) -> Column:
    """The column of a longitude, counted on beyond the date line."""
    return F.floor((lng + 180) / 360 * n)


def cell(lat: Column, lng: Column, size: float) -> Column:
    row = _row(lat, size)
    n = _columns(row, size)
    return F.struct(row.alias("row"), F.pmod(_column(lng, n), n).alias("column"))


def cover(lat: Column, lng: Column, radius: Column, size: float) -> Column:
    """The cells that a circle may touch; each once."""
    angle = F.degrees(radius / RADIUS) * (1 + 1e-9) + 1e-9
    polar = (lat + angle >= 90) | (lat - angle <= -90)
    # half the longitudes of a circle that holds no pole
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.least(angle, F.lit(90.0)))) / F.cos(F.radians(lat))))) + 1e-9

    def row(r: Column) -> Column:
        n = _columns(r, size)
        first, last = _column(lng - wide, n), _column(lng + wide, n)
        whole = polar | (last - first + 1 >= n)
        columns = F.when(whole, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.transform(F.sequence(first, last), lambda c: F.pmod(c, n)))
        return F.transform(columns, lambda c: F.struct(r.alias("row"), c.alias("column")))

    return F.flatten(F.transform(F.sequence(_row(lat - angle, size), _row(lat + angle, size)), row))


def ring(n: int, wanted: int) -> float:
    """Miles around a place that hold so many of n points, were they spread evenly over the globe."""
    return 2 * RADIUS * math.sqrt(min(1.0, wanted / max(1, n)))


def within(centres: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """``centre, id, miles`` of the points within ``radius`` miles of each of ``centre, lat, lng, radius``.

    ``points``: id, lat, lng. ``size``: degrees of a cell; about the usual radius, as a circle names
    (2 * radius / size) ** 2 cells and some. Rows without a coordinate or radius meet nothing.
    """
    centres = centres.select("centre", F.col("lat").cast("double").alias("c_lat"), F.col("lng").cast("double").alias("c_lng"), F.col("radius").cast("double").alias("radius")).dropna().where("radius >= 0")
    points = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).dropna()
    centres = centres.withColumn("cell", F.explode(cover(F.col("c_lat"), F.col("c_lng"), F.col("radius"), size)))
    # dealt by a number, as pairs are many where rows are few, and what is told by bytes would be one task
    parts = 4 * centres.sparkSession.sparkContext.defaultParallelism
    near = centres.repartition(parts, "cell").join(points.withColumn("cell", cell(F.col("lat"), F.col("lng"), size)).repartition(parts, "cell"), "cell")
    return near.withColumn("miles", miles(F.col("c_lat"), F.col("c_lng"), F.col("lat"), F.col("lng"))).where("miles <= radius").select("centre", "id", "miles")


def nearest(centres: DataFrame, points: DataFrame, k: int, start: float, save) -> DataFrame:
    """``centre, rank, id, miles``: the k nearest points of each of ``centre, lat, lng``; ties by id.

    Rings of ``start`` miles, then twice as many each time: a centre that has k points within its ring is
    done, the others go on, at most until the ring is the globe. ``save(df, name)`` writes a table and
    reads it back, so that a round doesn't repeat those before it.
    """
    open_ = centres.select("centre", "lat", "lng").dropna().dropDuplicates(["centre"])
    radius, done, round_ = start, None, 0
    while True:
        last = radius >= math.pi * RADIUS
        size = min(90.0, max(radius / MILES_A_DEGREE, 1e-4))
        found = within(open_.withColumn("radius", F.lit(radius)), points, size)
        # at most k rows a centre and task are shuffled to the merge
        order = Window.partitionBy("centre").orderBy("miles", "id")
        best = save(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"ring{round_}")
        full = best.groupBy("centre").agg(F.count("*").alias("n")).where(F.lit(last) | (F.col("n") >= k)).select("centre")
        mine = best.join(full, "centre", "left_semi").select("centre", "rank", "id", "miles")
        done = mine if done is None else done.unionByName(mine)
        if last:
            return done
        open_ = save(open_.join(full, "centre", "left_anti"), f"open{round_}")
        if open_.isEmpty():
            return done
        radius, round_ = radius * 2, round_ + 1
