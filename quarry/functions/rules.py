"""Verdicts, quality points, value estimates and clocks of listings as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of each field of a listing.
WEIGHTS = {"image": 25, "price": 25, "postcode": 15, "address": 10, "uprn": 10, "epc": 8, "tenure": 4, "beds": 3}
#: Percent by which each signal moves a value, and the limits of the sum.
ADJUST = {"Poor condition": -25, "Sitting tenant": -20, "Knotweed": -15, "Needs modernisation": -10, "Non-std construction": -10, "Contamination": -8, "Flying freehold": -8, "Flood risk": -5, "Vacant": 3}
ADJUST_LOW, ADJUST_HIGH, WORKS_SHARE = -45, 20, 0.7
#: Recall gate.
TOLERANCE, ERROR_FLOOR = 0.02, 0.85


def half_up(x: Column, unit: int = 1) -> Column:
    return F.floor(x / unit + 0.5) * unit


def quality_points(there: dict[str, Column], status: Column) -> Column:
    """0 to 100: the points of the fields that are there; a price may be missing for a good reason."""
    total = F.lit(0)
    for field, points in WEIGHTS.items():
        has = F.coalesce(there.get(field, F.lit(False)), F.lit(False))
        if field == "price":
            excused = F.when(status.isin("sold", "withdrawn", "nil_reserve", "starting_bid"), points).when(status.isin("poa", "tba"), points // 2).otherwise(0)
            total = total + F.when(has, points).otherwise(excused)
        else:
            total = total + F.when(has, points).otherwise(0)
    return total


def issues(there: dict[str, Column]) -> Column:
    """The names of the missing fields, in the order of the weights."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(there.get(f, F.lit(False)), F.lit(False)), F.lit(f"no_{f}")) for f in WEIGHTS]))


def adjustment(signals: Column) -> Column:
    """Percent by the signals of a listing, between the limits; null signals move nothing."""
    total = F.lit(0)
    for name, pct in ADJUST.items():
        total = total + F.when(F.coalesce(F.array_contains(signals, name), F.lit(False)), pct).otherwise(0)
    return F.greatest(F.lit(ADJUST_LOW), F.least(F.lit(ADJUST_HIGH), total))


def confidence(comps: Column, by_area: Column, floor_area: Column) -> Column:
    """high, medium or low by comparable sales, where the anchor comes from, and a known floor area."""
    c = F.coalesce(comps, F.lit(0))
    sized = floor_area.isNotNull()
    points = F.when(c >= 5, 2).when(c >= 2, 1).when((c == 1) & ~by_area, -1).otherwise(0)
    points = points + F.when(by_area, -1).when((c >= 5) & sized, 1).otherwise(0) + F.when(sized, 1).otherwise(-1)
    return F.when(points >= 3, "high").when(points >= 1, "medium").otherwise("low")


def estimate(anchor: Column, signals: Column, works: Column) -> Column:
    """The anchor, moved by the signals and less part of the works, in hundreds; null without an anchor."""
    less = half_up(F.greatest(F.coalesce(works, F.lit(0)), F.lit(0)) * WORKS_SHARE)
    return F.when(anchor.isNotNull(), F.greatest(F.lit(1), half_up(anchor * (1 + adjustment(signals) / 100) - less, 100))).cast("bigint")


def band(value: Column, sure: Column) -> tuple[Column, Column]:
    """Low and high of an estimate."""
    pct = F.when(sure == "high", 5).when(sure == "medium", 10).otherwise(20)
    return F.greatest(F.lit(1), half_up(value * (100 - pct) / 100, 100)).cast("bigint"), half_up(value * (100 + pct) / 100, 100).cast("bigint")


def recall_severity(recall: Column) -> Column:
    """info, warning or error; an unknown recall is no gap."""
    return F.when(recall.isNull() | (recall >= 1 - TOLERANCE), "info").when(recall < ERROR_FLOOR, "error").otherwise("warning")


def count_verdict(now: Column, usual: Column) -> Column:
    """regression under half of the usual count, degraded under four fifths; counts of up to 5 are no baseline."""
    return F.when((usual > 5) & (now * 2 < usual), "regression").when((usual > 5) & (now * 5 < usual * 4), "degraded").otherwise("healthy")


def batch_gate(rows: Column, quality: Column, verdict: Column, cached: Column) -> Column:
    """reject, warn or cache, by the first rule that fits."""
    c = F.coalesce(cached, F.lit(0))
    return (
        F.when(rows < 1, "reject")
        .when(rows < 3, "warn")
        .when((verdict == "regression") & (c > 0) & (c > rows * 3), "warn")
        .when(F.coalesce(quality, F.lit(0.0)) < 0.60, "warn")
        .when(verdict == "degraded", "warn")
        .otherwise("cache")
    )


def guide_distortion(price: Column, reference: Column, token: int = 1000, share: float = 0.3) -> Column:
    """Why a guide price says little about the value: ``token``, ``extreme_discount``, or null."""
    return F.when(price <= token, "token").when(price < reference * share, "extreme_discount")


def sane_price(price: Column, residential: Column) -> Column:
    """Null for homes under 5,000."""
    return F.when(~(F.coalesce(residential, F.lit(False)) & (price < 5000)), price)


def stale_date(day: Column, seen: Column, today: Column, grace: int = 14) -> Column:
    """The date, or for undated rows unseen for ``grace`` days the day on which they passed that."""
    return F.coalesce(day, F.when(F.date_add(seen, grace) < today, F.date_add(seen, grace)))


def cache_hours(tier: Column, hours_left: Column, tiers: dict[str, int], near: int = 48, near_ttl: int = 6) -> Column:
    """Time to live of a tier, shorter close to the event."""
    own = F.coalesce(*[F.when(tier == k, v) for k, v in tiers.items()], F.lit(max(tiers.values())))
    return F.when((hours_left > 0) & (hours_left < near), F.least(own, F.lit(near_ttl))).otherwise(own)


def ranked(value: Column, order: Iterable[str]) -> Column:
    """The place of a value in a fixed order; others come last."""
    names = list(order)
    return F.coalesce(*[F.when(value == n, i) for i, n in enumerate(names)], F.lit(len(names)))


def regressed(rows: DataFrame, images: float = 30, field: float = 40, known: float = 30, lost: float = 80) -> DataFrame:
    """Adds ``reasons`` and ``verdict`` to ``usual, lots, was, is_, had, has``: what fell, by more than so many points."""
    c = F.col
    reasons = [
        F.when((c("usual") > 5) & (c("lots") < 0.5 * c("usual")), "error:lots").when((c("usual") > 5) & (c("lots") < 0.8 * c("usual")), "warning:lots"),
        F.when((c("was") > 30) & (c("was") - c("is_") > images), "warning:images"),
        F.when((c("had") >= known) & (c("had") - c("has") > field), "warning:field"),
        F.when((c("had") > lost) & (c("has") == 0), "warning:lost"),
    ]
    rows = rows.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return rows.withColumn("verdict", F.when(F.array_contains("reasons", "error:lots"), "regression").when(F.size("reasons") > 0, "degraded").otherwise("healthy"))


def demotion(recall: Column, rival: Column, lots: Column, found: Column, least: int = 5) -> Column:
    """Whether a cheaper way may take over: parity, or why not."""
    return F.when(recall.isNull() | rival.isNull(), "no signal").when(lots < least, "too few").when(found < lots, "found fewer").when(rival >= recall, "parity").otherwise("shortfall")
