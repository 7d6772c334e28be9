"""Dates in texts and slugs, ages and horizons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months, and the forms that dates have in texts and slugs.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ENDS, WHOLE, SHORT = r"(?i)sale\s*ends?:\s*(\d{2})/(\d{2})/(\d{4})", r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\s+(20\d{2})\b", r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\b"
SLUG_DAY, SLUG_END = r"(\d{1,2})(?:st|nd|rd|th)?", r"-(\d{4})-(\d+)$"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once; where a lambda names an expression, it is computed at every place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def month(word: Column) -> Column:
    """The number of a month's name; null for other words."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(word, 1, 3))), F.lit(0)).cast("int")


def made(year: Column, number: Column, day: Column) -> Column:
    """A date of its parts, or null if there is none such."""
    # by arithmetic: a parser that throws on every text without a date takes most of the time
    first = lambda p: F.when(p["y"].between(0, 9999) & p["m"].between(1, 12), F.make_date(p["y"], p["m"], F.lit(1)))
    date = lambda p, first: F.when((p["d"] >= 1) & (p["d"] <= F.dayofmonth(F.last_day(first))), F.date_add(first, p["d"] - 1))
    return bound(F.struct(year.alias("y"), number.alias("m"), day.alias("d")), lambda p: bound(first(p), lambda f: date(p, f)))


def sale_date(line: Column, today: Column, word: str = "sale") -> Column:
    """The date of a line: its end, a whole date, or a day of this year that isn't past, if ``word`` is named."""
    t = F.trim(F.replace(line, F.lit(" "), F.lit(" ")))
    part = lambda p, k: F.regexp_extract(t, p, k)
    number = lambda p, k: part(p, k).try_cast("int")
    ends = made(number(ENDS, 3), number(ENDS, 2), number(ENDS, 1))
    whole = made(number(WHOLE, 3), month(part(WHOLE, 2)), number(WHOLE, 1))
    short = made(F.year(today), month(part(SHORT, 2)), number(SHORT, 1))
    soon = F.when(t.rlike(rf"(?i)\b{word}\b") & ~t.rlike(WHOLE) & (short >= today), short)
    return F.coalesce(ends, whole, soon)


def first_sale_date(lines: Column, today: Column) -> Column:
    """The first date that any of the lines has."""
    return F.get(F.filter(F.transform(lines, lambda x: sale_date(x, today)), lambda d: d.isNotNull()), F.lit(0))


def slug_dates(slug: Column) -> Column:
    """``struct<start, end, sale>`` of a slug like 28--29-july-2026-227 or 30-june--1-july-2026-231; null if it has none."""
    s = F.lower(slug)
    year, sale = F.regexp_extract(s, SLUG_END, 1).try_cast("int"), F.regexp_extract(s, SLUG_END, 2)
    words = F.filter(F.split(F.regexp_replace(s, SLUG_END, ""), "-"), lambda w: w != "")
    # each day takes the first month named after it
    marked = F.transform(words, lambda w: F.struct(F.regexp_extract(w, rf"^{SLUG_DAY}$", 1).try_cast("int").alias("day"), F.when(F.length(w) > 2, month(w)).alias("month")))
    named = lambda all_, i: F.get(F.filter(F.slice(all_, i + 1, F.size(all_)), lambda x: x["month"].isNotNull()), F.lit(0))["month"]
    dated = lambda p: F.transform(p["marked"], lambda m, i: F.when(m["day"].isNotNull(), made(p["year"], named(p["marked"], i), m["day"])))
    days = bound(F.struct(year.alias("year"), marked.alias("marked")), lambda p: F.filter(dated(p), lambda d: d.isNotNull()))
    ends = bound(days, lambda d: F.when(F.size(d) > 0, F.struct(F.get(d, F.lit(0)).alias("start"), F.get(d, F.size(d) - 1).alias("end"))))
    return bound(F.struct(ends.alias("days"), sale.alias("sale")), lambda p: F.when(p["days"].isNotNull(), F.struct(p["days"]["start"].alias("start"), p["days"]["end"].alias("end"), p["sale"].alias("sale"))))


def horizon(n_dated: Column, next_day: Column, last_day: Column, today: Column, near: int = 30, stale: int = 90) -> Column:
    """What a group of dated rows promises: soon, later, lapsed, dormant, or undated."""
    return (
        F.when(n_dated == 0, "undated")
        .when(next_day <= F.date_add(today, near), "soon")
        .when(next_day.isNotNull(), "later")
        .when(last_day >= F.date_sub(today, stale), "lapsed")
        .otherwise("dormant")
    )


def date_points(listed: Column, in_title: Column, future: Column, weekday: Column, agrees: Column) -> Column:
    """0 to 100 for a date candidate by where it was found and whether it is likely."""
    flag = lambda when, pts: F.when(F.coalesce(when, F.lit(False)), pts).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), flag(listed, 40) + flag(in_title, 20) + flag(future, 25) + flag(weekday, 5) + flag(agrees, 20) - flag(~future, 30)))


def date_reasons(listed: Column, in_title: Column, future: Column, weekday: Column, agrees: Column) -> Column:
    named = {"listed": listed, "title": in_title, "future": future, "weekday": weekday, "agrees": agrees}
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in named.items()]))


def confidence(points: Column) -> Column:
    return F.when(points >= 70, "high").when(points >= 40, "medium").otherwise("low")
