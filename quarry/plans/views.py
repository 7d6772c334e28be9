"""Named searches and browse orders over listings, all of them in one pass.

Rows have ``id, price, score, vacant, kind, gross, warned, street, split, units, opps, condition, deal_type,
signals, income, sale_date, below_market, net_yield, roce, days_since``. Every view gives a row that it
takes up to three numbers to be sorted by, higher first; a view's first rows are found behind a literal
bound, so tasks drop the others before the shuffle. Ties go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least score of a pick, a low price, a high yield; a street's price that counts, the share of it and the price and yield that give a token guide away.
PICK, LOW, HIGH = 3, 100_000, 8
STREET, TOKEN_SHARE, TOKEN_PRICE, TOKEN_YIELD = 50_000, 0.30, 15_000, 30

_c = F.col
UNKNOWN = -1e9


def _or(c: str, other: float = 0.0) -> Column:
    return F.coalesce(_c(c).cast("double"), F.lit(other))


def _known(c: str, where: Column | None = None) -> Column:
    """A number, the least of all where it isn't known."""
    value = _c(c).cast("double")
    return F.coalesce(value if where is None else F.when(where, value), F.lit(UNKNOWN))


def token_guide() -> Column:
    """A price far below its street, or so low that its yield can't be meant."""
    priced = F.coalesce(_c("price") > 0, F.lit(False))
    far = priced & F.coalesce((_c("street") >= STREET) & (_c("price") / _c("street") <= TOKEN_SHARE), F.lit(False))
    return far | (priced & (_c("price") <= TOKEN_PRICE) & (_or("gross") > TOKEN_YIELD))


def _says(c: str, pattern: str) -> Column:
    return F.exists(F.coalesce(_c(c), F.array().cast("array<string>")), lambda o: F.coalesce(o.rlike(f"(?i){pattern}"), F.lit(False)))


def _has(c: str, value: str) -> Column:
    return F.coalesce(F.array_contains(_c(c), value), F.lit(False))


def presets() -> dict[str, tuple[Column, list[Column]]]:
    """What each named search takes, and what sorts it."""
    best = [_or("score")]
    cheap = [-F.coalesce(F.nullif(_c("price").cast("double"), F.lit(0.0)), F.lit(1e18))]
    return {
        "top-picks": (_or("score") >= PICK, best),
        "under-100k": ((_or("price") > 0) & (_c("price") < LOW), cheap),
        "vacant": (_c("vacant"), best),
        "flats": (_c("kind") == "flat", best),
        "high-yield-8": ((_or("gross") >= HIGH) & ~F.coalesce(_c("warned"), F.lit(False)) & ~token_guide(), [_or("gross")]),
        "title-splits": (_c("split"), [_or("units"), _or("score")]),
        "probate": (_says("opps", "executor|probate"), best),
        "heavy-refurb": (_c("condition").isin("needs work", "poor"), best),
        "dev-land": (_says("opps", "development"), best),
        "commercial": (_c("kind") == "commercial", best),
        "land-dev": (F.coalesce(_c("kind") == "land", F.lit(False)) | _says("opps", "development"), best),
        "hmo": (F.coalesce(_c("deal_type") == "HMO", F.lit(False)) | _has("signals", "hmo"), [_has("signals", "investment-valuation").cast("double"), _or("income"), _or("score")]),
    }


def orders(today: Column) -> dict[str, tuple[Column, list[Column]]]:
    """Browse orders; unknown values and token guides sink."""
    every, real, (_, cheap) = F.lit(True), ~token_guide(), presets()["under-100k"]
    day = F.coalesce(_c("sale_date"), F.lit("9999-12-31").cast("date"))
    return {
        "date_asc": (every, [(day >= today).cast("double"), -F.unix_date(day).cast("double"), _or("score")]),
        "price_asc": (every, cheap),
        "price_desc": (every, [_or("price")]),
        "yield": (every, [_known("gross", real)]),
        "bmv": (every, [_known("below_market", real)]),
        "net_yield": (every, [_known("net_yield", real)]),
        "roce": (every, [_known("roce", real)]),
        "days_unsold": (every, [_or("days_since")]),
        "score": (every, [_or("score"), *cheap]),
    }


def ranked(rows: DataFrame, views: dict[str, tuple[Column, list[Column]]], most: int) -> DataFrame:
    """``view, rank, id``: the first rows of each view."""
    zero = F.lit(0.0)

    def entry(name: str, where: Column, keys: list[Column]) -> Column:
        k = [*keys, zero, zero][:3]
        return F.when(F.coalesce(where, F.lit(False)), F.struct(F.lit(name).alias("view"), *(x.alias(f"k{i}") for i, x in enumerate(k))))

    each = rows.select("id", F.explode(F.array_compact(F.array(*(entry(n, w, k) for n, (w, k) in views.items())))).alias("v")).select("id", "v.*")
    order = Window.partitionBy("view").orderBy(F.desc("k0"), F.desc("k1"), F.desc("k2"), "id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("view", "rank", "id")
