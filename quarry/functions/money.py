"""Purchase tax, running yields and bids as column expressions over a listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (from, rate) of each band of the residential surcharge rates.
BANDS = {
    "england": [(0, 0.05), (250_000, 0.10), (925_000, 0.15), (1_500_000, 0.17)],
    "wales": [(0, 0.04), (180_000, 0.075), (250_000, 0.09), (400_000, 0.115), (750_000, 0.14), (1_500_000, 0.16)],
    "scotland": [(0, 0.06), (145_000, 0.08), (250_000, 0.11), (325_000, 0.16), (750_000, 0.18)],
}
#: Defaults of a deal: share borrowed, rate, fees, running costs, refinance share, works by condition.
ASSUMED = {"ltv": 0.75, "rate_pct": 5.5, "buyer_fee": 1500, "legals": 2000, "mgmt_pct": 10, "voids_pct": 8, "insurance": 300, "refi_ltv": 0.75}
WORKS_PCT = {"poor": 30, "needs work": 15}


def half_up(x: Column) -> Column:
    """Rounds to the nearest integer, halves up."""
    return F.floor(x + 0.5)


def banded(price: Column, bands: list[tuple[float, float]]) -> Column:
    total = F.lit(0.0)
    for (low, rate), high in zip(bands, [b[0] for b in bands[1:]] + [None]):
        part = price - low if high is None else F.least(price, F.lit(high)) - low
        total = total + F.greatest(part, F.lit(0)) * F.lit(rate)
    return total


def purchase_tax(price: Column, country: Column) -> Column:
    """Tax in whole pounds; unknown countries count as england."""
    p = price.cast("double")
    return half_up(F.when(country == "scotland", banded(p, BANDS["scotland"])).when(country == "wales", banded(p, BANDS["wales"])).otherwise(banded(p, BANDS["england"])))


def works(price: Column, condition: Column) -> Column:
    pct = F.when(condition == "poor", WORKS_PCT["poor"]).when(condition == "needs work", WORKS_PCT["needs work"]).otherwise(0)
    return half_up(F.coalesce(price.cast("double"), F.lit(0.0)) * pct / 100)


def true_cost(price: Column, country: Column, a: dict = ASSUMED) -> Column:
    """Price, tax and fees; null without a price."""
    return F.nullif(price, F.lit(0)) + purchase_tax(price, country) + F.lit(a["buyer_fee"] + a["legals"])


def net_income(monthly_rent: Column, a: dict = ASSUMED) -> Column:
    """A year's rent less running costs; null without a rent."""
    return F.when(monthly_rent > 0, monthly_rent * 12 * (1 - (a["mgmt_pct"] + a["voids_pct"]) / 100) - a["insurance"])


def net_yield(price: Column, rent: Column, country: Column, a: dict = ASSUMED) -> Column:
    return F.try_divide(net_income(rent, a), true_cost(price, country, a)) * 100


def roce(price: Column, rent: Column, country: Column, condition: Column, a: dict = ASSUMED) -> Column:
    """Yearly cash after interest over the cash put in."""
    p = F.nullif(price, F.lit(0)).cast("double")
    cash = p * (1 - a["ltv"]) + purchase_tax(price, country) + a["buyer_fee"] + a["legals"] + works(price, condition)
    return F.try_divide(net_income(rent, a) - p * a["ltv"] * a["rate_pct"] / 100, cash) * 100


def recycled_pct(price: Column, estimate: Column, country: Column, condition: Column, a: dict = ASSUMED) -> Column:
    p = F.nullif(price, F.lit(0)).cast("double")
    return F.try_divide(estimate * a["refi_ltv"], p + purchase_tax(price, country) + a["buyer_fee"] + a["legals"] + works(price, condition)) * 100


def max_bid(rent: Column, target_pct: float) -> Column:
    """The price at which the rent gives the target gross yield."""
    return F.when(rent > 0, half_up(rent * 12 / (target_pct / 100)))
