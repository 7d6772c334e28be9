"""Rents, discounts and the money of a deal as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .money import half_up

#: Monthly rents by beds 0 to 4, first match of the address in this order; None is the fallback.
RENTS: dict[str | None, list[int]] = {
    "london": [1200, 1500, 1800, 2200, 2800],
    "bristol": [750, 900, 1100, 1400, 1700],
    "bath": [700, 850, 1100, 1400, 1700],
    "leeds": [600, 700, 850, 1050, 1300],
    "york": [600, 750, 950, 1150, 1400],
    "south east": [750, 950, 1200, 1500, 1800],
    "south west": [600, 750, 950, 1150, 1400],
    "east midlands": [500, 600, 750, 950, 1150],
    "west midlands": [550, 650, 800, 1000, 1250],
    "north west": [500, 600, 750, 950, 1150],
    "north east": [400, 475, 575, 700, 900],
    "yorkshire": [400, 475, 575, 700, 900],
    "wales": [475, 575, 700, 875, 1050],
    "scotland": [500, 600, 750, 950, 1200],
    None: [550, 675, 825, 1025, 1275],
}
#: What rents have risen by since.
UPLIFT: dict[str | None, float] = {"bristol": 1.25, "bath": 1.2, "london": 1.1, None: 1.1}
#: Addresses, sorts and states of the registered queries.
PLACES = ["1 high street, leeds", "flat 2, bath road, bristol", "old hall, north yorkshire", "3 mill lane, kent, south east", "unit 5, nowhere", "9 quay, london"]
SORTS = ["house", "Flat", "HMO", "shop", "warehouse", "plot", "castle", "mixed use"]
STATES = ["good", "poor", "derelict", "needs_refresh", "light_refurb", "shell"]
ADDRESSES = ["1 Princes Street, Edinburgh EH1 2AA", "2 Queen Street, Cardiff", "3 Mill Lane, Leeds LS1 1AA", "4 The Quay, Swansea SA1 1AA", "5 High Street, Dover"]
#: Kinds of property, loan to value by kind, works by state (first match), places of another country.
TYPES = {"hmo": "hmo", "mixed_use": "mixed_use", "mixed use": "mixed_use", "commercial": "commercial", "shop": "commercial", "retail": "retail", "office": "office", "industrial": "industrial", "warehouse": "industrial", "land": "land", "plot": "land", "development_site": "development_site", "development site": "development_site"}
LTV = {"residential": 75, "hmo": 75, "mixed_use": 75, "commercial": 60, "office": 60, "retail": 60, "industrial": 60, "land": 45, "development_site": 45}
WORKS = [(("derelict", "major_works", "shell"), 0.35), (("poor", "needs_modernisation", "cosmetic_plus"), 0.20), (("cosmetic", "light_refurb", "needs_refresh"), 0.08)]
UPLIFT_SHARE, MONTHS = 0.15, 6
ELSEWHERE = {"Scotland": r"(?i)\b(edinburgh|glasgow|aberdeen|dundee|inverness|perth|stirling|eh\d|g\d|ab\d|dd\d|iv\d|ph\d)", "Wales": r"(?i)\b(cardiff|swansea|newport|wrexham|bangor|llanelli|cf\d|sa\d|np\d|ll\d)"}
#: What the verdict reckons with: contingency on works, tax, fees, monthly interest, selling cost, and the stress.
RECKONED = {"contingency": 1.1, "tax": 0.05, "fees": 3500, "monthly": 0.0095, "sells_for": 0.985, "stress": 0.9, "stress_months": 9, "return_pct": 20}


def sql_map(values: dict, of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in values.items()) + " END"


def sql_works(of: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({of}), '{'|'.join(names)}') THEN {pct}::DOUBLE" for names, pct in WORKS) + " END"


def sql_place(of: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({of}, '{p}') THEN '{name}'" for name, p in ELSEWHERE.items()) + " ELSE 'England' END"


def _looked_up(values: dict, of: Column) -> Column:
    return F.coalesce(*[F.when(of == k, F.lit(v)) for k, v in values.items()])


def monthly_rent(address: Column, beds: Column, units: Column, rents: dict = RENTS) -> Column:
    """Whole pounds a month: the first place of the table that the address names, by the beds of a unit, times the units."""
    a = F.lower(F.coalesce(address, F.lit("")))
    many = F.coalesce(units, F.lit(0)) >= 2
    shared = F.when(beds <= 10, F.greatest(F.lit(1), half_up(beds / units)))
    per = F.least(F.greatest(F.when(many, F.coalesce(shared, F.lit(2))).otherwise(F.coalesce(beds, F.lit(2))), F.lit(0)), F.lit(4)).cast("int")
    price = lambda place: F.element_at(F.array(*[F.lit(r) for r in rents[place]]), per + 1) * F.lit(float(UPLIFT.get(place, UPLIFT[None])))
    base = F.coalesce(*[F.when(a.contains(p), price(p)) for p in rents if p], price(None))
    return half_up(base * F.when(many, units).otherwise(1)).cast("bigint")


def below_market(price: Column, street: Column, comparable: Column, block: Column) -> tuple[Column, Column, Column]:
    """Percent below the street's average, its points, and a risk. Blocks aren't compared; 70 % and more is no bargain."""
    off = F.when(~block & (street > 0), (street - price) / street * 100)
    points = F.when(comparable & (off < 70), F.when(off > 20, 2.0).when(off > 10, 1.0)).otherwise(0.0)
    risk = F.when(off >= 70, "far below local prices").when(off < -10, "above market")
    return half_up(off).cast("bigint"), F.coalesce(points, F.lit(0.0)), risk


def yield_points(annual_rent: Column, price: Column, street: Column, block: Column) -> Column:
    """Points of a gross yield; unlikely yields and prices far below the street have none."""
    gross = half_up(annual_rent / price * 1000) / 10
    odd = block | (gross > 30) | ((street - price) / street * 100 >= 70)
    return F.when(odd, 0.0).when(gross > 8, 2.5).when(gross > 6, 1.5).otherwise(0.0)


def derived(rows: DataFrame) -> DataFrame:
    """``id, price, kind, place, refurb, loan, works, gdv`` from ``id, price, sort, state, address``."""
    state, address = F.lower(F.coalesce("state", F.lit(""))), F.coalesce("address", F.lit(""))
    pct = F.coalesce(*[F.when(state.rlike("|".join(names)), F.lit(p)) for names, p in WORKS])
    place = F.coalesce(*[F.when(address.rlike(p), F.lit(name)) for name, p in ELSEWHERE.items()], F.lit("England"))
    rows = rows.withColumns({"kind": F.coalesce(_looked_up(TYPES, F.lower("sort")), F.lit("residential")), "place": place, "refurb": pct.isNotNull(), "works": half_up(F.col("price") * pct).cast("bigint")})
    loan = half_up(F.col("price") * (_looked_up(LTV, F.col("kind")) / F.lit(100.0))).cast("bigint")
    gdv = F.when(F.col("refurb"), half_up(F.col("price") + F.col("works") + F.col("price") * UPLIFT_SHARE).cast("bigint")).otherwise(F.col("price"))
    return rows.select("id", "price", "kind", "place", "refurb", loan.alias("loan"), "works", gdv.alias("gdv"))


def verdict(rows: DataFrame, a: dict = RECKONED) -> DataFrame:
    """Adds ``profit, stressed, stacks``: sold at once, sold for less and later, and whether both leave enough."""
    base = F.col("price") + F.coalesce("works", F.lit(0)) * a["contingency"] + half_up(F.col("price") * a["tax"]) + a["fees"]
    cost, hard = (base + F.col("loan") * a["monthly"] * n for n in (MONTHS, a["stress_months"]))
    rows = rows.withColumns({"profit": F.col("gdv") * a["sells_for"] - cost, "stressed": F.col("gdv") * a["stress"] * a["sells_for"] - hard, "_cash": cost - F.col("loan")})
    return rows.withColumn("stacks", (F.col("profit") > 0) & (F.col("stressed") > 0) & (F.col("profit") / F.col("_cash") * 100 >= a["return_pct"])).drop("_cash")
