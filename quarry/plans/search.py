"""A small query compiler: words of a search become a specification, a specification becomes columns.

The parser runs on the driver over one short string. What it gives is plain data, so a saved
search is JSON and a search is one filter and one order, whatever it holds. The relaxation ladder
is one plan: every row gets its tier, and the least tier that has rows is kept.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import REGIONS

#: Words of the grammar.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "studio": 0}
TYPES = {"house": "house", "houses": "house", "flat": "flat", "flats": "flat", "apartment": "flat", "land": "land", "plot": "land", "garage": "garage", "shop": "commercial", "commercial": "commercial"}
TENURES = {"freehold": "Freehold", "leasehold": "Leasehold"}
CONCEPTS = {
    "refurb": ("needs modernisation", "poor condition", "refurb", "modernis"),
    "motivated": ("executor", "probate", "receiver"),
    "income": ("tenanted", "let at", "income", "yield"),
    "development": ("development", "planning", "conversion"),
    "vacant": ("vacant",),
}
STOP = frozenset("a an and any around at below cheap for from in near of on or over properties property the to under up with less more than max min".split())
_AMOUNT = r"£?\s*([0-9][0-9,.]*)\s*(k|m|million)?"


@dataclass
class Spec:
    """What a search asks for. None and empty ask for nothing."""

    max_price: int | None = None
    min_price: int | None = None
    beds: int | None = None
    kinds: list[str] = field(default_factory=list)
    tenure: str | None = None
    regions: list[str] = field(default_factory=list)
    concepts: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v not in (None, [])}


def amount(number: str, unit: str | None) -> int:
    """Pounds: k, m, or a bare number under 1000 in thousands."""
    n = float(number.replace(",", "").rstrip("."))
    scale = {"k": 1e3, "m": 1e6, "million": 1e6}.get(unit or "", 1e3 if n < 1000 else 1)
    return int(n * scale + 0.5)


def parse(query: str) -> Spec:
    text, spec = f" {query.lower()} ", Spec()

    def take(pattern: str):
        nonlocal text
        m = re.search(pattern, text)
        if m:
            text = text[: m.start()] + " " + text[m.end() :]
        return m

    if m := take(rf"between\s+{_AMOUNT}\s+and\s+{_AMOUNT}"):
        spec.min_price, spec.max_price = sorted((amount(m[1], m[2] or m[4]), amount(m[3], m[4])))
    if m := take(rf"\b(?:under|below|max|up to|less than)\s+{_AMOUNT}"):
        spec.max_price = amount(m[1], m[2])
    if m := take(rf"\b(?:over|above|min|from|more than)\s+{_AMOUNT}"):
        spec.min_price = amount(m[1], m[2])
    if m := take(r"\b([0-9]{1,2}|one|two|three|four|five|six)\s*\+?[\s-]*bed(?:room)?s?\b"):
        spec.beds = NUMBERS.get(m[1]) or int(m[1])
    elif take(r"\bstudios?\b"):
        spec.beds = 0
    for region in sorted(REGIONS, key=len, reverse=True):
        if take(rf"\b{region}\b"):
            spec.regions.append(region)
    for word in re.findall(r"[a-z][a-z'-]*", text):
        concept = next((c for c, names in CONCEPTS.items() if word == c or (len(word) > 3 and any(n.startswith(word) for n in names))), None)
        if word in TYPES:
            spec.kinds.append(TYPES[word])
        elif word in TENURES:
            spec.tenure = TENURES[word]
        elif concept:
            spec.concepts.append(concept)
        elif word not in STOP:
            spec.words.append(word)
    spec.kinds, spec.concepts = (list(dict.fromkeys(x)) for x in (spec.kinds, spec.concepts))
    return spec


def conditions(spec: Spec, strict_price: bool = False) -> dict[str, Column]:
    """The predicate of each part over ``price, beds, kind, tenure, area, narrative``.

    Browsing passes null prices; alerts (``strict_price``) reject them.
    """
    out: dict[str, Column] = {}
    null = F.lit(False) if strict_price else F.col("price").isNull()
    if spec.max_price is not None:
        out["max_price"] = F.coalesce(F.col("price") <= spec.max_price, null) | null
    if spec.min_price is not None:
        out["min_price"] = F.coalesce(F.col("price") >= spec.min_price, null) | null
    if spec.beds is not None:
        out["beds"] = F.coalesce(F.col("beds") >= spec.beds, F.lit(False))
    if spec.kinds:
        out["kinds"] = F.coalesce(F.col("kind").isin(spec.kinds), F.lit(False))
    if spec.tenure:
        out["tenure"] = F.coalesce(F.col("tenure") == spec.tenure, F.lit(False))
    if spec.regions:
        out["regions"] = F.coalesce(F.col("area").isin(sorted({a for r in spec.regions for a in REGIONS[r]})), F.lit(False))
    text = F.lower(F.coalesce("narrative", F.lit("")))
    if spec.concepts:
        out["concepts"] = text.rlike("|".join(re.escape(n) for c in spec.concepts for n in CONCEPTS[c]))
    if spec.words:
        out["words"] = reduce(lambda a, b: a & b, (text.contains(w) for w in spec.words))
    return out


def browse(df: DataFrame, spec: Spec, strict_price: bool = False) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, conditions(spec, strict_price).values(), F.lit(True)))


def relaxed(df: DataFrame, spec: Spec) -> DataFrame:
    """Rows of the first tier that has any: all parts, then the place alone, then everything.

    The tiers are counted once as a one-row aggregate; there is no loop on the driver.
    """
    parts = conditions(spec)
    all_ = reduce(lambda a, b: a & b, parts.values(), F.lit(True))
    place = parts.get("regions", F.lit(False))
    rows = df.withColumn("tier", F.when(all_, 0).when(place, 1).otherwise(2))
    best = rows.agg(F.min("tier").alias("_best"))
    return rows.crossJoin(F.broadcast(best)).where("tier = _best").drop("_best")  # one row
