"""Strings of listings: urls, postcodes, prices, dates, and the signals of a narrative.

All are built from columns. Patterns avoid lookarounds where the oracle must read them too.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Areas of each region.
REGIONS = {
    "london": "E EC N NW SE SW W WC EN HA IG KT TW UB BR CR DA SM RM".split(),
    "south east": "BN CT GU ME MK OX PO RG RH SL SO TN HP".split(),
    "south west": "BA BH BS DT EX GL PL SN SP TA TQ TR".split(),
    "east": "AL CB CM CO IP LU NR PE SG SS WD".split(),
    "west midlands": "B CV DY HR ST TF WR WS WV".split(),
    "east midlands": "DE DN LE LN NG NN".split(),
    "north west": "BB BL CA CH CW FY L LA M OL PR SK WA WN".split(),
    "north east": "DH DL HG NE SR TS".split(),
    "yorkshire": "BD DN HD HG HU HX LS S WF YO".split(),
    "wales": "CF LD LL NP SA SY".split(),
    "scotland": "AB DD DG EH FK G HS IV KA KW KY ML PA PH TD ZE".split(),
}
POSTCODE = r"([A-Z]{1,2}[0-9][A-Z0-9]?)\s*([0-9][A-Z]{2})"


def normalise_url(url: Column) -> Column:
    """Trimmed, without fragment and trailing slashes, https, without www., lower case."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"/+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(u, r"(?i)^http://", "https://"), r"(?i)^https://www\.", "https://"))


def drop_params(url: Column, names: list[str]) -> Column:
    """Without the named query parameters."""
    cut = F.regexp_replace(url, rf"(?i)([?&])(?:{'|'.join(names)})=[^&#]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, r"&+", "&"), r"\?&", "?"), r"[?&]+(#|$)", "$1")


def postcode(text: Column) -> Column:
    """The first postcode, ``OUT IN``, or null."""
    up = F.upper(text)
    return F.nullif(F.trim(F.concat_ws(" ", F.regexp_extract(up, rf"\b{POSTCODE}\b", 1), F.regexp_extract(up, rf"\b{POSTCODE}\b", 2))), F.lit(""))


def district(text: Column) -> Column:
    """The outward code of a whole postcode, or an empty string."""
    return F.regexp_extract(F.upper(F.trim(text)), rf"^{POSTCODE}$", 1)


def area(code: Column) -> Column:
    """The letters of a postcode before its first digit; a letter alone is no area."""
    return F.regexp_extract(F.upper(code), r"^([A-Z]{1,2})[0-9]", 1)


def in_region(code: Column, region: str) -> Column:
    return area(code).isin(REGIONS[region])


def property_key(code: Column, address: Column) -> Column:
    return F.concat(F.lower(F.coalesce(code, F.lit(""))), F.lit("|"), F.lower(F.trim(F.split_part(F.coalesce(address, F.lit("")), F.lit(","), F.lit(1)))))


def price(text: Column) -> Column:
    """Pounds of a price text: the first number, with k or m; null if none."""
    number = F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*([kKmM]?)", 1)
    unit = F.lower(F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*([kKmM]?)", 2))
    scale = F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).otherwise(1)
    return F.floor(F.nullif(F.replace(number, F.lit(","), F.lit("")), F.lit("")).cast("double") * scale + 0.5)


def price_status(status: Column, text: Column, amount: Column) -> Column:
    """The status of a price, in order of precedence; its patterns are fixed values."""
    s, t, none = F.lower(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(text, F.lit(""))), ~(F.coalesce(amount, F.lit(0)) > 0)
    return (
        F.when(s.isin("sold", "unsold"), "sold")
        .when(s == "withdrawn", "withdrawn")
        .when(none & t.rlike(r"\b(nil|no|without|zero)[\s-]*reserve|unreserved\b"), "nil_reserve")
        .when(none & t.rlike(r"poa|on application"), "poa")
        .when(none & t.rlike(r"tba|tbc|to be advised|to be confirmed"), "tba")
        .when(t.rlike(r"starting\s*bid|opening\s*bid|minimum\s*opening"), "starting_bid")
        .when(~none, "guide")
        .otherwise("unknown")
    )


def uk_date(text: Column) -> Column:
    """A date written 19 February 2026, 19/02/2026 or 2026-02-19; ordinals are allowed."""
    t = F.regexp_replace(F.trim(text), r"(?i)\b([0-9]{1,2})(st|nd|rd|th)\b", "$1")
    words = F.concat_ws(" ", F.regexp_extract(t, r"([0-9]{1,2})\s+([A-Za-z]{3})[a-z]*\s+([0-9]{4})", 1), F.initcap(F.regexp_extract(t, r"([0-9]{1,2})\s+([A-Za-z]{3})[a-z]*\s+([0-9]{4})", 2)), F.regexp_extract(t, r"([0-9]{1,2})\s+([A-Za-z]{3})[a-z]*\s+([0-9]{4})", 3))
    return F.coalesce(F.try_to_date(words, "d MMM yyyy"), F.try_to_date(F.regexp_extract(t, r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", 1), "d/M/yyyy"), F.try_to_date(F.regexp_extract(t, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd"))


def real_date(day: Column) -> Column:
    """Null for the sentinel of always-on sales."""
    return F.when(day <= F.lit("2098-01-01").cast("date"), day)


def strip_html(page: Column) -> Column:
    """Tags, scripts, styles and comments out; common references decoded; white space single."""
    t = F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


#: Signal, points, pattern over the lower-cased narrative.
SIGNALS = [
    ("Executor/probate", 1.5, r"executor|probate|estate of|personal representative"),
    ("Receivership", 2.0, r"receiver|receivership|administrator|liquidator|lpa receiver"),
    ("Extension/HMO potential", 1.5, r"extension potential|scope to extend|subject to requi[st]i?te? consents|loft conversion|\bhmo\b|potential to extend"),
    ("Quick completion", 0.5, r"(4|5|6)\s*week\s*completion|six week"),
    ("Sitting tenant", -2.0, r"sitting tenant"),
    ("Knotweed", -2.0, r"knotweed"),
    ("Flying freehold", -1.0, r"flying freehold"),
    ("Non-std construction", -1.0, r"non[- ]?standard|timber frame|prefab|prc"),
    ("Subsidence", -1.5, r"subsidence|structural movement|underpinn"),
    ("Cladding/EWS1", -1.0, r"\bews1\b|unsafe cladding|combustible cladding|cladding (issue|defect|remediation|works)"),
    ("Flood risk", -1.0, r"flood risk|flood zone"),
    ("Contamination", -1.0, r"asbestos|contamination"),
]
#: States of repair, works, tenancy and kinds.
POOR = r"derelict|dilapidated|fire damage|structurally unsound|uninhabitable|condemned"
NEEDS = r"modernis|refurbishment|renovation|updating|in need of|improvement|for improve|requires? (?:updating|work|repair)|(?:tired|dated|worn) (?:condition|decor|throughout)|cosmetic work|stripping out|(?:complete|full|extensive) refurb|fixer.upper|requires attention"
GOOD = r"good order|good decorative|well maintained|recently refurbished|well presented|good condition|excellent condition|ready to let|move.in|turnkey"
DEVELOP = r"development potential|development opportunity|planning permission|pp granted|change of use|conversion potential|redevelopment|building plot"
EXTEND = r"extension potential|scope to extend|subject to requi[st]i?te? consents|loft conversion|\bhmo\b|potential to extend"
VACANT = r"vacant possession|\bvp\b|vacant property|\bvacant\b|with vacant|sold with vacant"
LET = r"tenant|let to|tenanted|occupied|sitting tenant|subject to tenancy|assured shorthold"
HOUSE, FLAT, LAND = r"semi[- ]?detached|terraced?|detached house|bungalow|cottage|\bhouse\b", r"\bflats?\b|\bapartments?\b|\bmaisonette\b", r"\bland\b|\bplot\b|\bsite\b"


def found(t: Column, pattern: str) -> Column:
    """``t.rlike(pattern)``, but plain alternatives are substring searches, and others run behind one for a part they need."""
    parts = [""]
    depth = 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    tests = []
    for p in parts:
        plain = re.sub(r"\([^)]*\)\??|\[[^]]*\][?*+]?|\\.[?*+]?|.[?*]", "\0", p)
        need = max(re.findall(r"[a-z0-9 ]+", plain), key=len, default="")
        tests.append(t.contains(p) if need == p else t.contains(need) & t.rlike(p) if need else t.rlike(p))
    return reduce(lambda a, b: a | b, tests)


def flags(t: Column) -> dict[str, Column]:
    """What each pattern finds in a lower-cased narrative; select these before deriving from them, so each runs once."""
    named = {"poor": POOR, "needs": NEEDS, "good": GOOD, "develops": DEVELOP, "is_vacant": VACANT, "is_let": LET, "house": HOUSE, "flat": FLAT, "land": LAND}
    out = {k: found(t, p) for k, p in named.items()}
    out |= {"freehold": t.contains("freehold"), "leasehold": t.contains("leasehold")}
    return out | {f"signal_{i}": found(t, p) for i, (_, _, p) in enumerate(SIGNALS)}


def condition_of(f: dict[str, Column]) -> Column:
    return F.when(f["poor"], "poor").when(f["needs"], "needs work").when(f["good"], "good")


def kind_of(f: dict[str, Column]) -> Column:
    return F.when(f["house"], "house").when(f["flat"], "flat").when(f["land"], "land").otherwise("other")


def vacancy_of(f: dict[str, Column]) -> Column:
    """True, false, or null if the text doesn't say."""
    return F.when(f["is_vacant"], True).when(f["is_let"], False)


def condition(t: Column) -> Column:
    return condition_of(flags(t))


def kind(t: Column) -> Column:
    return kind_of(flags(t))


def vacancy(t: Column) -> Column:
    return vacancy_of(flags(t))


def breakdown_of(f: dict[str, Column]) -> Column:
    """``array<struct<signal, pts>>`` of a narrative, in a fixed order."""
    point = lambda when, signal, pts: F.when(when, F.struct(F.lit(signal).alias("signal"), F.lit(float(pts)).alias("pts")))
    state, sort = condition_of(f), kind_of(f)
    found = [
        point(state == "needs work", "Needs modernisation", 2),
        point(state == "poor", "Poor condition", 2.5),
        point(f["develops"] & (sort != "land"), "Development potential", 2),
        point(f["develops"] & (sort == "land"), "Development potential", 0.5),
        point(vacancy_of(f) & sort.isin("house", "flat"), "Vacant", 1),
        point(f["freehold"] & ~f["leasehold"] & (sort == "house"), "Freehold", 0.5),
        *[point(f[f"signal_{i}"], s, n) for i, (s, n, _) in enumerate(SIGNALS)],
    ]
    return F.array_compact(F.array(*found))


def breakdown(text: Column) -> Column:
    return breakdown_of(flags(F.lower(F.coalesce(text, F.lit("")))))


def score(parts: Column) -> Column:
    """The points together, from 0 to 10, to one decimal."""
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["pts"])
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.floor(total * 10 + 0.5) / 10))


#: References decoded and kinds of property as told by others.
REFERENCES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&#x2F;": "/", "&nbsp;": " "}
KIND_CODES = {"d": "house", "s": "house", "t": "house", "f": "flat", "o": "other"}
KIND_NAMES = {"detached": "house", "semi-detached": "house", "terraced": "house", "bungalow": "house", "flat/maisonette": "flat", "apartment": "flat", "maisonette": "flat", "studio": "flat"}
TENURE_NAMES = {"f": "Freehold", "freehold": "Freehold", "l": "Leasehold", "leasehold": "Leasehold", "long leasehold": "Leasehold", "share of freehold": "Share of Freehold"}


def decoded(text: Column) -> Column:
    """Character references of the table as characters, ampersands first, as pages that were escaped twice need."""
    for ref, char in REFERENCES.items():
        text = F.replace(text, F.lit(ref), F.lit(char))
    return text


def titled(text: Column) -> Column:
    """Each word with a capital, the rest lower case; hyphens and apostrophes begin a word too."""
    return F.regexp_replace(F.initcap(F.regexp_replace(F.regexp_replace(text, "-", "- "), "'", "' ")), "([-']) ", "$1")


def canonical(value: Column, *tables: dict[str, str]) -> Column:
    """A value by the first table that has it, else itself; blank is null."""
    v = F.lower(F.trim(value))
    return F.when(v != "", F.coalesce(*[F.when(v == k, F.lit(x)) for t in tables for k, x in t.items()], v))


def street(address: Column) -> Column:
    """The first part of an address without flat, number and marks, lower case."""
    first = F.lower(F.trim(F.split_part(F.coalesce(address, F.lit("")), F.lit(","), F.lit(1))))
    bare = F.regexp_replace(first, r"^(?:flat|unit|apartment)\s+\w+\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"^[0-9]+[a-z]?(?:\s*-\s*[0-9]+[a-z]?)?\s+", ""), r"[^a-z0-9 ]", ""))


def address_key(address: Column, code: Column) -> Column:
    """Letters and digits of an address with its postcode: equal for two spellings of a place."""
    return F.concat(F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), r"[^a-z0-9]", ""), F.lit("|"), F.regexp_replace(F.lower(F.coalesce(code, F.lit(""))), r"\s", ""))


def shortened(address: Column, parts: int = 2) -> Column:
    """The first parts of an address, each trimmed, and an ellipsis where some were left out."""
    p = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.concat(F.array_join(F.slice(p, 1, parts), ", "), F.when(F.size(p) > parts, F.lit(", …")).otherwise(""))


def search_text(fields: list[Column], most: int = 4000) -> Column:
    """Fields that have something, in order, as sentences; cut at ``most`` characters, as the index needs."""
    return F.left(F.concat_ws(". ", *[F.nullif(F.trim(f), F.lit("")) for f in fields]), F.lit(most))


def money(pounds: Column) -> Column:
    """£1,234,567, with a minus before the sign of the pound; null stays null."""
    return F.concat(F.when(pounds < 0, "-").otherwise(""), F.lit("£"), F.format_number(F.abs(pounds), 0))
