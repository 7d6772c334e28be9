"""Deal signals of a narrative: stated income, en-suites, labels, units, and the whole score.

All functions take columns over a lower-cased narrative and need no lookarounds, so that the
oracle can read the same patterns. Positions of matches come from the lengths of the pieces
between them, so a text is searched once for each pattern and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: What states an income, what a year has of its period, and the words that tell what it is.
INCOME = r"£\s?(\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?\s*\+?\s*(per\s+annum|per\s+year|per\s+calendar\s+month|per\s+month|per\s+week|p\.a\.?|pa|pcm|pw|pm)\b"
MONTHLY, WEEKLY = ("pcm", "pm", "per calendar month", "per month"), ("pw", "per week")
COST_BEFORE = r"ground\s+rent|service\s+charge|rateable|business\s+rates|rates\s+payable|outgoings|head\s+rent|insurance|deposit|maintenance|estate\s+charge|chief\s+rent"
COST_AFTER = r"^\s*(?:service\s+charge|ground\s+rent|rates\b|insurance|maintenance|payable\s+to)"
PASSING = r"produc|passing|current(?:ly)?\s+(?:let|producing|achiev|receiv)|let\s+(?:at|to)|income\s+of|receiv|fully\s+let|gross\s+income|rental\s+income|rent\s+of|rent\s+reserved|totall?ing"
POTENTIAL = r"potential|could\s+(?:achieve|produce|generate)|estimated|anticipat|expect|achievable|\berv\b|market\s+rent|when\s+(?:fully\s+)?let|if\s+(?:fully\s+)?let|projected|appraisal|would\s+(?:achieve|anticipate)|scope\s+(?:for|to)"
BEFORE, AFTER, LEAST_PA, MOST_PA = 70, 40, 1200, 2_000_000
#: Number words, and the patterns of each label.
WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
NUMBER = r"(\d{1,2}|" + "|".join(WORDS) + ")"
ENSUITE = rf"{NUMBER}\s*(?:x\s*)?en[\s-]?suites?"
#: A room's own number ("bedroom 3 en-suite") counts nothing and is cut first.
ROOM_LABEL = rf"(bedroom\s|\broom\s){NUMBER}(\s*(?:x\s*)?en[\s-]?suites?)"
ENSUITE_OF = rf"{NUMBER}\s+(?:out\s+)?of\s+(?:the\s+)?(?:\d{{1,2}}|\w+)\s+(?:bed)?rooms?[^.]{{0,30}}en[\s-]?suite"
ENSUITE_ALL = r"en[\s-]?suites?\s+to\s+(?:all|each|every)|(?:all|each|every)\s+(?:bed)?rooms?\s+(?:with|having|benefit\w*\s+from)\s+(?:an?\s+)?en[\s-]?suite"
HMO = r"\bhmo\b|house\s+(?:of|in)\s+multiple\s+occupa\w*|multiple\s+occupa\w*|house\s?share|bedsits?\b|room[\s-]by[\s-]room"
MULTI_LET = r"room\s+lets?|per\s+room|rooms?\s+(?:are\s+)?let\b|let\s+by\s+the\s+room|licen[cs]ed\s+(?:hmo|for\s+\d)|hmo\s+licen[cs]e|multi[\s-]?let|let\s+to\s+(?:working\s+professionals|students|sharers)|\bsharers\b"
HMO_PLANNING = r"sui\s+generis|article\s+4|\bc4\s+use|use\s+class\s+c4"
SHORT_LEASE = r"(\d{1,3})\s*(?:year|yr)s?\s*(?:lease\s+)?(?:unexpired|remaining|left)"
MIXED_USE = r"mixed[\s-]use"
SHOP_UPPERS = r"(?:\bshop\b|\bretail\s+unit\b|commercial\s+(?:unit|premises))[^.]{0,120}(?:flats?\s+(?:above|over)|upper\s+parts|uppers\b|maisonette\s+(?:above|over))|(?:flats?\s+(?:above|over)|upper\s+parts)[^.]{0,120}(?:\bshop\b|\bretail\b)"
CASH_ONLY = r"cash\s+(?:buyers?|purchasers?)\s+only|unmortgageable"
GRANTED = r"planning\s+(?:permission|consent|approval)[^.]{0,80}(?:granted|approved|obtained|secured)|(?:granted|approved)\s+planning\s+(?:permission|consent)"
NOT_GRANTED = r"\b(?:no|not|without|unless|until|subject\s+to)\b[^.]{0,40}planning\s+(?:permission|consent|approval)|planning\s+(?:permission|consent|approval)[^.]{0,60}\b(?:being|to\s+be|not\b|never|yet\s+to\s+be|refused|lapsed|expired)\b"
REGULATED = r"regulated\s+tenanc|protected\s+tenan|rent\s+act\b|fair\s+rent|statutory\s+tenan"
HOLIDAY = r"holiday\s+let|serviced\s+accommodation|short[\s-]term\s+let|airbnb"
PROBATE, RECEIVER = r"executor|probate|estate of|personal representative", r"receiver|receivership|administrator|liquidator|lpa receiver"
REPOSSESSED = r"repossess|mortgagees?\s+in\s+possession|by\s+order\s+of\s+the\s+mortgagees?|bank\s+sale"
PUBLIC = r"by\s+order\s+of\s+(?:the\s+)?(?:local\s+authority|council\b|housing\s+association|[\w\s]{0,30}(?:borough|city|county|district)\s+council)"
#: Units of a title.
UNITS = r"(\d{1,2})\s*(?:x\s*)?(?:self[- ]contained\s+)?(?:flats?|apartments?|units?)\b"
BLOCK_OF, TIMES_BEDS = r"block\s+of\s+(\d{1,2})\b", r"(\d{1,2})\s*x\s*(?:one|two|three|1|2|3)\s*[-\s]?bed"
FLATS, SOLD_SINGLY = r"flats|apartments|self[- ]contained|arranged as", r"individual flat sales|individual sales"
NEEDS_WORK, GOOD_ORDER, EMPTY, TENANTED, DEVELOPS, EXTENDS = T.NEEDS, T.GOOD, T.VACANT, T.LET, T.DEVELOP, T.EXTEND
#: What else is told.
LISTED, BY_ORDER, SQFT = r"grade ii|listed", r"by order of", r"([\d,]+)\s*sq\s*(?:ft|feet)"


def number(word: Column) -> Column:
    """A number in digits or as a word up to twelve; null for others."""
    words = F.nullif(F.array_position(F.array(*[F.lit(w) for w in WORDS]), word), F.lit(0))
    return F.coalesce(word.try_cast("int"), words.cast("int"))


def annual(amount: Column, period: Column) -> Column:
    p = F.replace(F.regexp_replace(period, r"\s+", " "), F.lit("."), F.lit(""))
    return F.replace(amount, F.lit(","), F.lit("")).cast("bigint") * F.when(p.isin(*MONTHLY), 12).when(p.isin(*WEEKLY), 52).otherwise(1)


def incomes(t: Column) -> Column:
    """``array<struct<annual, kind>>`` of the incomes a narrative states; costs and odd amounts are left out."""
    # a lambda evaluates what it names each time, so the matches are bound once, and so is each one's surroundings
    parts = {"gaps": F.split(t, INCOME, -1)} | {n: F.regexp_extract_all(t, F.lit(INCOME), i) for i, n in enumerate(("found", "amounts", "periods"))}
    size = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))

    def around(p: Column, m: Column, i: Column) -> Column:
        start = size(F.slice(p["gaps"], F.lit(1), i + 1)) + size(F.slice(p["found"], F.lit(1), i))
        low = F.greatest(start - BEFORE, F.lit(0))
        before = F.substring(t, low + 1, start - low)
        after = F.substring(t, start + F.length(m) + 1, F.lit(AFTER))
        return F.struct(before.alias("before"), after.alias("after"), F.concat(before, m, after).alias("window"), annual(p["amounts"][i], p["periods"][i]).alias("annual"))

    def one(x: Column) -> Column:
        window, a = x["window"], x["annual"]
        cost = x["before"].rlike(COST_BEFORE) | x["after"].rlike(COST_AFTER)
        kind = F.when(window.rlike(POTENTIAL), "potential").when(window.rlike(PASSING), "passing").otherwise("potential")
        return F.when(~cost & a.between(LEAST_PA, MOST_PA), F.struct(a.alias("annual"), kind.alias("kind")))

    seen = F.flatten(F.transform(F.array(F.struct(*(c.alias(n) for n, c in parts.items()))), lambda p: F.transform(p["found"], lambda m, i: around(p, m, i))))  # noqa: PLW0108
    return F.array_compact(F.transform(seen, one))


def stated_income(found: Column) -> Column:
    """``struct<annual, kind>`` of ``incomes``: the largest passing one, else the largest potential one, else null."""
    def most(kind: str) -> Column:
        return F.array_max(F.transform(F.filter(found, lambda x: x["kind"] == kind), lambda x: x["annual"]))

    return F.coalesce(*[F.when(most(k).isNotNull(), F.struct(most(k).alias("annual"), F.lit(k).alias("kind"))) for k in ("passing", "potential")])


def ensuites(t: Column, beds: Column) -> Column:
    """How many en-suite rooms a narrative tells of, no more than the beds where they are known."""
    known = F.coalesce(beds, F.lit(0)) > 0
    cut = F.regexp_replace(t, ROOM_LABEL, "$1$3")
    counted = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(cut, F.lit(ENSUITE), 1), number)), F.lit(0))
    n = F.greatest(counted, F.coalesce(number(F.regexp_extract(t, ENSUITE_OF, 1)), F.lit(0)))
    n = F.when(t.rlike(ENSUITE_ALL), F.greatest(n, F.when(known, beds).otherwise(2))).otherwise(n)
    n = F.when(n > 0, n).when(t.rlike(r"en[\s-]?suites\b"), 2).when(t.rlike(r"en[\s-]?suite\b"), 1).otherwise(0)
    return F.when(known, F.least(n, beds)).otherwise(n).cast("int")


def units(t: Column) -> Column:
    """Units of a block as told; 0 if the text names none, or an unlikely number."""
    most = lambda p: F.coalesce(F.regexp_extract(t, p, 1).try_cast("int"), F.lit(0))
    times = F.aggregate(F.regexp_extract_all(t, F.lit(TIMES_BEDS), 1), F.lit(0), lambda n, x: n + x.cast("int"))
    n = F.greatest(most(UNITS), most(BLOCK_OF), times)
    return F.when(n > 99, 0).otherwise(n)


def title_split(t: Column, n_units: Column) -> Column:
    return (n_units >= 2) | (t.contains("freehold") & t.rlike(FLATS)) | t.rlike(SOLD_SINGLY)


def labels(t: Column, beds: Column, kind: Column, tenure: Column, lease: Column, split: Column, income: Column, n_ensuites: Column) -> Column:
    """The labels of a deal in a fixed order; one listing may have several."""
    b = F.coalesce(beds, F.lit(0))
    hmo = t.rlike(HMO) | ((b >= 5) & (kind == "house") & ((n_ensuites >= 3) | t.rlike(MULTI_LET)))
    passing = F.coalesce(income["kind"] == "passing", F.lit(False))
    told = F.when(~F.coalesce(F.lower(tenure).contains("freehold"), F.lit(False)), F.regexp_extract(t, SHORT_LEASE, 1).try_cast("int"))
    years = F.coalesce(F.when(lease > 0, lease), told)
    found = {
        "hmo": hmo,
        "investment-valuation": hmo & ((b >= 6) | (n_ensuites >= 3) | passing | t.rlike(HMO_PLANNING)),
        "income-stated": income["annual"].isNotNull(),
        "title-split": split,
        "short-lease": years.between(1, 79),
        "mixed-use": t.rlike(MIXED_USE) | t.rlike(SHOP_UPPERS),
        "cash-buyers-only": t.rlike(CASH_ONLY),
        "planning-granted": t.rlike(GRANTED) & ~t.rlike(NOT_GRANTED),
        "regulated-tenancy": t.rlike(REGULATED),
        "holiday-let": t.rlike(HOLIDAY),
        "probate": t.rlike(PROBATE),
        "receivership": t.rlike(RECEIVER) & ~t.rlike(REPOSSESSED),
        "repossession": t.rlike(REPOSSESSED),
        "public-sector-disposal": t.rlike(PUBLIC),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), name) for name, when in found.items()]))


def signalled(rows: DataFrame) -> DataFrame:
    """Adds ``income, n_ensuites, units, split, labels`` to rows with ``t, beds, kind, tenure, lease``.

    ``t`` is the lower-cased narrative; each pattern runs once over it.
    """
    t = F.col("t")
    rows = rows.withColumn("_incomes", incomes(t))
    rows = rows.withColumns({"income": stated_income(F.col("_incomes")), "n_ensuites": ensuites(t, F.col("beds")), "units": units(t)})
    rows = rows.withColumn("split", title_split(t, F.col("units"))).drop("_incomes")
    return rows.withColumn("labels", labels(t, *[F.col(c) for c in ("beds", "kind", "tenure", "lease", "split", "income", "n_ensuites")]))


def scored(rows: DataFrame) -> DataFrame:
    """Adds ``state, empty, parts, points, opps, risks, deal_type`` to signalled rows with ``price``.

    ``parts`` is the breakdown, ``points`` its sum from 0 to 10; opportunities and risks are the
    names of what adds and what takes away.
    """
    t = F.col("t")
    f = {"state": F.when(t.rlike(T.POOR), "poor").when(t.rlike(NEEDS_WORK), "needs work").when(t.rlike(GOOD_ORDER), "good"), "empty": F.when(t.rlike(EMPTY), True).when(t.rlike(TENANTED), False)}
    f |= {"_executor": t.rlike(PROBATE), "_receiver": t.rlike(RECEIVER), "_develops": t.rlike(DEVELOPS), "_extends": t.rlike(EXTENDS)}
    f |= {"_sqft": F.nullif(F.replace(F.regexp_extract(t, SQFT, 1), F.lit(","), F.lit("")), F.lit("")).try_cast("double")}
    rows = rows.withColumns(f)
    c = F.col
    home = c("kind").isin("house", "flat")
    point = lambda when, name, pts: F.when(F.coalesce(when, F.lit(False)), F.struct((name if isinstance(name, Column) else F.lit(name)).alias("signal"), F.lit(float(pts)).alias("pts")))
    per_sqft = F.when(c("kind") != "land", c("price") / c("_sqft"))
    giy = F.when((c("income.kind") == "passing") & (c("units") <= 1), c("income.annual") / c("price") * 100)
    named = F.format_string("%.1f%% GIY", giy)
    many = F.concat(F.lit("Title split ("), F.greatest(c("units"), F.lit(2)).cast("string"), F.lit(" units)"))
    area = F.concat(F.lit("£"), F.floor(per_sqft + 0.5).cast("string"), F.lit("/sqft"))
    gains = [
        point(c("state") == "needs work", "Needs modernisation", 2),
        point(c("state") == "poor", "Poor condition", 2.5),
        point(c("_executor"), "Executor/probate", 1.5),
        point(c("_receiver"), "Receivership", 2),
        point(c("_develops") & (c("kind") != "land"), "Development potential", 2),
        point(c("_develops") & (c("kind") == "land"), "Development potential", 0.5),
        point(c("_extends"), "Extension/HMO potential", 1.5),
        point(c("empty") & home, "Vacant", 1),
        point((c("tenure") == "Freehold") & (c("kind") == "house"), "Freehold", 0.5),
        point(per_sqft < 200, area, 2),
        point((per_sqft >= 200) & (per_sqft < 300), area, 1),
        point(giy > 8, named, 2.5),
        point((giy > 6) & (giy <= 8), named, 1.5),
        point(t.rlike(r"(?:4|5|6)\s*week\s*completion|six week"), "Quick completion", 0.5),
        point(t.rlike(BY_ORDER) & ~c("_executor") & ~c("_receiver"), "Motivated seller", 0.5),
        point(c("split"), many, 1),
        point(F.array_contains("labels", "investment-valuation"), "Investment valuation candidate", 1),
    ]
    losses = [point(t.rlike(p), name, pts) for name, pts, p in T.SIGNALS if pts < 0]
    rows = rows.withColumns({"_gains": F.array_compact(F.array(*gains)), "_losses": F.array_compact(F.array(*losses))})
    hmo = F.array_contains("labels", "hmo")
    worn = F.coalesce(c("state").isin("needs work", "poor"), F.lit(False))
    extra = F.array_compact(F.array(F.when(t.rlike(LISTED), "Listed building"), F.when(c("price").isNull(), "Guide TBA")))
    deal = F.when(c("_develops"), "Development").when(hmo, "HMO").when(worn & c("_extends"), "Refurb+Extend").when(worn, "Refurb").when(c("split"), "Title Split").when(c("_executor") | c("_receiver"), "Motivated").otherwise("Standard")
    out = rows.withColumns({"parts": F.concat("_gains", "_losses"), "deal_type": deal})
    signals = lambda a: F.transform(a, lambda p: p["signal"])
    opps = F.concat(signals("_gains"), F.array_compact(F.array(F.when(hmo, "HMO"))))
    return out.withColumns({"points": T.score(c("parts")), "opps": opps, "risks": F.concat(signals("_losses"), extra)}).drop("_gains", "_losses", "_executor", "_receiver", "_develops", "_extends", "_sqft")
