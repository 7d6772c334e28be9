"""Recognisers of catalogue pages as data: page text (Markdown) to lots, one rule for each house.

A rule names the links that are a lot's, where its card is (the link's own text, or what follows the
link up to the next lot's), and for each field the patterns that are tried on the card's lines in
turn. The page's links are found in one pass with a stack of brackets, so nested image links and
stray brackets cost nothing; a lot's later links repeat its first. A card without a field that the rule
needs is no lot. So a house that changes its page is a change of data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

LOT = "lot_id string, lot_number bigint, address string, price bigint, kind string, beds bigint, tenure string, image string, state string"


@dataclass(frozen=True)
class Rule:
    """``link`` gives the lot's id as its first group. A field's pattern gives its first group, or all it matched."""

    link: str
    inside: bool
    fields: dict[str, tuple[str, ...]]
    #: Lines that can't be the address.
    not_address: str = r"(?!)"
    #: Lines that the kind is read from; the whole card without.
    kind_lines: str = ""
    kinds: tuple[tuple[str, str], ...] = ()
    states: tuple[tuple[str, str], ...] = ()
    #: A lot with a price is available whatever its badges say.
    priced_is_available: bool = False
    #: An id's own words are the address where the card has none.
    slug_address: bool = False
    image: str = r"!\[[^\]\n]{0,300}\]\((https?://[^)\s]+)\)"
    image_before: bool = False
    needs: tuple[str, ...] = ("address",)


_HOUSE_KINDS = (("flat", r"\b(?:flat|apartment|maisonette|studio)"), ("bungalow", r"\bbungalow"), ("house", r"\b(?:house|terrace|semi|detached)"), ("land", r"\b(?:land|plot|site)\b"), ("commercial", r"\b(?:commercial|office|retail|industrial|warehouse)"))
_POSTCODE = r"[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}"

# Links, marks and words of the houses' pages.
RULES = {
    "pattinson": Rule(
        r"https://(?:www\.)?pattinson\.co\.uk/property/(\d+)$",
        True,
        {"address": (rf"(?i)^(?=.*{_POSTCODE})(?=.*,).{{5,}}$",), "price": (r"^£([\d,]+)$", r"£([\d,]+)"), "beds": (r"(?i)^(\d+)\s*bed",)},
        kind_lines=r"(?i)^\d+\s*bed",
        kinds=_HOUSE_KINDS,
        states=(("withdrawn", r"\bwithdrawn\b"), ("unsold", r"\bunsold\b|\bnot\s*sold\b"), ("sold", r"\bsold\b")),
        image=r"!\[[^\]\n]{0,300}\]\((https://[^)\s]*property-images/\d+/[^)\s]+)\)",
    ),
    "bondwolfe": Rule(
        r"https?://(?:www\.)?bondwolfe\.com/auctions/properties/(\d+)-[^)]*$",
        True,
        {"address": (r"^#{2,6}\s+(.{5,})$",), "price": (r"£\s*([\d,]+)",), "beds": (r"(?i)(\d+)\s*bed",)},
        not_address=r"(?i)£|guide price",
        kinds=(("commercial", r"commercial|retail|office|industrial|mixed use"), ("residential", r"residential|bedroom|flat|house|bungalow|terrace|maisonette|\bland\b|\bplot\b")),
        states=(("withdrawn", r"\bwithdrawn\b|\bpostponed\b"), ("unsold", r"\bunsold\b|\bnot\s*sold\b|\bpassed\b"), ("sold", r"\bsold\b")),
        priced_is_available=True,
    ),
    "mchugh": Rule(
        r"https://(?:www\.)?mchughandco\.com/lot/details/(\d+)$",
        False,
        {"lot_number": (r"(?i)^###\s*Lot\s*(\d+)",), "address": (r"^####\s*(.{6,})$",), "price": (r"(?i)Guide Price\*?\s*\*\*\s*£([\d,]+)",), "tenure": (r"(?i)\b(freehold|leasehold)\b",)},
        kind_lines=r"(?i)^(?!#|\[|!|\*|guide).*",
        kinds=_HOUSE_KINDS,
        states=(("sold", r"\bsold\b"), ("withdrawn", r"\bwithdrawn\b"), ("postponed", r"\bpostponed\b")),
        image=r"!\[\]\((https://cdn\.eigpropertyauctions\.co\.uk/[^\s)]+)\)",
        image_before=True,
    ),
    "nesbits": Rule(
        r"(?:https?://(?:www\.)?nesbits\.co\.uk)?/property/([a-z0-9-]+-[a-z]{1,2}\d[a-z\d]?-\d[a-z]{2}/\d+)/?$",
        True,
        {},
        slug_address=True,
    ),
}


def links(text: str) -> Iterator[tuple[int, int, str, int]]:
    """Begin and end of each link's own text, its address, and where the link ends; inner links come first."""
    open_: list[int] = []
    for m in re.finditer(r"\[|\](?:\(([^()\s]{1,2000})\))?", text):
        if m[0] == "[":
            open_.append(m.end())
        elif open_:
            start = open_.pop()
            if m[1]:
                yield start, m.start(), m[1], m.end()
        elif m[1]:  # the page begins within a link
            yield 0, m.start(), m[1], m.end()


def _lines(card: str) -> list[str]:
    plain = re.sub(r"\\(.)", r"\1", card)
    return [s for line in plain.split("\n") if (s := " ".join(line.split()).replace(" ,", ","))]


def _first(patterns: tuple[str, ...], lines: list[str], barred: str = r"(?!)") -> str | None:
    for p in patterns:
        for line in lines:
            if (m := re.search(p, line)) and not re.search(barred, line):
                return (m[1] if m.re.groups else m[0]).strip()
    return None


def _number(value: str | None) -> int | None:
    digits = (value or "").replace(",", "")
    return int(digits) if digits.isdigit() and len(digits) < 16 else None


def lots(house: str | None, text: str | None) -> Iterator[tuple]:
    """The lots of a page in the columns of ``LOT``; a house without a rule and a page without cards have none."""
    rule = RULES.get(house or "")
    if rule is None or not text:
        return
    found = [(a, b, m[1], end) for a, b, url, end in links(text) if (m := re.match(rule.link, url))]
    seen: set[str] = set()
    for k, (start, stop, lot, end) in enumerate(found):
        if lot in seen:
            continue
        # after a link: up to the end of the next lot's own text
        card = text[start:stop] if rule.inside else text[end : found[k + 1][1] if k + 1 < len(found) else len(text)]
        lines = _lines(card)
        value = {f: _first(p, lines, rule.not_address if f == "address" else r"(?!)") for f, p in rule.fields.items()}
        if rule.slug_address:
            words = lot.split("/")[0].split("-")
            value["address"] = " ".join(w.capitalize() for w in words[:-2]) + ", " + " ".join(words[-2:]).upper()
        if any(not value.get(f) for f in rule.needs):
            continue
        seen.add(lot)
        of = "\n".join(x for x in lines if re.search(rule.kind_lines, x)).lower()
        low = "\n".join(lines).lower()
        kind = next((k for k, p in rule.kinds if re.search(p, of)), None)
        price = _number(value.get("price"))
        state = "available" if rule.priced_is_available and price is not None else next((s for s, p in rule.states if re.search(p, low)), "available")
        around = text[found[k - 1][3] if k else 0 : end] if rule.image_before else card
        image = re.search(rule.image, around)
        tenure = value.get("tenure")
        yield lot, _number(value.get("lot_number")), value["address"], price, kind, _number(value.get("beds")), tenure.lower() if tenure else None, image[1] if image else None, state
