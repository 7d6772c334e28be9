"""Listing cards of a results page: links to a listing's number, and what the block around each says.

The page is read once. Open elements are a stack, each with the place in the page's text where it
began; closing one gives its text as a range. A card is the smallest element around a link, at most
``HOPS`` levels up, whose text names a price, unless the text has grown so much on the way that it
must be the cards' frame. Broken markup is taken as it stands: a stray ``<`` is text, an end tag
closes the innermost element of its name or nothing, what stays open ends with the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

# What a link, a price, a rent and its period look like, and how far a card reaches.
LINK = re.compile(r"/(\d{5,9})(?:[/\-]|$)")
PRICE = re.compile(r"£\s*[\d,]+")
RENT = re.compile(r"£\s*([\d,]+)\s*(?:to|-)?\s*(?:£\s*[\d,]+)?", re.I)
MONTHLY, WEEKLY = re.compile(r"\bpcm\b|per\s*month"), re.compile(r"\bpw\b")
BEDS = re.compile(r"(\d+)\s*(?:bed|bedroom)\b", re.I)
KINDS = (("studio", r"\bstudio\b"), ("room", r"\bhouse\s*share\b|\broom\b"), ("house", r"\bhouse\b"), ("bungalow", r"\bbungalow\b"), ("flat", r"\bflat\b|\bapartment\b"))
HOPS, LONGEST, FRAME, GROWTH, WINDOW, CARDS = 6, 600, 150, 3, 60, 60

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b big cite code em font i label mark q s small span strong sub sup u".split())
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")


class _Page:
    """The text of a page, its elements as (parent, start, end) in it, and its links as (href, element)."""

    def __init__(self, page: str):
        self.parent: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.links: list[tuple[str, int]] = []
        parts, size, stack, open_ = [], 0, [], {}
        skip = ""
        for i, piece in enumerate(re.sub(r"<!--.*?(?:-->|\Z)", "", page, flags=re.S).split("<")):
            tag, gap, text = piece.partition(">") if i else ("", "", piece)
            named = _NAME.match(tag) if gap else None
            name = named[0].lower() if named else ""
            if skip and name != f"/{skip}":
                continue
            skip = ""
            if i and not named and not (gap and tag[:1] in "!?"):
                text = "<" + piece
            elif name.startswith("/") and open_.get(name[1:]):
                at = open_[name[1:]].pop()
                while stack and stack[-1][1] >= at:
                    other, e = stack.pop()
                    self.end[e] = size
                    if e != at:
                        open_[other].pop()
            elif name and not name.startswith("/"):
                if name in ("script", "style"):
                    skip = name
                    continue
                if name not in _VOID:
                    e = len(self.parent)
                    self.parent.append(stack[-1][1] if stack else -1)
                    self.start.append(size)
                    self.end.append(-1)
                    stack.append((name, e))
                    open_.setdefault(name, []).append(e)
                    if name == "a" and (href := _HREF.search(tag)):
                        self.links.append((html.unescape(href[1] or href[2] or href[3] or ""), e))
            text = html.unescape(text)
            if name and name.lstrip("/") not in _INLINE:
                text = " " + text
            parts.append(text)
            size += len(text)
        self.text = "".join(parts)
        self.end = [size if e < 0 else e for e in self.end]
        runs = [m.span() for m in re.finditer(r"\S+", self.text)]
        self.first, self.last = [a for a, _ in runs], [b for _, b in runs]

    def trimmed(self, e: int) -> tuple[int, int]:
        """An element's text without the white space around it, as a range."""
        start, end = self.start[e], self.end[e]
        i = bisect_right(self.last, start)
        a = max(start, self.first[i]) if i < len(self.first) else end
        j = bisect_left(self.first, end) - 1
        b = min(end, self.last[j]) if j >= 0 else start
        return (a, b) if a < b else (start, start)


def rent(text: str) -> int | None:
    """The least monthly rent in a text; weekly ones are 52 twelfths; an amount without a period is none."""
    low = []
    for m in RENT.finditer(text):
        amount, near = int(m[1].replace(",", "") or 0), text[m.start() : m.start() + WINDOW].lower()
        if amount > 0 and MONTHLY.search(near):
            low.append(amount)
        elif amount > 0 and WEEKLY.search(near):
            low.append(int(amount * 52 / 12 + 0.5))
    return min(low, default=None)


def beds(text: str) -> int | None:
    if re.search(r"\bstudio\b", text, re.I):
        return 0
    found = BEDS.search(text)
    return int(found[1]) if found and len(found[1]) < 3 and 0 < int(found[1]) < 30 else None


def cards(page: str | None) -> Iterator[tuple[int, int, int | None, str | None]]:
    """``listing, rent, beds, kind`` of a page's cards in order, each number once, ``CARDS`` of them at most."""
    p, seen = _Page(page or ""), set()
    for href, link in p.links:
        number = LINK.search(href)
        if not number or number[1] in seen:
            continue
        e, before = link, 0
        for hop in range(HOPS):
            a, b = p.trimmed(e) if e >= 0 else (0, LONGEST + 1)
            if b - a > LONGEST or (hop and b - a > FRAME and b - a > GROWTH * before):
                break
            text, before = p.text[a:b], b - a
            if PRICE.search(text):
                if amount := rent(text):
                    seen.add(number[1])
                    kind = next((k for k, pattern in KINDS if re.search(pattern, text.lower())), None)
                    yield int(number[1]), amount, beds(text), kind
                break
            e = p.parent[e]
        if len(seen) == CARDS:
            return
