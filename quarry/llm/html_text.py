"""Main text of web pages: a bidirectional LSTM labels every leaf block of a page.

A page is cut into leaf blocks, the runs of text between block-level tags; only scripts, styles,
templates and comments are left out. A block's vector holds
its tag path (tags, and words of class, id and role, hashed), its words (hashed counts) and a few
shares. The LSTM reads a page's blocks in both directions, so each label depends on the whole page;
blocks labelled as content are joined in page order.

The labeller is trained here: on pages made by a seeded template generator that covers menus,
headers, footers, sidebars, notices, adverts, forms and comments, and on at most ``sample`` pages
of the table (of least hash) whose own sectioning tags name the article. The weights have a fixed
size; extraction is a map over the pages.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, least_hashed, record, sliced, table

PATHS, WORDS, SHARES, HIDDEN = 96, 32, 6, 20
WIDTH = PATHS + WORDS + SHARES
#: Blocks of the pages that are labelled at once.
BATCH = 4096

_NAME_END = re.compile(r"[\s/>]")
#: Rest of a tag: what isn't quoted, and quoted values, up to its end; quantifiers don't give back.
_TAG_REST = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in ("script", "style", "template")}
#: Numbers beyond any character, which Python may refuse to read.
_HUGE = re.compile(r"&#(?:0*+[1-9]\d{7,}|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,});?")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
#: Formulas and drawings stand within a sentence; none of their tags has to be closed.
INLINE |= frozenset("math semantics annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split())
INLINE |= frozenset("svg animate circle clippath defs desc ellipse filter foreignobject g image line lineargradient marker mask path pattern polygon polyline radialgradient rect stop symbol text textpath tspan use view".split())
#: Where a tag begins that is never closed.
_BROKEN = re.compile(r"<[a-zA-Z/!?]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = frozenset("ul ol menu dl table select".split())


class Path(Sequence):
    """Tags and names of all open elements, from the outermost; it shares those of the element around it."""

    __slots__ = ("around", "own", "slots")

    def __init__(self, around: Path | None, own: tuple[str, ...]):
        self.around, self.own = around, own
        #: A bit for each of ``PATHS`` features that a name hashes to, also those of the paths around.
        self.slots = 0 if around is None else around.slots
        for w in own:
            h = zlib.crc32(w.encode())
            self.slots |= 1 << h % PATHS | 1 << (h >> 12) % PATHS

    def names(self) -> tuple[str, ...]:
        parts, at = [], self
        while at is not None:
            parts.append(at.own)
            at = at.around
        return tuple(w for own in reversed(parts) for w in own)

    def __len__(self) -> int:
        return len(self.names())

    def __getitem__(self, i):
        return self.names()[i]

    def __iter__(self):
        return iter(self.names())


ROOT = Path(None, ())


@dataclass
class Block:
    path: Path
    text: str
    linked: float  # share of its characters in links


class _TagEnds:
    """Where a tag ends that goes on at some place, quoted values passed over; None if the page ends first.

    The first place that has no end makes a table of all quotes and ends of the page, read from its end
    to its beginning once; so many tags with an odd quote cost no more than one.
    """

    def __init__(self, page: str):
        self.page, self.table = page, None

    def __call__(self, at: int) -> int | None:
        if self.table is None:
            if m := _TAG_REST.match(self.page, at):
                return m.end()
            self.table = self._made()
        places, ends = self.table
        i = bisect.bisect_left(places, at)
        return ends[i] if i < len(places) else None

    def _made(self) -> tuple[list[int], list[int | None]]:
        places = [m.start() for m in re.finditer(r"[>\"']", self.page)]
        ends: list[int | None] = [None] * (len(places) + 1)
        later: dict[str, int] = {}
        for i in range(len(places) - 1, -1, -1):
            c = self.page[places[i]]
            if c == ">":
                ends[i] = places[i] + 1
            else:
                ends[i] = ends[later[c] + 1] if c in later else None
                later[c] = i
        return places, ends[:-1]


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``start, end, kind, tag, attributes`` of the markup in order, in time linear in the page's length.

    Kinds: ``open``, ``close``, ``raw`` (an element whose content is no text, with its content) and
    ``skip`` (comments and declarations). As in the HTML standard a comment or raw element without
    an end takes what is left of the page. A ``<`` that no tag's end follows is text.
    """
    ends, last = _TagEnds(page), page.rfind(">")
    at, delimiter = 0, -1
    while (i := page.find("<", at)) >= 0:
        at = i + 1
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = len(page) if end < 0 else end + 3
            yield i, at, "skip", "", ""
        elif i >= last:
            continue
        elif page[i + 1] in "!?":
            at = page.find(">", i + 2) + 1 or i + 1
            if at > i + 1:
                yield i, at, "skip", "", ""
        else:
            name = i + 1 + (page[i + 1] == "/")
            if not ("a" <= page[name].lower() <= "z"):
                continue
            if delimiter <= name:  # the first one after an earlier name may be the next one still
                delimiter = _NAME_END.search(page, name).start()
            stop = delimiter
            end = ends(stop)
            if end is None:  # a name with a quote may be a name and a quoted value
                end = ends(name)
                if end is None:
                    continue
                stop = re.compile("[\"']").search(page, name).start()
            tag, rest = page[name:stop].lower(), page[stop : end - 1]
            at = end
            if name > i + 1:
                yield i, at, "close", tag, rest
            elif tag in _RAW_END:
                closed = _RAW_END[tag].search(page, end)
                at = closed.end() if closed else len(page)
                yield i, at, "raw", tag, rest
            else:
                yield i, at, "open", tag, rest


class _Stack:
    """Open elements; closing one finds it by its tag, however deep the others are nested."""

    def __init__(self):
        self.open: list[tuple[str, Path]] = []
        self.places: dict[str, list[int]] = {}
        self.lists: list[int] = []

    def push(self, tag: str, own: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in LISTS:
            self.lists.append(len(self.open))
        self.open.append((tag, Path(self.path, own)))

    def close(self, tag: str, within_list: bool = False) -> None:
        """Close the innermost element of that tag, and all in it; ``within_list``: not beyond the innermost list."""
        found = self.places.get(tag)
        if not found or (within_list and self.lists and self.lists[-1] > found[-1]):
            return
        for other, _ in self.open[found[-1] :]:
            self.places[other].pop()
            if other in LISTS:
                self.lists.pop()
            self.open.pop()

    @property
    def path(self) -> Path:
        return self.open[-1][1] if self.open else ROOT


def plain(raw: str) -> str:
    """Character references decoded, white space made single; numbers beyond any character are U+FFFD."""
    return " ".join(html.unescape(_HUGE.sub("\ufffd", raw)).split())


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, their text decoded and its white space made single.

    What follows a tag that the page's end cuts off is no text, as in the HTML standard.
    """
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = 0
    at = links = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if links:
                linked += len(raw)

    def flush() -> None:
        nonlocal linked
        if parts:
            whole = "".join(parts)
            if s := plain(whole):
                out.append(Block(stack.path, s, min(1.0, linked / len(whole))))
            parts.clear()
        linked = 0

    for start, end, kind, tag, attributes in tokens(page):
        text(page[at:start])
        at = end
        if kind in ("skip", "raw"):
            if kind == "raw":
                text(" ")
        elif kind == "close":
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                flush()
                stack.close(tag)
        elif tag in INLINE:
            links += tag == "a"
        elif tag == "hr" or tag not in VOID:
            flush()
            if tag in VOID:
                continue
            if tag in ENDS_P:
                stack.close("p", True)
            for other in SIBLINGS.get(tag, ()):
                stack.close(other, True)
            names = [w.lower() for n in _NAMED.finditer(attributes) for w in _PART.findall(n[1] or n[2] or n[3] or "")]
            stack.push(tag, (tag, *(f".{w}" for w in names)))
            links = 0
        else:
            text(" ")
    if at < len(page):
        cut = _BROKEN.search(page, at)
        text(page[at : cut.start() if cut else len(page)])
    flush()
    return out


def vectors(page: list[Block], words: Words) -> np.ndarray:
    x = np.zeros((len(page), WIDTH), np.float32)
    if not page:
        return x
    slots = b"".join(b.path.slots.to_bytes(PATHS // 8, "little") for b in page)
    x[:, :PATHS] = np.unpackbits(np.frombuffer(slots, np.uint8), bitorder="little").reshape(len(page), PATHS)
    for i, b in enumerate(page):
        n = len(b.text)
        x[i, -SHARES:] = min(1.0, np.log1p(n) / 8), b.linked, b.text[-1] in ".!?", sum(map(b.text.count, ".,;")) * 10 / n, i / len(page), 1
    raw = [b.text.encode() for b in page]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for at, texts in words.texts(np.frombuffer(b"".join(raw), np.uint8), bounds):
        for i, w in enumerate(texts, at):
            if w.size:
                x[i, PATHS : PATHS + WORDS] = np.sqrt(np.bincount((w & np.uint64(WORDS - 1)).astype(np.int64), minlength=WORDS) / w.size)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for every step."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.p["v"], self.p["o"] = rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, learn: bool = True):
        """States of one direction for x of shape (steps, pages, WIDTH); masked steps keep the state.

        The tape of all steps is kept only to ``learn`` from.
        """
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        z = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[t] + h @ self.p[f"u{d}"]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            a = np.tanh(g[:, 3 * HIDDEN :])
            new = f * c + i * a
            s = np.tanh(new)
            m = mask[t][:, None]
            if learn:
                tape.append((t, h, c, i, f, o, a, s, m))
            h, c = np.where(m, o * s, h), np.where(m, new, c)
            out[t] = h
        return out, tape

    def _back(self, d: str, x: np.ndarray, tape: list, grad: np.ndarray) -> dict:
        u, n = self.p[f"u{d}"], x.shape[1]
        dz, du = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(u)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for t, h, c, i, f, o, a, s, m in reversed(tape):
            dh = dh + grad[t]
            live, livec = dh * m, dc * m
            ds = live * o * (1 - s * s) + livec
            g = np.concatenate([ds * a * i * (1 - i), ds * c * f * (1 - f), live * s * o * (1 - o), ds * i * (1 - a * a)], axis=1)
            dz[t] = g
            du += h.T @ g
            dh, dc = g @ u.T + dh * ~m, ds * f + dc * ~m
        return {f"w{d}": np.tensordot(x, dz, ([0, 1], [0, 1])), f"u{d}": du, f"c{d}": dz.sum(axis=(0, 1))}

    @staticmethod
    def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p) for p in pages)
        x = np.zeros((steps, len(pages), WIDTH), np.float32)
        mask = np.zeros((steps, len(pages)), bool)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, True
        return x, mask

    def odds(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The log-odds of every block of every page; pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest, batch = len(pages[order[-1]]), []
            while order and (not batch or (len(batch) + 1) * longest <= BATCH):
                batch.append(order.pop())
            x, mask = self._padded([pages[k] for k in batch])
            h = np.concatenate([self._run("f", x, mask, False)[0], self._run("b", x, mask, False)[0]], axis=2)
            y = h @ self.p["v"] + self.p["o"]
            for j, k in enumerate(batch):
                out[k] = y[: len(pages[k]), j]
        return out

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 12, size: int = 16, rate: float = 0.01) -> None:
        """Adam over mini-batches of pages."""
        rng = np.random.default_rng(5)
        m, v, step = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in "mv"), None, 0
        m, v = m
        for _ in range(rounds):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), size):
                some = sorted(order[at : at + size], key=lambda k: len(pages[k]))
                x, mask = self._padded([pages[k] for k in some])
                y = self._padded_labels([labels[k] for k in some], x.shape[0])
                (hf, tf), (hb, tb) = self._run("f", x, mask), self._run("b", x, mask)
                h = np.concatenate([hf, hb], axis=2)
                e = (_sigmoid(h @ self.p["v"] + self.p["o"]) - y) * mask / max(1, mask.sum())
                grads = {"v": np.tensordot(e, h, ([0, 1], [0, 1])), "o": e.sum(keepdims=True).reshape(1)}
                dh = e[:, :, None] * self.p["v"]
                grads |= self._back("f", x, tf, dh[:, :, :HIDDEN]) | self._back("b", x, tb, dh[:, :, HIDDEN:])
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1) + 1e-5 * self.p[k]
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    @staticmethod
    def _padded_labels(labels: list[np.ndarray], steps: int) -> np.ndarray:
        y = np.zeros((steps, len(labels)), np.float32)
        for k, p in enumerate(labels):
            y[: len(p), k] = p
        return y


#: Words of class, id and role that name a part of a page, for made pages and weak labels.
CONTENT = "article content post entry story body text main".split()
CHROME = {
    "menu": "nav menu navbar navigation breadcrumb topbar tabs".split(),
    "header": "header masthead branding banner logo".split(),
    "footer": "footer colophon copyright legal imprint".split(),
    "sidebar": "sidebar aside related recommended widget popular share social".split(),
    "notice": "cookie notice consent gdpr alert popup modal newsletter subscribe".split(),
    "advert": "ad ads advert advertisement sponsored promo banner".split(),
    "form": "search login signup contact form".split(),
    "comments": "comments comment respond discussion replies disqus".split(),
}
_TAGS = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div"), "notice": ("div", "section"), "advert": ("div", "aside"), "form": ("form", "div"), "comments": ("section", "div", "ol")}


def made_page(rng: np.random.Generator) -> str:
    """A page by random templates; content blocks are marked by a leading ``\\x01``."""
    pick = lambda a: a[int(rng.integers(len(a)))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(pick("abcdefghilmnoprstuv") for _ in range(int(rng.integers(2, 9))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    named = lambda kind: pick((' class="{}"', ' id="{}"', ' class="x {}"')).format(pick(("{}", "{}-box", "site-{}", "{}_wrap", "main-{}")).format(pick(CHROME[kind]))) if chance(0.85) else ""

    def chrome(kind: str) -> str:
        tag = pick(_TAGS[kind])
        name = named(kind) if tag in ("div", "section", "ul", "ol") else pick(("", named(kind)))
        if not name and tag in ("div", "section", "ul", "ol"):
            name = f' class="{pick(CHROME[kind])}"'
        links = lambda n: "".join(f"<li><a href='/{word()}'>{words(1, 3)}</a></li>" for _ in range(n))
        if tag == "ul":
            return f"<ul{name}>{links(5)}</ul>"
        body = {
            "menu": lambda: f"<ul>{links(int(rng.integers(3, 8)))}</ul>",
            "header": lambda: f"<div>{words(1, 4)}</div><p>{words(2, 7)}</p>",
            "footer": lambda: pick((f"&copy; {words(1, 4)} &middot; {words(3, 12)}.", f"<p>{words(2, 9)}</p><p>{words(2, 9)}</p>")),
            "sidebar": lambda: f"<h3>{words(1, 3)}</h3><ul>{links(4)}</ul>" + pick(("", f"<p>{words(4, 20)}.</p>")),
            "notice": lambda: f"<p>{words(5, 25)}.</p><button>{words(1, 2)}</button>",
            "advert": lambda: pick((f"{words(3, 15)}.", f"<p>{words(3, 15)}</p>")),
            "form": lambda: f"<label>{words(1, 2)}</label><input><button>{words(1, 2)}</button>",
            "comments": lambda: f"<h3>{words(1, 3)}</h3>" + "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{words(3, 40)}.</p></div>' for _ in range(int(rng.integers(1, 5)))),
        }[kind]()
        return f"<{tag}{name}>{body}</{tag}>"

    def content() -> str:
        out = [f"<h1>\x01{words(1, 9)}</h1>"] if chance(0.9) else []
        for _ in range(int(rng.integers(1, 14))):
            out.append(
                pick(
                    (
                        lambda: f"<p>\x01{words(1, 60)}.</p>",
                        lambda: f"<p>\x01{words(1, 4)}.</p>",
                        lambda: f"<p>\x01{words(4, 30)}, <a href='/x'>{words(1, 3)}</a> {words(2, 30)}.</p>",
                        lambda: f"<p><b>\x01{words(3, 20)}.<br><p>\x01{words(10, 80)}.</p>",
                        lambda: f"<h2>\x01{words(1, 6)}</h2><p>\x01{words(10, 60)}.",
                        lambda: "<ul>" + "".join(f"<li>\x01{words(2, 12)}</li>" for _ in range(3)) + "</ul>",
                        lambda: f"<blockquote>\x01{words(5, 30)}.</blockquote>",
                        lambda: f"<pre>\x01{words(5, 30)}</pre>",
                        lambda: chrome("advert") if chance(0.3) else f"<p>\x01{words(10, 60)}.</p>",
                    )
                )()
            )
        return "".join(out)

    tag = pick(("article", "article", "main", "div", "section"))
    name = f' class="{pick(("{}", "{}-content", "single-{}"))}"'.format(pick(CONTENT)) if tag in ("div", "section") or chance(0.3) else ""
    before = [k for k in ("notice", "header", "menu", "advert", "form", "sidebar") if chance(0.45)]
    after = [k for k in ("comments", "sidebar", "advert", "form", "notice", "footer") if chance(0.45)]
    middle = f"<{tag}{name}>{content()}</{tag}>"
    if chance(0.3):
        middle = f"<div{pick(('', ' class=wrapper', ' id=page'))}>{middle}{chrome('comments') if chance(0.3) else ''}</div>"
    return f"<html><head><title>{words(1, 8)}</title></head><body>{''.join(map(chrome, before))}{middle}{''.join(map(chrome, after))}</body></html>"


def weak_labels(page: list[Block]) -> np.ndarray | None:
    """Labels from a page's own sectioning tags, or None if it has no article."""
    chrome = {"nav", "header", "footer", "aside", "form", "title", "button"} | {f".{w}" for k in CHROME.values() for w in k}
    y = np.array([bool({"article", "main"} & set(b.path)) and not chrome & set(b.path[b.path.index("article" if "article" in b.path else "main") :]) for b in page], np.float32)
    return y if y.any() else None


def fit(pages: DataFrame, sample: int = 200, made: int = 400) -> Labeller:
    """Train on ``made`` pages of the generator and at most ``sample`` pages of the table.

    Of the table, pages of up to 100,000 characters are learned from, and of each the first 400
    blocks: bounds of the training sample alone, extraction has none.
    """
    rng, words = np.random.default_rng(17), Words()
    x, y = [], []
    for _ in range(made):
        page = blocks(made_page(rng))
        x.append(vectors([Block(b.path, b.text.replace("\x01", "").strip() or "-", b.linked) for b in page], words))
        y.append(np.array(["\x01" in b.text for b in page], np.float32))
    some = least_hashed(pages.select("page_id", "html"), sample, "page_id").where(F.length("html").between(1, 100_000))
    for row in some.select("html").collect():
        page = blocks(row.html)[:400]
        labels = weak_labels(page)
        if labels is not None:
            x.append(vectors(page, words))
            y.append(labels)
    keep = [k for k in range(len(x)) if len(x[k])]
    labeller = Labeller()
    labeller.train([x[k] for k in keep], [y[k] for k in keep])
    return labeller


def extracted(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks``: content blocks joined by an empty line.

    Null and empty html, and pages without content, have an empty text. Repeated rows are treated
    alike; a block whose log-odds are 0 is left out. A very long page is in memory whole, with a
    vector of ``WIDTH`` numbers for each block; cutting it takes time linear in its length, whatever is
    broken in it. An empty table gives none. Other columns are ignored.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in sliced(batches, "html", 1 << 20):
            cut = [blocks(h or "") for h in batch.column("html").to_pylist()]
            odds = labeller.odds([vectors(p, words) for p in cut])
            kept = [[b.text for b, o in zip(p, s) if o > 0] for p, s in zip(cut, odds)]
            texts = ["\n\n".join(k) for k in kept]
            yield record(schema, batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts], [len(k) for k in kept])

    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, fit(pages))


QUERIES = {"op5_html_text": op5_html_text}
ORACLES: dict[str, str] = {}
