"""Encoding with the tokenizers library, once for each distinct piece of text a task meets.

A piece is a stretch of text that the tokenizer is sure to cut off from its neighbours. Each new
piece goes through the library itself; its ids are then kept in a bounded memory, because words
repeat far more often than texts. The memory belongs to the worker process and outlives a task; it
has two generations of ``MEMORY`` pieces at most, and a piece that is met again moves to the newer.
``column`` keeps the ids of letters and of marks in two Arrow arrays of ``MEMORY`` rows at most, the
last ones met first; a slice of texts is cut, looked up and joined by Arrow, and Python sees only what is new.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import ChainMap
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import buffers

MEMORY = 300_000
#: The memories of this process by path and kind.
_MEMORIES: dict[tuple[str, str], list[dict]] = {}
#: A space before white space or the end: white space runs there may join across pieces.
_RUN = re.compile(r" (?:\s|$)")
#: A line break that may belong to a run of white space.
_BROKEN = re.compile(r"\n(?<=\s\n)")
#: Marks at a word's end.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pieces longer than this many characters are not kept; this many new ones go through the library at once.
LONG, TOGETHER = 64, 2000


def public(name: str) -> str:
    """The path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: What byte-level tokenizers split by, and the order of bytes in their alphabet.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What word-level tokenizers split by, where white space is dropped.
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces of these characters alone are split here; all others go through the library whole.
_PLAIN = re.compile(r"[\n\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]+")


def byte_letters() -> dict[int, str]:
    """The letter of each byte: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts exactly as ``Tokenizer.from_file(path)`` gives them, without special tokens added."""

    def __init__(self, path: str):
        self.path = path

    def __getstate__(self):
        return {"path": self.path}

    @cached_property
    def memory(self) -> list[dict]:
        """The newer and the older generation, kept for the life of the process."""
        return _MEMORIES.setdefault((self.path, "pieces"), [{}, {}])

    @cached_property
    def library(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    @cached_property
    def dtype(self) -> np.dtype:
        return np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")

    @cached_property
    def spaced(self) -> bool:
        """True for byte-level pieces that hold the space before them, False where spaces are dropped."""
        with open(self.path, encoding="utf-8") as f:
            return not json.load(f)["model"].get("end_of_word_suffix")

    @cached_property
    def mark(self) -> tuple[str, int] | None:
        """A special token that parts pieces within one call."""
        special = {i: t for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        return next(((t.content, i) for i, t in special.items()), None)

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, texts: list[str]) -> list[bytes]:
        """The ids of many short texts from one call: a special token stands between them."""
        if self.mark is None or any(self.mark[0] in t for t in texts):
            return self.raw(texts)
        ids = np.array(self.library.encode(self.mark[0].join(texts), add_special_tokens=False).ids, self.dtype)
        ends = [*np.flatnonzero(ids == self.mark[1]).tolist(), ids.size]
        if len(ends) != len(texts):
            return self.raw(texts)
        whole, w = ids.tobytes(), self.dtype.itemsize
        return [whole[w * a : w * b] for a, b in zip([0, *[e + 1 for e in ends]], ends)]

    @cached_property
    def split(self):
        """The pattern that parts a piece into the model's words, if the file names one that is known here."""
        import regex

        with open(self.path, encoding="utf-8") as f:
            whole = json.load(f)
        pre, norm = whole.get("pre_tokenizer") or {}, whole.get("normalizer")
        if self.spaced:
            ok = norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            return regex.compile(BYTE_LEVEL) if ok else None
        steps = pre.get("pretokenizers") or [{}]
        ok = len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex")
        return regex.compile(steps[0]["pattern"]["Regex"]) if ok and "Regex" in steps[0]["pattern"] else None

    @cached_property
    def folds(self) -> bool:
        """True if the file parts letters from the marks after them, and its normalizer does nothing to plain characters but fold their case."""
        plain = "".join(c for c in map(chr, range(33, 0x250)) if _PLAIN.fullmatch(c))
        return not self.spaced and self.split is not None and self.split.pattern == WORD_LEVEL and self.library.normalizer is not None and self.library.normalizer.normalize_str(plain) == plain.lower()

    @cached_property
    def letters(self) -> dict[int, str]:
        return byte_letters()

    @cached_property
    def tokenize(self):
        return self.library.model.tokenize

    def _word(self, word: str) -> bytes:
        """Ids of one of the model's words, from the library's model."""
        # of the printable ASCII characters only the space has another letter
        form = word.replace(" ", "\u0120") if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(form)]).tobytes()

    @cached_property
    def code(self) -> str:
        return {2: "H", 4: "I"}[self.dtype.itemsize]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of short texts: plain ones word by word, with a memory of words; others through the library."""
        if self.folds or self.spaced and self.split:
            out, rest = self._marked(texts) if self.folds else self._lettered(texts)
            if rest:
                for i, b in zip(rest, self._split([texts[i] for i in rest])):
                    out[i] = b
            return out
        return self._split(texts)

    def _split(self, texts: list[str]) -> list[bytes]:
        """The same by the pattern."""
        at = 1 if self.spaced else 0
        plain = [i for i, t in enumerate(texts) if len(t) <= LONG and (t.isascii() and t[at:].isalpha() or _PLAIN.fullmatch(t, at) and "<|" not in t)] if self.split else []
        out: list[bytes | None] = [None] * len(texts)
        forms = [texts[i] for i in plain]
        if forms and self.library.normalizer is not None:
            forms = self.library.normalizer.normalize_str(" ".join(forms)).split(" ")
            if len(forms) != len(plain):
                plain, forms = [], []
        words = self.words[0]
        if len(words) > MEMORY:
            words = self.words[0] = {}
        find = self.split.findall if self.split else None
        for i, form in zip(plain, forms):
            # letters alone are one word of either pattern
            parts = (form,) if form[at:].isalpha() else find(form)
            ids = []
            for w in parts:
                known = words.get(w)
                if known is None:
                    known = words[w] = self._word(w)
                ids.append(known)
            out[i] = b"".join(ids) if len(ids) != 1 else ids[0]
        rest = [i for i, b in enumerate(out) if b is None]
        for i, b in zip(rest, self._together([texts[i] for i in rest]) if rest else []):
            out[i] = b
        return out

    def _marked(self, texts: list[str]) -> tuple[list[bytes | None], list[int]]:
        """Ids of plain letters and then marks or none, which are words of their own; where of the others."""
        words = self.words[0]
        if len(words) > MEMORY:
            words = self.words[0] = {}
        out, rest = [], []
        for i, t in enumerate(texts):
            core = t.rstrip(_MARKS)
            if not core.isalpha() or len(t) > LONG or not (core.isascii() or _PLAIN.fullmatch(core)):
                rest.append(i)
                out.append(None)
                continue
            first = core.lower()
            ids = words.get(first)
            if ids is None:
                ids = words[first] = self._word(first)
            if len(core) < len(t):
                marks = t[len(core) :]
                more = words.get(marks)
                if more is None:
                    more = words[marks] = self._word(marks)
                ids += more
            out.append(ids)
        return out, rest

    def _lettered(self, texts: list[str]) -> tuple[list[bytes | None], list[int]]:
        """Ids of a space or line break, letters and then marks or none, which are words of their own; where of the others."""
        words = self.words[0]
        if len(words) > MEMORY:
            words = self.words[0] = {}
        out, rest = [], []
        for i, t in enumerate(texts):
            core = t.rstrip(_MARKS)
            letters = core[1:]
            if not letters.isalpha() or len(t) > LONG or not (letters.isascii() or _PLAIN.fullmatch(letters)):
                rest.append(i)
                out.append(None)
                continue
            first = core if core[0] == " " else letters
            ids = words.get(first)
            if ids is None:
                ids = words[first] = self._word(first)
            if first is letters:
                ids = self.line + ids
            if len(core) < len(t):
                marks = t[len(core) :]
                more = words.get(marks)
                if more is None:
                    more = words[marks] = self._word(marks)
                ids += more
            out.append(ids)
        return out, rest

    @cached_property
    def line(self) -> bytes:
        """Ids of a line break."""
        return self._word("\n")

    @cached_property
    def words(self) -> list[dict]:
        """Ids of single words; one generation, emptied where it is full."""
        return _MEMORIES.setdefault((self.path, "words"), [{}])

    def known(self, pieces: set, texts) -> dict:
        """A table that has the ids of all the pieces; ``texts`` makes a piece a text."""
        new, old = self.memory
        missing = pieces.difference(new)
        if not missing:
            return new
        if len(new) + len(missing) > MEMORY:
            self.memory[:] = {}, new
            (new, old), missing = self.memory, pieces
        got = {p: old[p] for p in missing if p in old} if old else {}
        rest = [p for p in missing if p not in got] if got else [*missing]
        for i in range(0, len(rest), TOGETHER):
            some = rest[i : i + TOGETHER]
            got.update(zip(some, self._pieces([texts(p) for p in some])))
        long = {p: got.pop(p) for p in rest if len(p) > LONG}
        new.update(got)
        return ChainMap(long, new) if long else new

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        if self.spaced:
            # a text is cut before single spaces and line breaks; the first piece has none, a line's first keeps its break
            whole = [None if _RUN.search(t) else (t if _BROKEN.search(t) else t.replace("\n", " \n")).split(" ") for t in texts]
            some = [w for w in whole if w is not None]
            first = iter(self.raw([w.pop(0) for w in some]))
            get = self.known(set().union(*some), _text).__getitem__
            return [self.raw([t])[0] if w is None else next(first) + b"".join(map(get, w)) for t, w in zip(texts, whole)]
        pieces = [t.encode().split() for t in texts]
        get = self.known(set().union(*pieces), bytes.decode).__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    @cached_property
    def parts(self) -> list[pa.Array]:
        """Cores and marks of pieces, the last ones met first, and their ids: null for a core of more than letters."""
        return _MEMORIES.setdefault((self.path, "parts"), [pa.array([], pa.large_string()), pa.array([], pa.large_binary())])

    def _learned(self, cores: list[str]) -> list[bytes]:
        """Ids of new pieces of letters, by the library's model."""
        # a line break parts the texts while all are translated at once; one at a core's head becomes NUL
        letters = self.letters | {0: self.letters[10], 10: "\n"}
        forms = "\n".join(["\0" + c[1:] if c[0] == "\n" else " " + c for c in cores]).encode().decode("latin-1").translate(letters).split("\n") if cores else []
        ids, ends = [], [0]
        tokenize, line = self.tokenize, self.letters[10]
        for form in forms:
            if form[0] == line:
                ids += [t.id for t in tokenize(line)]
                form = form[1:]
            ids += [t.id for t in tokenize(form)]
            ends.append(len(ids))
        whole, w = np.array(ids, self.dtype).tobytes(), self.dtype.itemsize
        return [whole[w * a : w * b] for a, b in zip(ends, ends[1:])]

    def _part(self, parts: pa.Array) -> pa.Array:
        """Ids of different cores and marks. A core stands for itself and the space before it, if it has no line break."""
        names, ids = self.parts
        place = pc.index_in(parts, value_set=names)
        found = place.is_valid().to_numpy(zero_copy_only=False)
        place = place.fill_null(0).to_numpy().astype(np.int64)
        new = parts.filter(pa.array(~found)).to_numpy(zero_copy_only=False).tolist()
        got = {p: self._word(p) if p else b"" for p in new if not p.rstrip(_MARKS)}
        learn = [p for p in new if len(p) <= LONG and _letters(p)]
        got.update(zip(learn, self._learned(learn)))
        place[~found] = len(ids) + np.arange(len(new))
        out = pa.concat_arrays([ids, pa.array([got.get(p) for p in new], pa.large_binary())]).take(pa.array(place))
        rest = np.ones(len(ids), bool)
        rest[place[found]] = False
        short = pc.less_equal(pc.binary_length(parts), LONG)
        rest = pa.array(rest)
        self.parts[:] = (pa.concat_arrays([x.filter(short), y.filter(rest)])[:MEMORY] for x, y in ((parts, names), (out, ids)))
        return out

    def _distinct(self, pieces: pa.Array) -> pa.Array:
        """Ids of different pieces that had a space before them or begin with a line break."""
        n = len(pieces)
        data, bounds = buffers(pieces)
        # a piece is cut into its core and the marks at its end, which are a word of their own after letters
        cuts = np.zeros(2 * n + 1, np.int64)
        cuts[::2] = bounds
        cuts[1::2] = bounds[:-1] + pc.binary_length(pc.ascii_rtrim(pieces, _MARKS)).to_numpy()
        parts = pa.LargeStringArray.from_buffers(2 * n, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        ids, codes = self._part(parts.dictionary), parts.indices.to_numpy()
        known = pc.and_(ids.is_valid(), pc.greater(pc.binary_length(parts.dictionary), 0)).to_numpy(zero_copy_only=False)[codes[::2]]
        _, bounds, data = ids.take(parts.indices).buffers()
        whole = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.frombuffer(bounds, np.int64)[: 2 * n + 1 : 2].copy()), data])
        if known.all():
            return whole
        rest = pieces.filter(pa.array(~known)).to_numpy(zero_copy_only=False).tolist()
        get = self.known(set(rest), _text).__getitem__
        place = np.arange(n)
        place[~known] = n + np.arange(len(rest))
        return pa.concat_arrays([whole, pa.array([get(p) for p in rest], pa.large_binary())]).take(pa.array(place))

    @cached_property
    def stops(self) -> tuple[str, ...]:
        """Added tokens after a line break: the text ends before them, so line breaks there are a run."""
        return tuple("\n" + t.content for t in self.library.get_added_tokens_decoder().values())

    def column(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text of a string column without nulls; Arrow cuts the texts, knows pieces again and joins their ids."""
        if not (self.spaced and self.split) or not len(texts):
            return self.encode(texts.to_pylist())
        cut = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n"), " ")
        starts = cut.offsets.to_numpy()
        starts = starts - starts[0]
        pieces = cut.flatten().dictionary_encode()
        names, at = pieces.dictionary, pieces.indices.to_numpy()
        # white space that may be part of a run across pieces: such texts are cut by the rules of ``encode``
        sizes = pc.binary_length(names).to_numpy()
        loose = pc.binary_length(pc.utf8_trim_whitespace(names)).to_numpy() < sizes
        some = np.flatnonzero(loose)
        loose[some] = [_loose(p) or p.startswith(self.stops) for p in names.take(pa.array(some)).to_pylist()]
        runs = (loose | (sizes == 0))[at]
        first = starts[:-1]
        runs[first[sizes[at[first]] == 0]] = False
        if (line := names.index("\n").as_py()) >= 0:
            runs[1:] |= (at[1:] == line) & (at[:-1] == line)
        odd = np.logical_or.reduceat(runs, first)
        whole = iter(self.encode(texts.filter(pa.array(odd)).to_pylist()))
        heads = iter(self.raw(names.take(pa.array(at[first[~odd]])).to_pylist()))
        # a text's first piece has no space before it; it stands for the whole of an odd text, whose others are empty
        own = [next(whole) if o else next(heads) for o in odd.tolist()] + [b""]
        used = np.ones(at.size, bool)
        used[first] = False
        used &= ~np.repeat(odd, np.diff(starts))
        met = np.zeros(len(names), bool)
        met[at[used]] = True
        place = np.cumsum(met) - 1
        n = int(met.sum())
        at = np.where(used, place[at], n + len(own) - 1)
        at[first] = n + np.arange(len(first))
        ids = pa.concat_arrays([self._distinct(names.filter(pa.array(met))), pa.array(own, pa.large_binary())]).take(pa.array(at))
        data, bounds = buffers(ids)
        data, bounds = data.tobytes(), bounds[starts].tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def _text(piece: str) -> str:
    """A piece with the space that it was cut off after."""
    return piece if piece[:1] == "\n" else " " + piece


def _letters(core: str) -> bool:
    """True for plain letters, after a line break or not."""
    letters = core[1:] if core[:1] == "\n" else core
    return letters.isalpha() and (letters.isascii() or _PLAIN.fullmatch(letters) is not None)


def _loose(piece: str) -> bool:
    """True for white space at an end of a piece, or after its line break; not for the line break alone."""
    if piece == "\n":
        return False
    return piece[-1].isspace() or piece[0].isspace() and (piece[0] != "\n" or piece[1].isspace())
