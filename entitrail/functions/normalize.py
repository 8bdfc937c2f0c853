"""Normalization by profile, with the source range of every normalized character."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np

# Letters that look alike, and quotes that count as one.
_LOOKALIKES = str.maketrans("АВЕКМНОРСТУХавекмнорстух", "ABEKMHOPCTYXABEKMHOPCTYX")
_QUOTES = str.maketrans("«»“”„", '"""""')

_SOLID = frozenset({"vin", "plate", "identifier"})  # blanks, hyphens and number signs do not count
_NO_BLANKS = frozenset({"tax_id", "reference", "date"})
_ONE_BLANK = frozenset({"name", "text"})
_FOLDED = frozenset({"name", "text", "email"})
PROFILES = ("name", "vin", "plate", "identifier", "date", "text", "email", "tax_id", "reference")


@dataclass(frozen=True)
class Normalized:
    original: str
    value: str
    ranges: Callable[[], tuple[np.ndarray, np.ndarray]] | None  # None: each character stands for the one at its place

    @cached_property
    def _ranges(self) -> tuple[np.ndarray, np.ndarray]:
        if self.ranges is None:
            at = np.arange(len(self.value))
            return at, at + 1
        return self.ranges()

    @property
    def start(self) -> np.ndarray:
        """Of the source range of each character of ``value``; ranges are made out when first asked for."""
        return self._ranges[0]

    @property
    def end(self) -> np.ndarray:
        return self._ranges[1]

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.ranges is None else (self.start.item(a), self.end.item(b - 1))

    def whole(self, a: int, b: int) -> bool:
        """False if a side cuts through what one source range became."""
        if self.ranges is None:
            return True
        start, end = self._ranges
        same = lambda i: 0 < i < len(start) and start.item(i) == start.item(i - 1) and end.item(i) == end.item(i - 1)
        return not (same(a) or same(b))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _text(of: np.ndarray) -> str:
    return of.tobytes().decode("utf-32-le", "surrogatepass")


def _marked(c: str) -> bool:
    return unicodedata.category(c)[0] == "M"


#: Of a code: whether it is a mark, part of a word, a letter or digit, white space; and that it was looked up.
MARK, WORD, ALNUM, SPACE, _SEEN = 1, 2, 4, 8, 16
_classes = np.zeros(sys.maxunicode + 1, dtype=np.uint8)


def classes(of: np.ndarray) -> np.ndarray:
    """The classes of codes, as bits."""
    out = _classes[of]
    new = out == 0
    if new.any():
        for code in set(of[new].tolist()):
            c = chr(code)
            mark, alnum = _marked(c), c.isalnum()
            _classes[code] = _SEEN + MARK * mark + WORD * (mark or alnum or c == "_") + ALNUM * alnum + SPACE * c.isspace()
        out = _classes[of]
    return out


_units: dict[tuple[str, str | None], str] = {}


def _unit(unit: str, profile: str | None) -> str:
    """What a unit of composition becomes, blanks included; without a profile, its compatible form."""
    key = (unit, profile)
    out = _units.get(key)
    if out is None:
        if unit == "№" and profile == "identifier":
            out = ""
        else:
            out = unicodedata.normalize("NFKC", unit)
            if profile is None:
                pass
            elif profile == "name":
                out = out.casefold().replace("ё", "е")
            elif profile == "text":
                out = out.casefold().translate(_QUOTES)
            elif profile == "email":
                out = out.casefold()
            elif profile in ("vin", "plate"):
                out = out.translate(_LOOKALIKES).upper()
            else:
                out = out.upper()
        if len(_units) < 100_000:
            _units[key] = out
    return out


#: In a table of what codes become: none or several characters, and not looked up yet.
_LONG, _NEW = 1 << 30, 1 << 31
_tables: dict[str | None, np.ndarray] = {}


def _spelled(of: np.ndarray, profile: str | None) -> tuple[str, np.ndarray | None]:
    """What codes become that are units each, and how many characters each does; None if one."""
    table = _tables.get(profile)
    if table is None:
        table = _tables[profile] = np.full(sys.maxunicode + 1, _NEW, dtype=np.uint32)
    out = table[of]
    most = out.max(initial=0)
    if most >= _NEW:
        for code in set(of[out >= _NEW].tolist()):
            unit = _unit(chr(code), profile)
            table[code] = ord(unit) if len(unit) == 1 else _LONG
        out = table[of]
        most = out.max()
    if most < _LONG:
        return _text(out), None
    places = np.flatnonzero(out == _LONG)
    out[places] = ord(" ")
    long, plain, parts, at = [_unit(chr(c), profile) for c in of[places].tolist()], _text(out), [], 0
    for i, unit in zip(places.tolist(), long):
        parts += plain[at:i], unit
        at = i + 1
    sizes = np.ones(len(of), dtype=np.int64)
    sizes[places] = [*map(len, long)]
    return "".join([*parts, plain[at:]]), sizes


class Source:
    """A text, with what its normalizations by several profiles share."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def codes(self) -> np.ndarray:
        return codes(self.text)

    @cached_property
    def unit_ends(self) -> list[int] | None:
        """Where units of composition end; None if every character is one."""
        text = self.text
        # the compatible form of the whole is that of its characters' compatible forms in a row
        if text.isascii() or not (classes(self.codes) & MARK).any() and unicodedata.is_normalized("NFKC", _spelled(self.codes, None)[0]):
            return None
        nfkc, ends, at = (lambda s: unicodedata.normalize("NFKC", s)), [], 0
        for i in range(1, len(text) + 1):
            if i < len(text):
                unit, c = text[at:i], text[i]
                if _marked(c) or nfkc(unit + c) != nfkc(unit) + nfkc(c):
                    continue
            ends.append(i)
            at = i
        return ends


def _dropped(profile: str) -> str:
    return " \t-№" if profile in _SOLID else " \t" if profile in _NO_BLANKS else ""


def _ranges(bounds: np.ndarray, sizes: np.ndarray | None, spelled: str, profile: str) -> tuple[np.ndarray, np.ndarray]:
    """Source ranges: of units between ``bounds`` that became ``sizes`` characters of ``spelled``, less the blanks that went."""
    start, end = bounds[:-1], bounds[1:]
    if sizes is not None:
        start, end = np.repeat(start, sizes), np.repeat(end, sizes)
    of = codes(spelled)
    if dropped := _dropped(profile):
        keep = ~np.isin(of, codes(dropped))
        return start[keep], end[keep]
    if profile in _ONE_BLANK:
        blank = np.concatenate([[False], (of == ord(" ")) | (of == ord("\t")), [False]])
        first, last = blank[1:-1] & ~blank[:-2], blank[1:-1] & ~blank[2:]
        end = end.copy()
        end[first] = end[last]  # one blank stands for the whole run
        keep = first | ~blank[1:-1]
        start, end = start[keep], end[keep]
    return start, end


def normalize(text: str, profile: str, source: Source | None = None) -> Normalized:
    source = source or Source(text)
    bounds = sizes = None
    if text.isascii():
        spelled = text.casefold() if profile in _FOLDED else text.upper()
    elif source.unit_ends is None:
        spelled, sizes = _spelled(source.codes, profile)
    else:
        bounds = np.array([0, *source.unit_ends])
        out = [_unit(text[a:b], profile) for a, b in zip(bounds[:-1].tolist(), source.unit_ends)]
        sizes = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
        spelled = "".join(out)
    value = spelled
    for c in _dropped(profile):
        value = value.replace(c, "")
    if profile in _ONE_BLANK:
        value = value.replace("\t", " ")
        while "  " in value:
            value = value.replace("  ", " ")
    if bounds is None and sizes is None and len(value) == len(spelled):
        return Normalized(text, value, None)
    return Normalized(text, value, partial(_ranges, np.arange(len(text) + 1) if bounds is None else bounds, sizes, spelled, profile))
