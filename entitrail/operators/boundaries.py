"""Which spans count as mentions: boundary rules by profile, and what a normalized span may hold."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from ..functions.normalize import ALNUM, SPACE, WORD, Normalized, Source, classes, codes

# Fixed value: the words for "year" and "of birth" that may follow a date at once.
_YEAR_WORD = r"г(?:од(?:а|у|ом)?)?\.?(?:[ \t]*р(?:ождения)?\.?)?(?!\w)"
_AFTER_DATE = re.compile(_YEAR_WORD, re.IGNORECASE)
_DATE_WITH_WORD = re.compile(rf"\d[ \t]*{_YEAR_WORD}$", re.IGNORECASE)


def word_char(c: str) -> bool:
    return c == "_" or c.isalnum() or unicodedata.category(c)[0] == "M"


def bounded(text: str, a: int, b: int, profile: str, field_name: str) -> bool:
    """Whether text[a:b] stands for itself in the original text."""
    before, after = text[a - 1 : a] if a else "", text[b : b + 1]
    if profile == "date" and _DATE_WITH_WORD.search(text[a:b]):
        return False
    if before and word_char(before):
        return False
    if after and word_char(after) and not (profile == "date" and text[b - 1].isdigit() and _AFTER_DATE.match(text, b)):
        return False
    if profile == "email":
        further = text[b + 1 : b + 2]
        if before and before in ".%+-@" or after and after in "@%+-" or after == "." and further and word_char(further):
            return False
    elif profile == "reference":
        if field_name == "case_number":
            while a and text[a - 1] in " \t":
                a -= 1
            while b < len(text) and text[b] in " \t":
                b += 1
        if text[a - 1 : a] in ("/", "-") and a or text[b : b + 1] in ("/", "-"):
            return False
    return True


def sides(n: Normalized, source: Source, profile: str) -> tuple[bytes, bytes]:
    """For each place in the normalized text whether an acceptable span may begin there, and whether one may end there.

    What is ruled out here is not acceptable; what is left still has to be asked about.
    """
    word = np.zeros(len(source.text) + 2, dtype=bool)  # with a place before the text and one after it
    word[1:-1] = classes(source.codes) & WORD
    kinds = classes(codes(n.value))
    solid = (kinds & ALNUM > 0) if profile not in ("text", "email", "reference") else (kinds & SPACE == 0)
    begins, ends = np.zeros(len(n.value) + 1, dtype=bool), np.zeros(len(n.value) + 1, dtype=bool)
    begins[:-1] = solid & ~word[n.start]
    ends[1:] = True if profile == "date" else ~word[n.end + 1]
    if n.ranges is not None:
        cut = (n.start[1:] == n.start[:-1]) & (n.end[1:] == n.end[:-1])
        begins[1:-1] &= ~cut
        ends[1:-1] &= ~cut
    return begins.tobytes(), ends.tobytes()


def acceptable(n: Normalized, a: int, b: int, profile: str, field_name: str, alias: str, max_gap: int) -> bool:
    """Whether the normalized span n.value[a:b] may stand for ``alias``: whole characters, bounds, gaps and content."""
    if not n.whole(a, b):
        return False
    start, end = n.span(a, b)
    if not bounded(n.original, start, end, profile, field_name):
        return False
    if n.ranges is not None and b - a > 1 and int((n.start[a + 1 : b] - n.end[a : b - 1]).max()) > max_gap:
        return False
    value = n.value[a:b]
    if not value or "\n" in value or "\r" in value:
        return False
    first, last = value[0], value[-1]
    if profile in ("text", "email", "reference"):
        return not (first.isspace() or last.isspace()) and (last.isalnum() or not alias[-1].isalnum())
    if not first.isalnum() or not (last.isalnum() or last == "."):
        return False
    if profile == "tax_id":
        return value.isascii() and value.isdigit()
    if profile in ("vin", "plate", "identifier"):
        return value.isalnum()
    if profile == "name":
        allowed = " -'’." if "." in alias else " -'’"
        return all(c in allowed or c.isalpha() or unicodedata.category(c)[0] == "M" for c in value)
    return True
