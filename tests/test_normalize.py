import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from entitrail.functions.normalize import PROFILES, _unit, normalize


@pytest.mark.parametrize(
    "text, profile, value",
    [
        ("А 123 ВС 77", "plate", "A123BC77"),
        ("45 01 № 123456", "identifier", "4501123456"),
        ("20.01 1 1973", "date", "20.0111973"),
        ("СЕМЁН", "name", "семен"),
        ("Straße", "name", "strasse"),
        ("ﬃ", "text", "ffi"),
        ("가", "text", "가"),
        ("«Ромашка»", "text", '"ромашка"'),
        ("a \t  b", "name", "a b"),
        ("a \t  b", "email", "a \t  b"),
        ("№ 5", "vin", "NO5"),
    ],
)
def test_values(text, profile, value):
    assert normalize(text, profile).value == value


def test_source_ranges():
    n = normalize("ß", "name")
    assert not n.whole(0, 1) and n.whole(0, 2) and n.span(0, 2) == (0, 1)
    n = normalize("😀\r\nA  b", "text")
    assert n.value == "😀\r\na b" and n.span(3, 6) == (3, 7)
    n = normalize("СЕМЁН", "name")
    assert n.span(3, 4) == (3, 5)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20), st.sampled_from(PROFILES))
def test_ranges_hold_their_characters(text, profile):
    n = normalize(text, profile)
    assert len(n.value) == len(n.start) == len(n.end)
    assert all(a < b for a, b in zip(n.start, n.end)) and all(a <= b for a, b in zip(n.start, n.start[1:]))
    assert not len(n.value) or n.end[-1] <= len(text)


def plain(text, profile):
    """Value and source ranges, a character at a time."""
    nfkc, bounds = (lambda s: unicodedata.normalize("NFKC", s)), [0]
    single = "".join(map(nfkc, text)) == nfkc(text) and not any(unicodedata.category(c)[0] == "M" for c in text)
    for i in range(1, len(text)):
        unit, c = text[bounds[-1] : i], text[i]
        if single or unicodedata.category(c)[0] != "M" and nfkc(unit + c) == nfkc(unit) + nfkc(c):
            bounds.append(i)
    out = [(c, a, b) for a, b in zip(bounds, [*bounds[1:], len(text)]) if text for c in _unit(text[a:b], profile)]
    if profile in ("name", "text"):
        runs = []
        for c, a, b in out:
            if c in " \t" and runs and runs[-1][0] == " ":
                runs[-1] = (" ", runs[-1][1], b)
            else:
                runs.append((" " if c in " \t" else c, a, b))
        return runs
    gone = " \t-№" if profile in ("vin", "plate", "identifier") else "" if profile in ("email",) else " \t"
    return [x for x in out if x[0] not in gone]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=12), st.text("aAß \t-№ёЁ«”²ﬃİй\u0306\u0301각ᄀ\r.ǅ😀", max_size=12)), st.sampled_from(PROFILES))
def test_tables_equal_single_characters(text, profile):
    n = normalize(text, profile)
    assert [*zip(n.value, n.start.tolist(), n.end.tolist())] == plain(text, profile)


def test_characters_are_not_handled_one_by_one():
    texts = ["Straße, größer “quoted” и ещё слова № 5, then many plain words and more of them, und weitere Wörter. " * 2000, "plain words, one by one. " * 8000]
    for text in texts:
        for profile in ("name", "text"):
            normalize(text, profile)
            began = time.process_time()
            for _ in range(5):
                normalize(text, profile)
            assert time.process_time() - began < 5 * len(text) * 200e-9  # it took 700 ns a character
