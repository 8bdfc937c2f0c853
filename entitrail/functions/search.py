"""Literal and approximate search; spans are half-open code point ranges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

#: Stretches of text that are kept with their distances.
KNOWN = 100_000


def exact_spans(text: str, pattern: str) -> list[tuple[int, int]]:
    """Every occurrence, overlapping ones included."""
    if not pattern:
        raise ValueError("the pattern must not be empty")
    out, at = [], text.find(pattern)
    while at >= 0:
        out.append((at, at + len(pattern)))
        at = text.find(pattern, at + 1)
    return out


def pieces(pattern: str, k: int) -> list[tuple[int, str]]:
    """The pattern cut in k + 1 parts, with their places: within k edits, one part stays as it is."""
    cuts = [len(pattern) * i // (k + 1) for i in range(k + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:])]


def prefix_distances(text: str, start: int, pattern: str, k: int) -> list[tuple[int, int]]:
    """(end, distance) of each non-empty text[start:end] within ``k`` edits of the pattern, by a banded table."""
    m, most = len(pattern), min(len(text), start + len(pattern) + k)
    far = k + 1
    row = list(range(m + 1))  # distance of the text so far to each prefix of the pattern
    out = []
    for end in range(start + 1, most + 1):
        i = end - start
        c, low, high = text[end - 1], max(1, i - k), min(m, i + k)
        new = [far] * (m + 1)
        if i <= k:
            new[0] = i
        for j in range(low, high + 1):
            best = row[j - 1] + (pattern[j - 1] != c)
            if row[j] < best:
                best = row[j] + 1 if row[j] + 1 < best else best
            if new[j - 1] + 1 < best:
                best = new[j - 1] + 1
            new[j] = best if best < far else far
        row = new
        if row[m] <= k:
            out.append((end, row[m]))
        elif min(row[max(0, i - k) : high + 1], default=far) > k:
            break
    return out


def starts_around(hits: Iterable[tuple[int, int]], k: int, size: int) -> set[int]:
    """Where a span may begin that has a part at one of ``hits`` (place in the text, place in the pattern)."""
    return {s for at, place in hits for s in range(max(0, at - place - k), min(size, at - place + k + 1))}


def spans_from(text: str, starts: Iterable[int], pattern: str, k: int, known: dict[tuple[str, int, str], list[tuple[int, int]]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, distance) of the substrings within ``k`` edits that begin at ``starts``. ``known`` keeps what was said of a stretch of text."""
    size = len(pattern) + k
    for s in starts:
        key = (pattern, k, text[s : s + size])
        found = known.get(key)
        if found is None:
            if len(known) >= KNOWN:
                known.clear()
            found = known[key] = prefix_distances(key[2], 0, pattern, k)
        for end, distance in found:
            yield s, s + end, distance


def fuzzy_spans(text: str, pattern: str, k: int, hits: Iterable[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, distance) of every non-empty substring within ``k`` edits, by start and end.

    ``hits`` may name the places of the pattern's parts, where they are known already.
    """
    if not pattern:
        raise ValueError("the pattern must not be empty")
    if k < 0:
        raise ValueError("k must not be negative")
    if k == 0:
        return [(a, b, 0) for a, b in exact_spans(text, pattern)]
    if len(pattern) <= k:
        starts: Iterable[int] = range(len(text))
    else:
        if hits is None:
            hits = [(a, place) for place, part in pieces(pattern, k) for a, _ in exact_spans(text, part)]
        starts = sorted(starts_around(hits, k, len(text)))
    return [(s, e, d) for s in starts for e, d in prefix_distances(text, s, pattern, k)]
