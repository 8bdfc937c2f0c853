"""Candidate generation: every alias in every text, exactly, normalized, and within its edit budget.

Runs in Arrow batches over documents. The aliases of a catalog are compiled once into multi-pattern automata: of the values as written, and
by profile of the normalized values and of the parts that a misspelled one must still contain. One pass over a text
and its normalized forms then finds the places worth a closer look and the aliases that they belong to; no others are
looked at, however many there are. The same pass resolves the document's candidates.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchingConfig, allowed_distance
from ..functions.normalize import Normalized, Source, codes, normalize
from ..functions.search import pieces, spans_from
from .boundaries import acceptable, bounded, sides
from .document import near, resolve
from .resolve import DUPLICATE

METHODS = ("exact", "normalized", "bitap")
#: Characters that evidence does not reach across.
BARRIERS = ".!?;\n\r"
_IS_BARRIER = np.isin(np.arange(128), codes(BARRIERS))

_CANDIDATE = [
    ("alias_ord", pa.int32()), ("entity_type", pa.string()), ("entity_id", pa.string()), ("field_name", pa.string()), ("value", pa.string()),
    ("weight", pa.float64()), ("profile", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("matched_text", pa.string()),
    ("score", pa.float64()), ("method", pa.int32()), ("edit_distance", pa.int32()), ("barriers_before", pa.int32()), ("barriers_within", pa.int32()),
]


class _Patterns:
    """Occurrences of many strings in a text, overlapping ones included."""

    def __init__(self, strings: set[str]):
        import ahocorasick

        self.strings = strings
        self.automaton = ahocorasick.Automaton()
        for s in strings:
            self.automaton.add_word(s, s)
        if strings:
            self.automaton.make_automaton()

    def places(self, text: str) -> dict[str, list[int]]:
        found: dict[str, list[int]] = defaultdict(list)
        if self.strings:
            for last, s in self.automaton.iter(text):
                found[s].append(last)
        return {s: [last + 1 - len(s) for last in ends] for s, ends in found.items()}


class Matcher:
    """The aliases (entity_type, entity_id, field_name, value, weight, profile) of one catalog, in their order."""

    def __init__(self, aliases: list[dict], config: MatchingConfig):
        self.config, self.aliases = config, []
        written: dict[str, list[int]] = defaultdict(list)
        formed: dict[str, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.always: list[int] = []  # a budget as long as the pattern leaves no part to look for
        for i, a in enumerate(aliases):
            pattern = normalize(a["value"], a["profile"]).value
            budget = allowed_distance(a["entity_type"], a["field_name"], a["value"], len(pattern), config) if pattern else 0
            self.aliases.append((a.get("alias_ord", i), a, pattern, budget))
            written[a["value"]].append(i)
            if pattern:
                for string in {pattern, *(part for _, part in pieces(pattern, budget))} if budget and len(pattern) > budget else {pattern}:
                    formed[a["profile"]][string].append(i)
                if budget >= len(pattern):
                    self.always.append(i)
        self.written, self.of_written = _Patterns(set(written)), written
        self.by_profile = {p: _Patterns(set(s)) for p, s in formed.items()}
        self.known: dict = {}
        self.of_formed = {p: dict(s) for p, s in formed.items()}

    def candidates(self, text: str) -> list[tuple]:
        """(alias, alias's order, start, end, score, method's number, distance), exact ones of an alias first."""
        source = Source(text)
        written = self.written.places(text)
        hit = {i for s in written for i in self.of_written[s]} | set(self.always)
        forms: dict[str, Normalized] = {}
        places: dict[str, dict[str, list[int]]] = {}
        for profile, patterns in self.by_profile.items():
            forms[profile] = normalize(text, profile, source)
            places[profile] = patterns.places(forms[profile].value)
            hit |= {i for s in places[profile] for i in self.of_formed[profile][s]}
        fuzzy: dict[tuple[str, str, int], list[tuple[int, int, int]]] = {}
        open_at: dict[str, tuple[bytes, bytes]] = {}
        out = []
        for i in sorted(hit):
            order, a, pattern, budget = self.aliases[i]
            value, profile, name, weight = a["value"], a["profile"], a["field_name"], a["weight"]
            explained: set[tuple[int, int]] = set()
            for start in written.get(value, ()):
                if bounded(text, start, start + len(value), profile, name):
                    explained.add((start, start + len(value)))
                    out.append((a, order, start, start + len(value), weight * 1, 0, 0))
            if not pattern:
                continue
            n, at = forms[profile], places[profile]
            for start in at.get(pattern, ()):
                if acceptable(n, start, start + len(pattern), profile, name, value, self.config.max_separator_gap):
                    span = n.span(start, start + len(pattern))
                    if span not in explained:
                        explained.add(span)
                        out.append((a, order, *span, weight * 1, 1, 0))
            if not budget:
                continue
            key = (profile, pattern, budget)
            if key not in fuzzy:
                if profile not in open_at:
                    open_at[profile] = sides(n, source, profile)
                begins, ends = open_at[profile]
                starts = self._starts(n.value, pattern, budget, at, begins)
                fuzzy[key] = [x for x in spans_from(n.value, starts, pattern, budget, self.known) if x[2] and ends[x[1]]]
            known = _Spans(explained) if fuzzy[key] else None
            for start, end, distance in fuzzy[key]:
                if acceptable(n, start, end, profile, name, value, self.config.max_separator_gap):
                    span = n.span(start, end)
                    if not known.meets(*span):
                        quality = 1 - distance / max(len(pattern), end - start)
                        out.append((a, order, *span, weight * quality, 2, distance))
        return out


    def _starts(self, value: str, pattern: str, k: int, at: dict[str, list[int]], begins: bytes) -> list[int]:
        """Where a span may begin that is within ``k`` edits of the pattern: near one of its parts, if these are of use."""
        if len(pattern) <= k:
            return [s for s in range(len(value)) if begins[s]]
        hits = [(np.array(at[part]), place) for place, part in pieces(pattern, k) if part in at]
        near = np.zeros(len(pattern) + k + len(value) + 2 * k + 1, dtype=bool)  # by how far a span would begin from -len(pattern) - k
        for places, place in hits:
            for shift in range(-k, k + 1):
                near[places + (len(pattern) + k - place + shift)] = True
        return np.flatnonzero(near[len(pattern) + k :][: len(value)] & np.frombuffer(begins, dtype=bool)[:-1]).tolist() if hits else []


class _Spans:
    """Whether a span overlaps one of a set."""

    def __init__(self, spans: set[tuple[int, int]]):
        self.starts = sorted(a for a, _ in spans)
        self.furthest, most = [], 0
        for _, end in sorted(spans):
            most = max(most, end)
            self.furthest.append(most)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, b - 1)
        return i > 0 and self.furthest[i - 1] > a


def _rows(matcher: Matcher, text: str) -> list[dict]:
    found = matcher.candidates(text)
    if not found:
        return []
    barriers = np.flatnonzero(_IS_BARRIER[np.minimum(codes(text), 127)])
    before = np.searchsorted(barriers, [x[2] for x in found]).tolist()
    within = np.searchsorted(barriers, [x[3] for x in found]).tolist()
    names = [name for name, _ in _CANDIDATE]
    return [
        dict(zip(names, (order, a["entity_type"], a["entity_id"], a["field_name"], a["value"], a["weight"], a["profile"], start, end, text[start:end], score, method, distance, b, w - b)))
        for (a, order, start, end, score, method, distance), b, w in zip(found, before, within)
    ]


#: Aliases that one pass over the documents searches for; a larger catalog takes several.
ALIASES_PER_PASS = 100_000
#: What support is told of.
_SUPPORT = [("place", pa.int32()), *((n, k) for n, k in _CANDIDATE if n not in ("alias_ord", "barriers_before", "barriers_within"))]
_MENTION = pa.struct(
    [*_CANDIDATE, ("place", pa.int32()), ("combined", pa.float64()), ("support", pa.list_(pa.struct(_SUPPORT))), ("reason", pa.string()), ("n", pa.int32()), ("reject_ord", pa.int32())]
)
_SQL = {pa.int32(): "int", pa.string(): "string", pa.float64(): "double"}
_SUPPORT_SQL = ",".join(f"`{n}`:{_SQL[k]}" for n, k in _SUPPORT)
#: The type of ``mentions``, which marking adds to documents.
MENTIONS = f"array<struct<{','.join(f'`{n}`:{_SQL[k]}' for n, k in _CANDIDATE)},place:int,combined:double,support:array<struct<{_SUPPORT_SQL}>>,reason:string,n:int,reject_ord:int>>"
#: Mentions of this many documents, or rather characters of text, are put out at a time.
_PART_ROWS, _PART_CHARS = 500, 4_000_000


def _mapped(documents: DataFrame, each: Callable[[pa.RecordBatch, int], list[dict]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``documents`` with ``mentions``, as ``each`` gives them of a batch's row; all columns stay but ``drop``."""
    kept = [c for c in documents.columns if c not in (*drop, "mentions")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = min(_PART_ROWS, max(1, batch.num_rows * _PART_CHARS // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = pa.array([each(part, i) for i in range(part.num_rows)], pa.list_(_MENTION))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), found], names=[*kept, "mentions"])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)
    return documents.mapInArrow(run, f"{schema}, mentions {MENTIONS}")


def mark_texts(documents: DataFrame, passes: list[Broadcast], config: MatchingConfig) -> DataFrame:
    """``documents`` (..., text) with ``mentions``: the candidates of one catalog, resolved.

    ``passes`` are lists of aliases with their order ``alias_ord`` over all, each of which a task holds at a time.
    """
    for k, shared in enumerate(passes, 1):
        memo: dict = {}

        def each(batch: pa.RecordBatch, i: int, shared=shared, memo=memo, last=k == len(passes)) -> list[dict]:
            if "matcher" not in memo:
                memo["matcher"] = Matcher(shared.value, config)
            found = _rows(memo["matcher"], batch.column("text")[i].as_py() or "")
            if "mentions" in batch.schema.names:
                found += batch.column("mentions")[i].as_py()
            return resolve(found, config) if last else found

        documents = _mapped(documents, each)
    return documents


#: Pairs that are put out at a time.
_PART_PAIRS = 20_000


def evidence_pairs(marked: DataFrame, config: MatchingConfig, key: str) -> DataFrame:
    """(key, start, end, other_start, other_end, other_field): each mention with every one that is evidence for it. A row's mentions meet within it."""
    columns = ["start", "end", "field_name", "entity_type", "entity_id", "barriers_before", "barriers_within"]
    unique = F.filter("mentions", lambda m: ~m["reason"].eqNullSafe(DUPLICATE))
    rows = marked.select(key, F.transform(unique, lambda m: F.struct(*(m[c].alias(c) for c in columns))).alias("m")).where("size(m) > 1")
    names = [key, "start", "end", "other_start", "other_end", "other_field"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []

            def put() -> pa.RecordBatch:
                of, *rest = zip(*out)
                arrays = [pa.array(x, t) for x, t in zip(rest, [*[pa.int32()] * 4, pa.string()])]
                out.clear()
                return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(of)), *arrays], names=names)

            for i, mentions in enumerate(batch.column("m")):
                for pair in near(mentions.as_py(), config):
                    out += ((i, a["start"], a["end"], b["start"], b["end"], b["field_name"]) for a, b in (pair, pair[::-1]))
                    if len(out) >= _PART_PAIRS:
                        yield put()
            if out:
                yield put()

    return rows.mapInArrow(run, f"`{key}` {marked.schema[key].dataType.simpleString()}, `start` int, `end` int, other_start int, other_end int, other_field string")


def mark_rows(documents: DataFrame, config: MatchingConfig) -> DataFrame:
    """Where each document brings its own catalog: (..., text, aliases), see ``alias_arrays``. No shuffle."""

    def each(batch: pa.RecordBatch, i: int) -> list[dict]:
        return resolve(_rows(Matcher(batch.column("aliases")[i].as_py() or [], config), batch.column("text")[i].as_py() or ""), config)

    return _mapped(documents, each, ("aliases",))
