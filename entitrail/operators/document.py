"""Resolution of one document's candidates, where they are found.

A document is one row, so all that duplicates, evidence, ambiguity, thresholds and overlaps compare is together in the
task that matched its text. Resolving it there needs no shuffle and no key. ``resolve.py`` has the same steps as
operators on tables of candidates; a test holds the two against each other.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

from ..config import MatchingConfig
from .resolve import AMBIGUOUS, COMPOSITES, DUPLICATE, NAME_PARTS, OVERLAP, WEAK


def _rank(c: dict) -> tuple:
    return c["method"], -c["score"], c["edit_distance"], c["start"] - c["end"], c["value"], c["alias_ord"], c["start"], c["end"]


def _by_strength(c: dict) -> tuple:
    return c["method"], -c["combined"], c["edit_distance"], c["start"] - c["end"], c["start"], c["end"], c["entity_type"], c["entity_id"], c["field_name"], c["place"]


def near(unique: list[dict], config: MatchingConfig) -> Iterator[tuple[dict, dict]]:
    """The pairs of mentions of different fields of an entity that are near each other, with no barrier between; the left one first."""
    entities = defaultdict(list)
    for c in unique:
        entities[c["entity_type"], c["entity_id"]].append(c)
    for own in entities.values():
        own.sort(key=lambda c: c["start"])
        starts = [c["start"] for c in own]
        for left in own:
            clear = left["barriers_before"] + left["barriers_within"]
            for right in own[bisect_left(starts, left["end"]) : bisect_right(starts, left["end"] + config.evidence_window)]:
                if right["field_name"] != left["field_name"] and right["barriers_before"] == clear:
                    yield left, right


def _support(unique: list[dict], config: MatchingConfig) -> None:
    """``support`` of each mention: the best neighbour of each other field of its entity, with no barrier between."""
    best: dict[int, dict[str, dict]] = defaultdict(dict)
    for pair in near(unique, config):
        for a, b in (pair, pair[::-1]):
            now = best[a["place"]].get(b["field_name"])
            if now is None or b["place"] < now["place"]:
                best[a["place"]][b["field_name"]] = b
    for c in unique:
        c["support"] = sorted(best[c["place"]].values(), key=lambda x: x["place"]) if c["place"] in best else []


def _judge(unique: list[dict], config: MatchingConfig) -> None:
    """``reason`` of mentions that another entity claims as well, or that are weak."""
    spans: dict[tuple, dict[str, float]] = defaultdict(dict)
    for c in unique:
        own = spans[c["entity_type"], c["start"], c["end"]]
        own[c["entity_id"]] = max(own.get(c["entity_id"], -1.0), c["combined"])
    strongest = {span: sorted(((s, i) for i, s in own.items()), reverse=True)[:2] for span, own in spans.items()}
    for c in unique:
        rival = next((s for s, i in strongest[c["entity_type"], c["start"], c["end"]] if i != c["entity_id"]), -1.0)
        if rival >= c["combined"] - config.ambiguity_margin:
            c["reason"] = AMBIGUOUS
        elif c["combined"] < config.acceptance_threshold:
            c["reason"] = WEAK


def _compatible(a: dict, b: dict) -> bool:
    """Different roles may share text: one span, or a person's name part within a sender's full name."""
    if a["entity_type"] == b["entity_type"]:
        return False
    if (a["start"], a["end"]) == (b["start"], b["end"]):
        return True
    person, sender = (a, b) if a["entity_type"] == "person" else (b, a)
    roles = person["entity_type"] == "person" and sender["entity_type"] == "sender"
    return roles and person["field_name"] in NAME_PARTS and sender["field_name"] == "full_name" and sender["start"] <= person["start"] and person["end"] <= sender["end"]


def _settle(accepted: list[dict]) -> None:
    """Runs of mentions that overlap: the best first, each is kept that overlaps no kept one of an incompatible role."""
    run, reach = [], 0
    for c in [*sorted(accepted, key=lambda c: (c["start"], c["end"], c["place"])), None]:
        if run and (c is None or c["start"] >= reach):
            kept: list[dict] = []
            for x in sorted(run, key=_by_strength):
                if any(x["start"] < o["end"] and o["start"] < x["end"] and not _compatible(x, o) for o in kept):
                    x["reason"] = OVERLAP
                else:
                    kept.append(x)
            run = []
        if c is not None:
            run.append(c)
            reach = max(reach, c["end"]) if len(run) > 1 else c["end"]


def resolve(candidates: list[dict], config: MatchingConfig) -> list[dict]:
    """``candidates`` by rank, with place, combined, support, reason (None if accepted), and their number among regions or rejections."""
    rows = sorted(candidates, key=_rank)
    seen, unique = set(), []
    for place, c in enumerate(rows, 1):
        c.update(place=place, combined=None, support=None, reason=None, n=None, reject_ord=None)
        span = c["entity_type"], c["entity_id"], c["field_name"], c["start"], c["end"]
        if span in seen:
            c["reason"] = DUPLICATE
        else:
            seen.add(span)
            unique.append(c)
    _support(unique, config)
    for c in unique:
        bonus = 0.0 if c["field_name"] in COMPOSITES else config.evidence_bonus * max((s["score"] for s in c["support"]), default=0.0)
        c["combined"] = min(1.0, c["score"] + bonus)
    _judge(unique, config)
    _settle([c for c in unique if c["reason"] is None])
    accepted = sorted((c for c in unique if c["reason"] is None), key=lambda c: (c["start"], c["end"], c["entity_type"], c["entity_id"], c["field_name"]))
    for n, c in enumerate(accepted, 1):
        c["n"] = n
    first: dict[tuple, int] = {}
    for c in unique:
        first.setdefault((c["entity_type"], c["start"], c["end"]), c["place"])

    def turn(c: dict) -> tuple:
        if c["reason"] == DUPLICATE:
            return 0, c["place"]
        if c["reason"] == OVERLAP:
            return 2, _by_strength(c)
        return 1, first[c["entity_type"], c["start"], c["end"]], c["place"]

    for n, c in enumerate(sorted((c for c in rows if c["reason"]), key=turn), 1):
        c["reject_ord"] = n
    return rows
