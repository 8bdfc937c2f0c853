"""Personal data: fixed patterns per kind, and bootstrapped contextual extraction of what they miss.

Base spans are the leftmost non-overlapping matches of a kind's pattern that pass its check. They are the seeds; values
that are assigned to a name like token or password are the seeds of a fifth kind, secret, which has no base spans. The
words around a span are its lexical patterns: one or two words before it or after it (across line breaks, and marked at
the start or end of a line), and the word before with the word after. The same contexts around loosely shaped
identifiers (no valid checksum, spelled-out separators, no country code) make a graph of patterns and instances. Spark
scores it in rounds: a pattern is trusted by the mean trust of its distinct instances, counting each place in all
distinct texts where its words stand around anything but a mention as an instance without trust; an instance is trusted
unless its best patterns before, after and around it all err (1 - product of 1 - trust); seeds stay at 1. Instances that
reach ``accept`` are seeds of further patterns, and rounds go on until none is added. Those that end above ``accept``
give further spans of their kind, wherever they occur in a scored context. No form, word or list has a longest length.

Texts are read twice, for spans with contexts and for the places that speak against contexts. Sums are made before the
shuffle, so a pattern or an instance with a third of all rows is no hot key there; the score tables that joins look up
are written tables.

Defined cases: a null or empty text has no spans; ``doc_id`` may be null or repeat, each row gives a row; an empty
table gives no rows; other columns are ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import mul

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_slices, free_names, spread, table, text_slices, written

KINDS = ("email", "ip", "card", "phone")
NAMES = (*KINDS, "secret")
SECRET = len(KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match that starts inside a run of digits would also start at the run's first digit, so only that is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[] ?at ?[)\]]")
#: A value that is assigned to the name of a secret.
_ASSIGNED = re.compile(r"(?<![^\W_])(?:token|secret|passwo?r?d|pwd|api[_-]?key|access[_-]?key|auth)[\"']?[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_+/=-]{16,})", re.IGNORECASE)
#: Loose shapes of what contexts may confirm; an email's is found from its sign to both sides.
_SIGN = re.compile(r"@| ?[(\[] ?at ?[)\]] ?")
_NAME = frozenset(".%+-_")
_HOST = re.compile(r"[\w-]+(?:(?:\.| ?[(\[] ?dot ?[)\]] ?)[\w-]+)*")
_LOOSE = (
    (1, re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    (2, re.compile(r"(?<![\w.+-])[0-9](?:[ ./-]?[0-9]){11,18}(?![\w-])")),
    (3, re.compile(r"(?<![\w.+-])\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,14}(?![\w-])")),
    (SECRET, re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}(?![A-Za-z0-9_+/=-])")),
)
#: A word, with the sign that makes it a label; a mention's mark; line breaks.
_WORD = re.compile(r"[^\W_]+[:=#]?|\x00|\n\s*")
#: Patterns before, after and around a place; those on one side hold each other.
_SIDES = (r" _$", r"\|(\^ )?_ ", r"[^|^] _ ")
#: Contexts that a pass over the texts looks for.
AT_ONCE = 200_000

_SPAN = "struct<kind:int,start:int,end:int>"
_MENTION = "struct<kind:int,start:int,end:int,instance:string,patterns:array<string>,seed:boolean>"
_ROW = f"doc_id long, spans array<{_SPAN}>, mentions array<{_MENTION}>"


def _luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return (sum(map(int, digits[-1::-2])) + sum(double[int(x)] for x in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ to both sides: the local part is what is left of the run before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def secrets(text: str) -> list[tuple[int, int, int]]:
    return [(SECRET, *m.span(1)) for m in _ASSIGNED.finditer(text) if _mixed(m.group(1))]


def _loose_emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in _SIGN.finditer(text):
        start = m.start()
        while start > end and (text[start - 1].isalnum() or text[start - 1] in _NAME):
            start -= 1
        host = _HOST.match(text, m.end()) if start < m.start() else None
        if host:
            end = host.end()
            out.append((start, end))
    return out


def _loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loosely shaped spans that touch no base span and no span of a kind before."""
    used = sorted((a, b) for _, a, b in taken)
    out = []
    found = itertools.chain(((0, a, b) for a, b in _loose_emails(text)), ((kind, *m.span()) for kind, pattern in _LOOSE for m in pattern.finditer(text)))
    for kind, a, b in found:
        if kind == SECRET and not _mixed(text[a:b]):
            continue
        i = bisect.bisect_left(used, (a, b))
        if (i < len(used) and used[i][0] < b) or (i and used[i - 1][1] > a):
            continue
        used.insert(i, (a, b))
        out.append((kind, a, b))
    return out


def _found(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Seeds, base spans first, and loose spans."""
    if not _ANY.search(text):
        return [], []
    own = base_spans(text) + secrets(text)
    return own, _loose_spans(text, own)


def _words(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[str], set[int], dict[tuple[int, int], int]]:
    """Words with a mark for each span (one for those that overlap), which of them start a line, and the spans' marks by number."""
    parts, at, number = [], 0, {}
    text = text.replace("\x00", " ")
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        if a >= at:
            parts += (text[at:a], "\x00")
        number[a, b] = len(parts) // 2 - 1
        at = max(at, b)
    words, starts = [], {0}
    for word in _WORD.findall(re.sub(r"[0-9]", "9", "".join([*parts, text[at:]]).lower())):
        if word[0] == "\n":
            starts.add(len(words))
        else:
            words.append(word)
    return words, starts, number


def _contexts(words: list[str], starts: set[int], i: int) -> list[str]:
    """What stands around place ``i``, which is written as _, across line breaks; ^ is the start of a line, $ its end."""
    out = []
    if i > 0:
        if i > 1:
            out.append(f"{words[i - 2]} {words[i - 1]} _")
        if i + 1 < len(words):
            out.append(f"{words[i - 1]} _ {words[i + 1]}")
        out.append(f"{words[i - 1]} _")
        if i - 1 in starts:
            out.append(f"^ {words[i - 1]} _")
    if i + 1 < len(words):
        out.append(f"_ {words[i + 1]}")
        if i in starts:
            out.append(f"^ _ {words[i + 1]}")
        if i + 2 < len(words):
            out.append(f"_ {words[i + 1]} {words[i + 2]}")
        if i + 2 in starts or i + 2 == len(words):
            out.append(f"_ {words[i + 1]} $")
    return out


def _mentions(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans; mentions."""
    own, loose = _found(text)
    both = [(x, True) for x in own] + [(x, False) for x in loose]
    if not both:
        return [], []
    words, starts, number = _words(text, own + loose)
    marks = [i for i, w in enumerate(words) if w == "\x00"]
    out = []
    for (kind, a, b), seed in both:
        patterns = [f"{NAMES[kind]}|{c}" for c in _contexts(words, starts, marks[number[a, b]])]
        instance = NAMES[kind] + "|" + re.sub(r"[\s().\-/]", "", text[a:b]).lower()
        out.append({"kind": kind, "start": a, "end": b, "instance": instance, "patterns": patterns, "seed": seed})
    return [{"kind": k, "start": a, "end": b} for k, a, b in own if k < SECRET], out


def mentions(docs: DataFrame) -> DataFrame:
    """A row per document: its base spans, and the mentions (seeds and loose spans with contexts) that scoring needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
        mention = pa.struct([*span, ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_())])
        for doc_ids, texts in text_slices(batches):
            spans, found = zip(*map(_mentions, texts)) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(mention))], names=["doc_id", "spans", "mentions"])

    return spread(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(run, _ROW)


def _counted(text: str, contexts: frozenset[str], before: frozenset[str], after: frozenset[str]) -> Counter:
    """How often each of ``contexts`` stands around something that is no mention; one of its inner words is in ``before`` or ``after``."""
    own, loose = _found(text)
    words, starts, _ = _words(text, own + loose)
    places = {i + 1 for i, w in enumerate(words) if w in before} | {i - 1 for i, w in enumerate(words) if w in after}
    places = [i for i in places if 0 <= i < len(words) and words[i] != "\x00"]
    return Counter(c for i in places for c in _contexts(words, starts, i) if c in contexts)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of lists of (context, x)."""
    sums: Counter = Counter()
    for batch in batches:
        found = batch.column(0).flatten()
        for context, x in zip(found.field("context").to_pylist(), found.field("x").to_pylist()):
            sums[context] += x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["context", "x"])


def misses(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(context, x): how often each of ``wanted`` (context) stands around something that is no mention, in distinct texts.

    Contexts go to every task, AT_ONCE of them; more take several passes, so the broadcast does not grow with them.
    """
    spark = docs.sparkSession
    texts = spread(docs.select(F.xxhash64("text").alias("h"), "text").where("text is not null"))
    passes = -(-wanted.count() // AT_ONCE)
    out = None
    for k in range(passes):
        contexts = frozenset(r.context for r in wanted.where(F.pmod(F.xxhash64("context"), F.lit(passes)) == k).collect())
        split = [c.split(" ") for c in contexts]
        at = [c.index("_") for c in split]
        before = frozenset(c[i - 1] for c, i in zip(split, at) if i and c[i - 1] != "^")
        after = frozenset(c[i + 1] for c, i in zip(split, at) if not i or c[i - 1] == "^")
        shared = spark.sparkContext.broadcast((contexts, before, after))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("context", pa.string()), ("x", pa.int32())]))
            for hashes, texts in text_slices(batches):
                counts = [(h, c) for h, c in zip(hashes, (_counted(x, *shared.value) for x in texts)) if c]
                found = [[{"context": c, "x": n} for c, n in own.items()] for _, own in counts]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in counts], pa.int64()), pa.array(found, kind)], names=["h", "found"])

        # copies of a text count once
        once = texts.mapInArrow(run, "h long, found array<struct<context:string,x:int>>").groupBy("h").agg(F.first("found").alias("found"))
        part = written(once.select("found").mapInArrow(_summed, "context string, x long").groupBy("context").agg(F.sum("x").alias("x")), "pii-misses")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "context string, x long")


def scored_instances(docs: DataFrame, found: DataFrame, accept: float, rounds: int = 3, least_seeds: int = 3) -> DataFrame:
    """(instance, trust) of the instances that are no seeds and that a trusted pattern holds.

    Trust never falls from round to round, so the seeds only grow; after ``rounds``, the first round without a new one is the last.
    """
    graph = found.selectExpr("inline(mentions)").selectExpr("explode(patterns) pattern", "instance", "seed")
    graph = graph.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    # an instance that is a seed anywhere is one everywhere
    seeds = graph.groupBy("instance").agg(F.max("seed").alias("known"))
    graph = written(graph.join(written(seeds, "pii-seeds"), "instance").select("pattern", "instance", "known"), "pii-graph")
    # others than these confirm nothing
    wanted = graph.groupBy("pattern").agg(F.count("*").alias("n"), F.min("known").alias("all_known")).where(F.expr(f"n >= {least_seeds} and not all_known"))
    wanted = written(wanted.select("pattern", F.substring_index("pattern", "|", -1).alias("context")), "pii-wanted")
    counts = wanted.join(misses(docs, wanted.select("context").distinct()), "context", "left").select("pattern", F.coalesce("x", F.lit(0)).alias("x"))
    graph = written(graph.join(written(counts, "pii-counts"), "pattern", "left"), "pii-graph")
    trust = written(graph.select("instance", F.col("known").cast("double").alias("trust")).distinct(), "pii-trust")
    accepted = 0
    for done in itertools.count(1):
        patterns = graph.where("x is not null").join(trust, "instance").groupBy("pattern").agg(F.sum("trust").alias("s"), F.count("*").alias("n"), F.first("x").alias("x"), F.count_if(F.col("known") | (F.col("trust") >= accept)).alias("seeds"))
        patterns = patterns.where(F.col("seeds") >= least_seeds).selectExpr("pattern", "s / (n + x + 1) p")
        by = graph.join(written(patterns, "pii-patterns"), "pattern", "left").groupBy("instance")
        err = reduce(mul, (1 - F.least(F.coalesce(F.max(F.when(F.col("pattern").rlike(side), F.col("p"))), F.lit(0.0)), F.lit(0.999)) for side in _SIDES))
        trust = written(by.agg(F.max("known").alias("known"), (1 - err).alias("t")).selectExpr("instance", "if(known, 1D, t) trust", "known"), "pii-trust")
        before, accepted = accepted, trust.where((F.col("trust") >= accept) & ~F.col("known")).count()
        trust = trust.drop("known")
        if done >= rounds and accepted == before:
            break
    return trust.join(graph.where("not known").select("instance").distinct(), "instance", "left_semi")


def find(docs: DataFrame, accept: float = 0.7) -> DataFrame:
    """(doc_id, spans, all_spans): base spans, and these with secrets and the ones that contexts confirm; by kind, then start."""
    found = written(mentions(docs).withColumn("row", F.monotonically_increasing_id()), "pii-mentions")
    good = written(scored_instances(docs, found, accept).where(F.col("trust") >= accept).select("instance"), "pii-found")
    rest = found.selectExpr("row", "inline(mentions)").where(f"not seed or kind = {SECRET}")
    loose = rest.where("seed").unionByName(rest.where("not seed").join(good, "instance", "left_semi"))
    more = loose.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    both = found.select("row", "doc_id", "spans").join(written(more, "pii-more"), "row", "left")
    return both.select("doc_id", "spans", F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(f"array<{_SPAN}>")))).alias("all_spans"))


def confirmed(docs: DataFrame, accept: float = 0.7) -> DataFrame:
    """(text_hash, more): the spans that contexts add, by the text's xxhash64, for texts that have any."""
    hashed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = find(hashed, accept).where(F.size("all_spans") > F.size("spans"))
    return found.groupBy(F.col("doc_id").alias("text_hash")).agg(F.first(F.array_except("all_spans", "spans")).alias("more"))


def redacted(docs: DataFrame, accept: float = 0.7) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind's name in angle brackets; all columns and rows stay.

    Base spans are found anew as texts pass by; only texts with added spans are looked up.
    """
    more = written(confirmed(docs, accept), "pii-confirmed")
    own, extra = free_names(docs, "key_hash", "more_spans")
    joined = docs.withColumn(own, F.xxhash64("text")).join(more.withColumnsRenamed({"text_hash": own, "more": extra}), own, "left").drop(own)
    at, columns = docs.columns.index("text"), docs.columns
    joined = joined.select(*(F.col(f"`{c}`") for c in columns), extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in column_slices(batches, at):
            texts = [_masked(x, added) for x, added in zip(part.column(at).to_pylist(), part.column(len(columns)).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, part.column(at).type) if i == at else part.column(i) for i in range(len(columns))], names=columns)

    return joined.mapInArrow(run, docs.schema)


def _masked(text: str | None, extra: list | None) -> str | None:
    if text is None or (extra is None and not _ANY.search(text)):
        return text
    spans = base_spans(text) + [(x["kind"], x["start"], x["end"]) for x in extra or ()]
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if a >= end:
            out += (text[end:a], f"<{NAMES[kind].upper()}>")
        end = max(end, b)  # of overlapping spans, the first names the whole
    return "".join([*out, text[end:]])


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    counts += [F.size(F.filter("all_spans", lambda x: x["kind"] == SECRET)).cast("long").alias("n_secret"), F.size("all_spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(_joined("spans").cast("binary"), 256).alias("base_sha256"), _joined("all_spans").alias("spans"))
