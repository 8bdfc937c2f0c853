import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entitrail.llm import pii

from . import cases

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            s, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p[-6:]) > 255 or len(p.lstrip("0")) > 3 for p in s.split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from(list("a.@-+ 0123456789()%é\n")), max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "5500-0000-0000-0004", "+49 30 1234567", "a@b.c", "1.2.3.4", "256.1.1.1", "@", " ", ".", "x", "1.2.3.4.5.6.7.8"]), max_size=8))
def test_base_spans_of_pieces(pieces):
    assert pii.base_spans("".join(pieces)) == plain("".join(pieces))


def test_long_runs_take_linear_time():
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []
    assert len(pii.base_spans("x@y.z " * 20_000)) == 20_000


def test_query_rows(spark, sf_dir):
    import __spark_entry__ as entry

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = entry.queries()["op3_pii"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        spans = plain(docs[r.doc_id])
        joined = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in spans) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | ({""} if not joined else set())


def test_edges(spark):
    rows = pii.find(cases.frame(spark)).collect()
    got = sorted(str((r.doc_id, [tuple(x) for x in r.spans])) for r in rows)
    assert got == sorted(str((i, plain(t or ""))) for i, t in cases.texts())
    assert pii.find(cases.empty(spark)).count() == 0


def bootstrap(spark):
    known = [f"Please dial the office line +1 (743) 555-{i:04d} today {cases.prose(i, 20)}" for i in range(12)]
    unseen = [f"Please dial the office line (743) 556-{i:04d} today {cases.prose(i, 20)}" for i in range(5)]
    clean = [f"Figures in the table 744 557 {i:04d} were {cases.prose(i, 20)}" for i in range(8)]
    return spark.createDataFrame(list(enumerate(known + unseen + clean)), "doc_id long, text string")


def test_contexts_find_what_patterns_miss(spark):
    found = {r.doc_id: ([tuple(x) for x in r.spans], [tuple(x) for x in r.all_spans]) for r in pii.find(bootstrap(spark)).collect()}
    for i in range(12):
        assert found[i][0] == found[i][1] == [(3, 28, 45)]
    for i in range(12, 17):
        assert found[i] == ([], [(3, 28, 42)])
    for i in range(17, 25):
        assert found[i] == ([], [])


def test_redacted(spark):
    docs = bootstrap(spark)
    rows = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert all(rows[i].startswith("Please dial the office line <PHONE> today") for i in range(17))
    assert rows[20].startswith("Figures in the table 744 557 0003 were")
    edge = cases.frame(spark)
    out = pii.redacted(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    [text] = [r.text for r in out.where("doc_id = 17").collect()]
    assert text == "contact me at <EMAIL> or <PHONE>, server <IP>, card <CARD>"


def all_spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id: [tuple(x) for x in r.all_spans] for r in pii.find(docs).collect()}


def test_lists_and_copies_speak_for_their_pattern(spark):
    line = "the hotline number +1 (743) 555-{:04d} {}"
    lists = [" ".join(line.format(10 * i + j, cases.prose(10 * i + j, 4)) for j in range(4)) for i in range(4)]
    copied = " ".join(line.format(900 + j, cases.prose(900 + j, 4)) for j in range(2))
    unseen = [f"{cases.prose(i, 5)} the hotline number (743) 556-{i:04d} {cases.prose(50 + i, 5)}" for i in range(3)]
    found = all_spans(spark, unseen + lists + [copied] * 100)
    assert all(len(found[i]) == 1 for i in range(3))


def test_found_identifiers_are_seeds_of_further_patterns(spark):
    known = [f"{cases.prose(i, 3)} dial the office line +1 (743) 555-{i:04d} today {cases.prose(i, 5)}" for i in range(30)]
    linked = [f"{cases.prose(i, 3)} dial the office line (743) 556-{i:04d} today {cases.prose(i, 5)} reach support desk (743) 556-{i:04d} anytime" for i in range(14)]
    second = [f"{cases.prose(i, 3)} reach support desk (743) 557-{i:04d} anytime {cases.prose(i, 5)}" for i in range(2)]
    found = all_spans(spark, second + linked + known)
    assert [len(found[i]) for i in range(2)] == [1, 1] and all(len(found[i]) == 2 for i in range(2, 16))


def test_contexts_of_one_word_of_lines_and_after(spark):
    def texts(form, word):
        known = [form.format(f"+1 (743) 555-{word}{i:02d}", cases.prose(i, 6)) for i in range(12)]
        return known, [form.format(f"(743) 556-{word}{i:02d}", cases.prose(30 + i, 6)) for i in range(2)]

    forms = ["Phone: {0}\n{1}", "{1} Mobiltelefon\n{0}\n{1}", "{0} belongs to {1}", "{1}\n{0} extension\n{1}", "{1}\nRufnummer {0}\n{1}"]
    parts = [texts(f, f"{k}7") for k, f in enumerate(forms)]
    unseen = [x for _, own in parts for x in own]
    found = all_spans(spark, unseen + [x for known, _ in parts for x in known])
    assert [len(found[i]) for i in range(len(unseen))] == [1] * len(unseen)


def test_clean_texts_speak_against_a_pattern(spark):
    known = [f"{cases.prose(i, 3)} seen at counter +1 (743) 555-{i:04d} {cases.prose(i, 5)}" for i in range(12)]
    loose = [f"{cases.prose(i, 3)} seen at counter 744 557 {i:04d} {cases.prose(i, 5)}" for i in range(3)]
    clean = [f"{cases.prose(i, 3)} seen at counter {cases.prose(100 + i, 5)}" for i in range(60)]
    found = all_spans(spark, loose + known + clean)
    assert [found[i] for i in range(3)] == [[]] * 3


def plain_trust(texts, accept=0.7, rounds=3, least_seeds=3):
    """The scoring, by its definition, with dicts."""
    graph, known = {}, set()
    for text in texts:
        for m in pii._mentions(text or "")[1]:
            known |= {m["instance"]} if m["seed"] else set()
            for pattern in m["patterns"]:
                graph.setdefault(pattern, set()).add(m["instance"])
    misses = {}
    for text in set(texts):
        own, loose = pii._found(text or "")
        words, starts, _ = pii._words(text or "", own + loose)
        for i, w in enumerate(words):
            for context in pii._contexts(words, starts, i) if w != "\x00" else ():
                misses[context] = misses.get(context, 0) + 1
    trust = {i: float(i in known) for held in graph.values() for i in held}
    wanted = {p: held for p, held in graph.items() if len(held) >= least_seeds and not held <= known}
    accepted = done = 0
    while True:
        done += 1
        p = {}
        for pattern, held in wanted.items():
            if sum(i in known or trust[i] >= accept for i in held) >= least_seeds:
                p[pattern] = sum(trust[i] for i in held) / (len(held) + misses.get(pattern.split("|", 1)[1], 0) + 1)
        new = {}
        for i in trust:
            err = 1.0
            for side in (lambda c: c.endswith(" _"), lambda c: c.startswith(("_ ", "^ _ ")), lambda c: " _ " in c and c[0] != "^"):
                err *= 1 - min(0.999, max((x for q, x in p.items() if i in graph[q] and side(q.split("|", 1)[1])), default=0.0))
            new[i] = 1.0 if i in known else 1 - err
        trust, before = new, accepted
        accepted = sum(t >= accept and i not in known for i, t in trust.items())
        if done >= rounds and accepted == before:
            return {i: t for i, t in trust.items() if i not in known}


def test_scores_equal_a_plain_version(spark):
    texts = [r.text for r in bootstrap(spark).collect()] + [f"mail to jane{i} (at) site{i}.example (dot) org now" for i in range(4)]
    texts += [f"mail to jane{i}@site.example.org now and {cases.prose(i, 6)}" for i in range(5)] + ["mail to nobody now", "dial the office line now"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = pii.mentions(docs).withColumn("row", F.monotonically_increasing_id())
    got = {r.instance: r.trust for r in pii.scored_instances(docs, found, 0.7).collect()}
    want = plain_trust(texts)
    assert set(got) <= set(want) and all(abs(got.get(i, 0.0) - t) < 1e-9 for i, t in want.items()) and max(want.values()) > 0.7


def test_no_form_has_a_longest_length(spark):
    long = "x" * 80
    known = [f"please write to team{i}@mail{i}.example.org today {cases.prose(i, 8)}" for i in range(8)]
    found = all_spans(spark, [f"please write to {long} (at) mail.example (dot) org today {cases.prose(90, 8)}"] + known)
    assert found[0] == [(0, 16, 16 + len(f"{long} (at) mail.example (dot) org"))]


def test_planted_unseen_identifiers(spark):
    """Recall on identifiers of other forms in the contexts of known ones, among clean documents."""
    forms = [("Hotline: {0}", "+1 (743) 555-{:04d}", "(743) 556 {:04d}"), ("reach me under {0} please", "kim.{}@example.com", "kim.{} [at] example [dot] com"), ("from host {0} port", "10.1.2.{}", "fe80:0:0:{}:1:2:3:4"), ('token = "{0}" end', "9b0b3c6a43eb78aa99cb{:04d}", None), ("session key {0} expires", None, "8e5f278dec875d2b96fd{:04d}")]
    known = [f"{cases.prose(i, 5)}\n{form.format(seen.format(i))}\n{cases.prose(i + 50, 9)}" for form, seen, _ in forms if seen for i in range(12)]
    unseen = [f"{cases.prose(200 + i, 5)}\n{form.format(other.format(i))}\n{cases.prose(250 + i, 9)}" for form, _, other in forms[:3] for i in range(5)]
    clean = [cases.prose(i, 30) + (f" in {1000 + i} places" if i % 3 else "") for i in range(300, 360)]
    found = all_spans(spark, unseen + known + clean)
    assert sum(len(found[i]) == 1 for i in range(len(unseen))) >= 0.9 * len(unseen)
    assert all(len(found[len(unseen) + i]) == 1 for i in range(len(known)))
    assert not any(found[len(unseen) + len(known) + i] for i in range(len(clean)))


def test_secrets(spark):
    assert pii.secrets('TOKEN = "9233A8ECF7C5B09FE594"!!') == [(4, 9, 29)] and pii.secrets("token = internationalization") == []
    docs = spark.createDataFrame([(1, 'a token = "04dbebab91ab85687d33eeaa" b', "x"), (2, "none", "y")], "doc_id long, text string, more_spans string")
    assert [r.text for r in pii.redacted(docs).orderBy("doc_id").collect()] == ['a token = "<SECRET>" b', "none"]
