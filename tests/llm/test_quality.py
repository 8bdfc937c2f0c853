import re

from entitrail.llm import quality

from . import cases


def plain(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + j for p in places for j in range(5)}
    n, repeats = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats, n < 10 or 100 * repeats > 20 * n


def check(docs, expected):
    rows = quality.judged(docs).collect()
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows)
    assert got == sorted(str((i, *plain(t or ""))) for i, t in expected)
    assert not any(r.kept and r.base_failed for r in rows) and all(r.kept is not None for r in rows)


def test_measures(spark, sf_dir):
    extra = [(100, "a b c d e f a b c d e\nx y\nx y\n\nx y z x y z x y z"), (101, "w " * 5000), (102, "#*$%&|<> ! …\n• x"), (103, " ".join(str(i % 97) for i in range(4000)))]
    docs = cases.frame(spark).select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    check(docs, cases.texts() + extra)
    check(cases.empty(spark), [])
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(table, [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])


def test_rules(spark):
    clean = cases.prose(7, 200).replace(" ", " the ", 40)
    rows = [(1, clean), (2, " ".join(w + "***" for w in clean.split())), (3, "\n".join([clean[:60]] * 20)), (4, "\n".join(f"{x} ..." for x in clean.split(" the "))), (5, " ".join(str(i) for i in range(300)))]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_no_user_functions(spark):
    plan = quality.judged(cases.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_labelled_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").join(quality.judged(spark.read.parquet(f"{d}/documents.parquet")), "doc_id")
    good = labels.where("quality = 1 and not base_failed")
    assert good.where("kept").count() >= 0.98 * good.count()
    assert labels.where("quality = 0 and not kept").count() >= 0.5 * labels.where("quality = 0").count()
