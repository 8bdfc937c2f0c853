from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from entitrail.llm import langid, toxicity
from entitrail.llm.common import in_training

from . import cases

SF = "/root/testdata/sf0.1"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = langid.op8_language_id(spark, SF).join(docs, "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).head()[0]
    assert right >= 0.98 and found.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    docs = cases.frame(spark)
    rows = langid.identify(docs, langid.fit(docs, F.lit(True))).collect()
    letters = sorted(str((i, any(c.isalpha() for c in t or ""))) for i, t in cases.texts())
    assert sorted(str((r.doc_id, r.lang_pred != "und")) for r in rows) == letters
    assert {r.lang_pred for r in rows} <= {"und", "en", "de"}
    assert langid.fit(cases.empty(spark), in_training()) is None
    assert langid.identify(cases.empty(spark), None).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    kept = langid.kept_rows(docs, langid.fit(docs, F.lit(True)))
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)


def test_presence_reads_whole_texts():
    long = "a" * (1 << 20) + "b" * 10
    assert (langid.presence([long], 1 << 12)[0] == langid.presence(["aaaabbbb"], 1 << 12)[0]).all()


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.op7_toxicity(spark, SF).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.score for r in rows if r.toxic]
    ordinary = [r.score for r in rows if not r.toxic]
    above = np.mean([[a > b for b in ordinary] for a in toxic])
    assert above >= 0.92
    assert np.mean([r.predicted for r in rows if r.toxic]) >= 0.7 and np.mean([r.predicted for r in rows if not r.toxic]) <= 0.04
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_edges(spark):
    docs = cases.frame(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    some = spark.createDataFrame([(i, i % 2, 1) for i in range(20)] + [(1, None, 1), (None, 1, 1), (2, 1, 0), (2, 0, 0)], "doc_id long, toxic int, quality int")
    rows = toxicity.scored(docs, some).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in cases.texts()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(cases.empty(spark), some).count() == 0


def plain_kneser_ney(counted, word, order=5, discount=0.75, shared=2):
    """log P(word) per class by the definition, with dicts of strings; ``counted`` is a Counter of words per class."""
    grams = [Counter(), Counter()]
    for own, of in zip(grams, counted):
        for w, n in of.items():
            marked = "\x01" + w + "\x02"
            for i in range(1, len(marked)):
                for k in range(1, min(order, i + 1) + 1):
                    own[marked[i - k + 1 : i + 1]] += n

    def used(c, g):
        if len(g) == order or g[0] == "\x01":
            return grams[c][g]
        return len({x for x in grams[c] if len(x) == len(g) + 1 and x[1:] == g})

    def count(c, g):
        return used(0, g) + used(1, g) if len(g) <= shared else used(c, g)

    def prob(c, h, x):
        if h is None:
            return 1 / toxicity.LETTERS
        after = [count(c, g) for g in {*grams[0], *grams[1]} if len(g) == len(h) + 1 and g[:-1] == h]
        total, lower = sum(after), prob(c, h[1:] if h else None, x)
        if not total:
            return lower
        return max(count(c, h + x) - discount, 0) / total + discount * sum(n > 0 for n in after) / total * lower

    marked = "\x01" + word + "\x02"
    return [sum(np.log(prob(c, marked[max(0, i - order + 1) : i], marked[i])) for i in range(1, len(marked))) for c in (0, 1)]


WORDS = [Counter({"abba": 5, "abc": 3, "cab": 2, "babble": 1}), Counter({"abba": 1, "bad": 4, "badly": 2})]


def models_of(spark, counted, **options):
    texts = [(c, " ".join([w] * n)) for c in (0, 1) for w, n in counted[c].items()]
    grams = toxicity.gram_counts(spark.createDataFrame(texts, "which int, text string").repartition(3))
    rows = toxicity.model_rows(grams, False, **options).toArrow()
    return rows, toxicity.Models(rows.column("g").to_pylist(), np.stack([rows.column(c).to_numpy() for c in ("s0", "s1", "b0", "b1")], axis=1))


def test_models_equal_plain_kneser_ney(spark):
    _, models = models_of(spark, WORDS)
    names = ["abba", "bad", "cab", "badly", "abbad", "zzz", "a", "babbab", "xbad"]
    plain = [plain_kneser_ney(WORDS, w) for w in names]
    assert np.allclose(models.ratios(names), [b - a for a, b in plain], rtol=1e-5, atol=1e-5)
    assert models.ratios(["bad", "", "abc"])[1] == 0 and models.ratios(["bad"])[0] > 0 > models.ratios(["abc"])[0]
    ratio = models.ratios(["bad", "abba"])
    assert np.isclose(models.evidence(["Bad! abba"])[0], np.log(np.mean(np.exp(ratio)))) and models.evidence([""])[0] == 0


def test_probabilities_sum_to_one_with_and_without_cut_offs(spark):
    for least in (1, 3):
        rows, _ = models_of(spark, WORDS, least=least)
        share, back = {}, {}
        for r in rows.to_pylist():
            back[r["g"]] = (r["b0"], r["b1"])
            for c in (0, 1):
                if r["g"]:
                    share[c, r["g"][:-1]] = share.get((c, r["g"][:-1]), 0) + r[f"s{c}"]
        assert all(abs(s + back[h][c] - 1) < 1e-12 for (c, h), s in share.items())
    assert max(map(len, back)) >= 3


def test_counts_are_exact_for_large_alphabets(spark):
    word = lambda i: chr(0x4E00 + i % 5000) + chr(0x4E00 + (7 * i) % 5000)
    counted = [Counter({word(i): 1 + i % 3 for i in range(6000)}), Counter({word(i): 2 for i in range(100)})]
    grams, counts = toxicity.gram_counts_of([*counted, Counter(), Counter()])
    own: dict[str, list] = {}
    for g, c in zip(grams, counts):
        own.setdefault(g, []).append(c)
    plain = Counter()
    for w, n in counted[0].items():
        plain[w[0]] += n
        plain[w[1]] += n
    assert all(sum(c[0] for c in own[x]) == n for x, n in plain.items())


def plain_kernel_ridge(train, langs, texts, landmarks, ridge=1.0):
    """Outputs by the definition: sets of n-grams, cosine kernel, Nystroem features from K(L, L)^-1/2, ridge per language."""
    sets = lambda x: set(np.flatnonzero(langid.presence([x], langid.BINS)[0]).tolist())
    kernel = lambda a, b: len(a & b) / max(1.0, (len(a) * len(b)) ** 0.5)
    x, q = [sets(t) for t in train], [sets(t) for t in texts]
    z = x[:landmarks]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in z] for a in z]))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi, new = (np.array([[kernel(a, b) for b in z] for a in rows]) @ root for rows in (x, q))
    names = sorted(set(langs))
    out = []
    for name in names:
        y = np.array([1.0 if lang == name else -1.0 for lang in langs])
        w = np.array([1 / langs.count(lang) for lang in langs])
        w *= len(langs) / w.sum()
        centre = (w * y).mean()
        mean = phi.mean(axis=0)
        a = (phi - mean).T @ np.diag(w) @ (phi - mean) + ridge * np.eye(len(z))
        out.append((new - mean) @ np.linalg.solve(a, (phi - mean).T @ (w * (y - centre))) + centre)
    return np.array(out).T


def test_folded_matrix_equals_plain_kernel_ridge():
    train = [f"{cases.prose(i, 30)}" if i % 3 else "und der die das nicht ein eine " * (1 + i % 4) + cases.prose(i, 3) for i in range(40)]
    langs = ["en" if i % 3 else "de" for i in range(40)]
    texts = [cases.prose(99, 12), "nicht die eine und der", "", "xyz"]
    bits = np.packbits(langid.presence(train, langid.BINS) > 0, axis=1)
    model = langid.fit_kernel_ridge(bits, langs, 12)
    assert np.allclose(model.outputs(texts), plain_kernel_ridge(train, langs, texts, 12), atol=1e-4)
    p = model.score(texts)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == model.outputs(texts).argmax(axis=1)).all()


def test_rows_of_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, in_training())
    r = __import__("random").Random(2)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
    foreign = [" ".join(word(letters) for _ in range(60)) for letters in ("абвгдежзиклмнопрстуфхцчшщыьэюя", "bcdfghjklmnpqrstvwxz", "αβγδεζηθικλμνξοπρστυφχψω")]
    own = [x.text for x in docs.select("text").limit(300).collect()]
    rows = spark.createDataFrame(list(enumerate(foreign + own + ["Да, это так.", "1234 !!"])), "doc_id long, text string")
    kept = {x.doc_id for x in langid.kept_rows(rows, model).collect()}
    lettered = {3 + i for i, x in enumerate(own) if any(c.isalpha() for c in x)}
    assert kept == lettered | {3 + len(own)}  # a short text says too little to be rejected
    english = langid.kept_rows(docs, model, ["en"])
    wrong = english.where("lang <> 'en'").count()
    assert english.where("lang = 'en'").count() >= 0.97 * docs.where("lang = 'en'").count() and wrong <= 0.02 * docs.count()


def test_long_words_are_read_whole():
    assert "".join(toxicity.words("x" * 2000 + "Moron")) == "x" * 2000 + "moron"


def _folds(spark, toxic_folds):
    """Texts of both classes in folds 0 to 3, the toxic ones only labelled in some."""
    import zlib

    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    rows = [(i, cases.prose(i, 20) + (" vilescum rotscum" if i % 10 == 0 else " kindly thanks")) for i in range(600)]
    labels = [(i, int(i % 10 == 0)) for i, _ in rows if fold(i) != 2 and (i % 10 or fold(i) in toxic_folds)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_rows_are_told_without_any_in_the_regression(spark):
    docs, labels = _folds(spark, (0, 1))
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    assert np.mean([scores[i] >= toxicity.THRESHOLD for i in range(0, 600, 10)]) >= 0.9
    assert np.mean([scores[i] >= toxicity.THRESHOLD for i in range(600) if i % 10]) <= 0.1


def test_the_regression_samples_each_class(spark):
    docs, labels = _folds(spark, (0, 1, 3))
    absent = spark.createDataFrame([(i, 0) for i in range(10_000, 40_000)], "doc_id long, toxic int")
    found = toxicity.fit(docs, labels.unionByName(absent), sample=8)
    assert isinstance(found, toxicity.Scorer) and found.slope != 1.0


def test_a_large_model_gives_the_scores_of_the_whole_model(spark):
    docs, labels = _folds(spark, (0, 1, 3))
    whole = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    joined = {r.doc_id: r.score for r in toxicity.scored(docs, labels, most_grams=50).collect()}
    assert whole.keys() == joined.keys() and all(abs(whole[i] - s) < 1e-6 for i, s in joined.items())


def test_blocks_meet_all_of_their_ngrams(spark):
    rows, models = models_of(spark, WORDS)
    frame = spark.createDataFrame(rows.to_pylist(), "g string, s0 double, s1 double, b0 double, b1 double")
    docs = cases.frame(spark).unionByName(spark.createDataFrame([(50 + i, w + "! abba xbad") for i, w in enumerate(("badly", "cab", "zzz"))], "doc_id long, text string"), True)
    then = lambda part, e: toxicity.pa.RecordBatch.from_arrays([part.column("doc_id"), toxicity.pa.array(e)], names=["doc_id", "e"])
    plain = sorted((str(r.doc_id), round(models.evidence([r.text or ""])[0], 4)) for r in docs.collect())
    for bounds in ({}, {"block_words": 1}):
        found = toxicity.in_blocks(docs, frame, then, "doc_id long, e double", **bounds).collect()
        assert sorted((str(r.doc_id), round(r.e, 4)) for r in found) == plain


def test_lettered_rows_stay_when_nothing_could_be_learned(spark):
    docs = spark.createDataFrame([(0, "some words", None), (1, "12 34", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.kept_rows(docs, langid.fit(docs, F.lit(True))).collect()] == [0]
