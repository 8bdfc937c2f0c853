import json

from entitrail.config import MatchingConfig
from entitrail.operators.boundaries import bounded
from entitrail.plans import marking as plans
from entitrail.plans.marking import mark
from entitrail.sources.catalog import catalog_frame, checked


def marked(spark, text, catalog, config=None, inflector=None):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return mark(docs, catalog_frame(spark, [("c", checked(catalog))]), config, inflector)


def found(spark, text, catalog, config=None):
    rows = marked(spark, text, catalog, config).occurrences.orderBy("n").collect()
    return [(r.start, r.end, f"{r.entity_type}.{r.field_name}", round(r.score, 6), r.method, r.edit_distance) for r in rows]


def hits(spark, texts, catalog, config=None):
    """Whether each text has an occurrence."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = mark(docs, catalog_frame(spark, [("c", checked(catalog))]), config).occurrences.select("doc_id").distinct().collect()
    return [i in {r.doc_id for r in rows} for i in range(len(texts))]


CAR = {"cars": [{"id": "c", "vin": "WQ9MTRDVK20417365", "license_plate": "Е507КН96"}]}


def test_plate_and_vin(spark):
    text = "Грузовики: Е 507 КН 96 с VIN WQ9MTR0VK20417365."
    assert found(spark, text, CAR) == [(11, 22, "car.license_plate", 1.0, 1, 0), (29, 46, "car.vin", 1.0, 2, 1)]


def test_no_plate(spark):
    texts = ["xxЕ507КН96yy", "Е 507\nКН 96", "Е        507КН96", "Е507КН9"]
    assert not any(hits(spark, texts, CAR, MatchingConfig(fuzzy_enabled=False)))


def test_email(spark):
    texts, expected = zip(*[("desk@letters.test", True), ("DESK@letters.test.", True), ("xdesk@letters.test", False), ("desk@letters.test.ru", False), ("a.desk@letters.test", False), ("desk@letters.test-other", False)])
    assert hits(spark, texts, {"miscellaneous": [{"id": "m", "reply_email": "desk@letters.test"}]}) == [*expected]


def test_tax_id(spark):
    texts, expected = zip(*[("ИНН 5402118836", True), ("ИНН 54 02 118836", True), ("ИНН 5402118837", False)])
    assert hits(spark, texts, {"legal_entities": [{"id": "l", "inn": "5402118836"}]}) == [*expected]


def test_case_number(spark):
    texts, expected = zip(*[("A57-31184/2023", True), ("a57-31184/23", True), ("31184/2023", True), ("31184 / 23", True), ("дело A57 - 31184/2023", True), ("B1-A57-31184/2023", False), ("31184/2023/1", False)])
    assert hits(spark, texts, {"miscellaneous": [{"id": "m", "case_number": "A57-31184/2023"}]}, MatchingConfig(fuzzy_enabled=False)) == [*expected]


def test_birth_date_suffix(spark):
    docs = spark.createDataFrame([(i, f"род. 14.06.1981{x}") for i, x in enumerate(["", "г", "г.", " г.", "года", " года рождения", "г.р.", "год"])], "doc_id long, text string")
    person = {"people": [{"id": "p", "birth_date": "1981-06-14"}]}
    rows = mark(docs, catalog_frame(spark, [("c", checked(person))])).occurrences.collect()
    assert sorted((r.doc_id, r.start, r.end) for r in rows) == [(i, 5, 15) for i in range(docs.count())]


def test_birth_date_misread(spark):
    person = {"people": [{"id": "p", "birth_date": "14.06.1981"}]}
    assert hits(spark, ["14.O6.1981", "14.O6.198B"], person) == [True, False]


def test_ambiguity_and_evidence(spark):
    people = {"people": [{"id": "a", "first_name": "Андрей", "last_name": "Лыков"}, {"id": "b", "first_name": "Олег", "last_name": "Лыков"}]}
    assert found(spark, "Лыков уехал", people) == []
    one = marked(spark, "Лыков, зовут Андрей", people).occurrences.collect()
    assert {r.entity_id for r in one} == {"a"} and {r.field_name for r in one} == {"first_name", "last_name"}
    assert found(spark, "Лыков. Зовут Андрей", people) == []


def test_threshold_and_weights(spark):
    person = {"people": [{"id": "p", "first_name": "Андрей"}]}
    assert found(spark, "Андрей", person) == []
    assert found(spark, "WQ9MTRDVK20417365", CAR, MatchingConfig(field_weights={"vin": 0.2})) == []


def test_overlap_and_roles(spark):
    catalog = {"people": [{"id": "p", "last_name": "Громов", "first_name": "Павел"}], "senders": [{"id": "s", "full_name": "Громов Павел"}]}
    assert {x[2] for x in found(spark, "от Громов Павел", catalog)} == {"person.last_name", "person.first_name", "sender.full_name"}
    rivals = {"legal_entities": [{"id": "a", "name": "Север Восток"}, {"id": "b", "name": "Восток Юг Запад"}]}
    assert [x[:2] for x in found(spark, "Север Восток Юг Запад", rivals)] == [(6, 21)]
    reasons = [r.reason for r in marked(spark, "Север Восток Юг Запад", rivals).rejected.collect()]
    assert "overlap with stronger occurrence" in reasons


def test_repeats_shift(spark):
    passage = "VIN WQ9MTRDVK20417365, Е 507 КН 96\n"
    once = found(spark, passage, CAR)
    thrice = found(spark, passage * 3, CAR)
    assert thrice == [(a + i * len(passage), b + i * len(passage), *x) for i in range(3) for a, b, *x in once]


def test_catalog_order_does_not_matter(spark):
    people = [{"id": "a", "last_name": "Лыков"}, {"id": "b", "last_name": "Зимин"}]
    assert found(spark, "Лыков и Зимин", {"people": people}) == found(spark, "Лыков и Зимин", {"people": people[::-1]})


def test_inflected(spark):
    person = {"people": [{"id": "p", "first_name": "Андрей", "last_name": "Зимогоров"}]}
    assert all(hits(spark, ["Зимогоров", "Зимогорова", "Зимогорову", "Зимогоровым", "Зимогорове"], person, MatchingConfig(fuzzy_enabled=False)))


def test_exports(spark):
    m = marked(spark, "VIN WQ9MTRDVK20417365", CAR)
    task = json.loads(m.predictions().head().task)
    assert task["data"] == {"text": "VIN WQ9MTRDVK20417365"}
    assert task["predictions"][0]["result"] == [{"id": "r000001", "from_name": "entities", "to_name": "text", "type": "labels", "value": {"start": 4, "end": 21, "text": "WQ9MTRDVK20417365", "labels": ["CAR_VIN"]}}]
    assert json.loads(m.annotations().head().task)["annotations"][0]["result"]
    report = json.loads(m.evidence().head().report)
    assert report["schema_version"] == 1 and report["occurrences"][0]["region_id"] == "r000001" and report["occurrences"][0]["score"] == 1
    nothing = marked(spark, "nothing here", CAR)
    assert json.loads(nothing.predictions().head().task)["predictions"][0]["result"] == []
    assert json.loads(nothing.evidence().head().report)["occurrences"] == []


def test_many_aliases_take_passes(spark, monkeypatch):
    text = "VIN WQ9MTRDVK20417365, Е 507 КН 96"
    once = found(spark, text, CAR)
    monkeypatch.setattr(plans, "ALIASES_PER_PASS", 2)
    catalog = {"cars": [*CAR["cars"], {"id": "d", "vin": "ZZZ", "license_plate": "YYY", "body_number": "Q1"}]}
    assert found(spark, text, catalog) == once


def test_passes_with_ties_equal_one_pass(spark, monkeypatch):
    catalog = {"people": [{"id": i, "last_name": "Лыков", "first_name": "Андрей"} for i in "abcd"], "senders": [{"id": "s", "full_name": "Лыков Андрей"}], **CAR}
    docs = spark.createDataFrame([(i, f"Лыков Андрей, VIN WQ9MTR0VK20417365 {'Лыкова ' * i}") for i in range(4)], "doc_id long, text string")
    frame = catalog_frame(spark, [("c", checked(catalog))])
    rows = lambda m: sorted(map(str, [*m.rows.collect(), *m.rejected.collect(), *m.occurrences.collect()]))
    once = rows(mark(docs, frame))
    monkeypatch.setattr(plans, "ALIASES_PER_PASS", 3)
    assert rows(mark(docs, frame)) == once


def test_null_and_repeated_ids_are_rows_like_others(spark):
    text = "VIN WQ9MTRDVK20417365"
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (5, "номер WQ9MTRDVK20417365 и Е507КН96"), (6, "ничего")], "doc_id long, text string")
    m = mark(docs, catalog_frame(spark, [("c", checked(CAR))]))
    assert sorted((str(r.doc_id), r.region_id, r.start) for r in m.occurrences.collect()) == [("5", "r000001", 4), ("5", "r000001", 4), ("5", "r000001", 6), ("5", "r000002", 26), ("None", "r000001", 4)]
    assert m.rejected.count() == 0
    tasks = [(r.doc_id, len(json.loads(r.task)["predictions"][0]["result"])) for r in m.predictions().collect()]
    assert sorted(tasks, key=str) == [(5, 1), (5, 1), (5, 2), (6, 0), (None, 1)]


def test_documents_equal_the_operators_on_tables(spark):
    from entitrail.operators import resolve as tables

    people = [{"id": "a", "first_name": "Андрей", "last_name": "Лыков"}, {"id": "b", "first_name": "Олег", "last_name": "Лыков"}, {"id": "c", "first_name": "Павел", "last_name": "Громов", "birth_date": "1981-06-14"}]
    catalog = {"people": people, "senders": [{"id": "s", "full_name": "Громов Павел"}], "legal_entities": [{"id": "l", "name": "Громов и сыновья"}, {"id": "k", "name": "сыновья Север Восток"}], **CAR}
    words = ["Лыков", "Андрей", "Олег", "Громов Павел", "Громову", "Павел", "14.06.1981", "и сыновья", "Север Восток", "Е 507 КН 96", "WQ9MTR0VK20417365", ".", ",", "текст", "\n"]
    r = __import__("random").Random(8)
    docs = spark.createDataFrame([(i if i % 7 else None, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(30)], "doc_id long, text string")
    docs = docs.where("doc_id is not null").unionByName(docs.where("doc_id is null").limit(1))  # there, a key names one text
    config = MatchingConfig()
    m = mark(docs, catalog_frame(spark, [("c", checked(catalog))]), config)
    rows = tables.resolved(m.candidates, config)
    view = lambda df: sorted(str((r.doc_id, r.place, r.reason, r.combined if r.reason != tables.DUPLICATE else None, [s.place for s in r.support or ()])) for r in df.collect())
    assert view(m.rows) == view(rows) and m.rows.where("reason is not null").select("reason").distinct().count() == 4
    numbers = lambda df, n: sorted(str((r.doc_id, r[n], r.start, r.end, r.field_name, r.score)) for r in df.collect())
    assert numbers(m.occurrences, "n") == numbers(tables.occurrences(rows), "n")
    assert numbers(m.rejected, "reject_ord") == numbers(tables.rejections(rows), "reject_ord")


def test_one_pass_over_the_texts_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "VIN WQ9MTRDVK20417365")], "doc_id long, text string")
    m = mark(docs, catalog_frame(spark, [("c", checked(CAR))]))
    for frame in (m.occurrences, m.rejected, m.predictions(), m.annotations(), m.evidence()):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan


def test_absent_aliases_cost_little():
    import time

    from entitrail.operators.candidates import Matcher

    def seconds(n):
        aliases = [{"entity_type": "legal_entity", "entity_id": str(i), "field_name": "name", "value": f"Общество {i * 7919 % 1000003} Ъ", "weight": 0.9, "profile": "text"} for i in range(n)]
        matcher, text = Matcher(aliases, MatchingConfig(fuzzy_enabled=False)), "обычный текст без имён и названий " * 40
        began = time.process_time()
        for _ in range(30):
            assert matcher.candidates(text) == []
        return time.process_time() - began

    few = seconds(100)
    assert seconds(50_000) <= 2 * few + 0.05


def test_report_has_the_keys_of_its_format(spark):
    report = json.loads(marked(spark, "Грузовик Е 507 КН 96, VIN WQ9MTR0VK20417365", CAR).evidence().head().report)
    assert [*report] == ["schema_version", "offset_unit", "occurrences", "rejected"] and report["offset_unit"] == "unicode_code_points"
    plate = report["occurrences"][0]
    assert [*plate] == ["entity_id", "entity_type", "field_name", "matched_text", "source_value", "score", "method", "edit_distance", "evidence", "region_id", "start", "end"]
    [support] = plate["evidence"]["supporting_matches"]
    assert support["alias"]["field_name"] == "vin" and support["span"] == {"start": 26, "end": 43} and support["method"] == "bitap" and plate["evidence"]["score"] == {"value": 1}
    twice = {"people": [{"id": "a", "last_name": "Лыков", "first_name": "Андрей"}, {"id": "b", "last_name": "Лыков"}]}
    lost = json.loads(marked(spark, "Лыков приехал", twice).evidence().head().report)["rejected"]
    assert {x["reason"] for x in lost} >= {"ambiguous entity identity"} and all([*x["candidate"]] == ["alias", "span", "matched_text", "score", "method", "edit_distance"] for x in lost)


def test_labeling_config():
    from entitrail.operators.export import labeling_config
    from entitrail.schema import labels

    assert labeling_config().count("<Label ") == len(set(labels())) == 28


def test_config_is_checked():
    import pytest

    for bad in ({"min_fuzzy_pattern_length": 0}, {"max_errors": -1}, {"acceptance_threshold": 2}, {"field_weights": {"nose": 0.1}}):
        with pytest.raises(ValueError):
            MatchingConfig(**bad)


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "VIN WQ9MTRDVK20417365"), (3, "VIN WQ9MTRDVK20417365")], "doc_id long, text string")
    rows = mark(docs, catalog_frame(spark, [("c", checked(CAR))])).occurrences.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows)[0] == (False, 3)


def test_date_word_is_no_part_of_a_date():
    assert bounded("14.06.1981г", 0, 10, "date", "birth_date")
    assert not bounded("14.06.1981г", 0, 11, "date", "birth_date")
    assert not bounded("14.06.1981гх", 0, 10, "date", "birth_date")


def test_pairs_meet_in_their_row(spark):
    from entitrail.operators.resolve import neighbours

    catalog = {"people": [{"id": "a", "first_name": "Андрей", "last_name": "Лыков", "birth_date": "1981-06-14"}]}
    texts = ["Лыков Андрей, Андрей Лыков", "Лыков. Андрей", "Лыков", None, "Андрей 14.06.1981 Лыков " * 40]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    m = mark(docs, catalog_frame(spark, [("c", checked(catalog))]))
    found = neighbours(m.unique, MatchingConfig()).alias("n").join(m.unique.alias("u"), [c for c in ("place",)]).where("n.doc_id <=> u.doc_id")
    expected = found.selectExpr("n.doc_id", "u.start", "u.end", "other.start", "other.end", "other.field_name").collect()
    pairs = m.pairs()
    assert sorted(map(str, map(tuple, pairs.collect()))) == sorted(map(str, map(tuple, expected))) and len(expected) > 400
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Exchange" not in plan and "Join" not in plan
    assert neighbours(m.unique, MatchingConfig())._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_distances_are_taken_where_words_begin_and_once_for_a_stretch(monkeypatch):
    from entitrail.functions import search
    from entitrail.operators.boundaries import acceptable
    from entitrail.operators.candidates import Matcher
    from entitrail.functions.normalize import normalize

    aliases = [{"entity_type": t, "entity_id": "e", "field_name": f, "value": v, "weight": 0.5, "profile": p} for t, f, v, p in (("person", "last_name", "Thin", "name"), ("person", "birth_date", "14.06.1981", "date"), ("legal_entity", "name", "Straße 5", "text"))]
    matcher = Matcher(aliases, MatchingConfig(max_errors=2))
    text = "thing within Tin thine t hin, т thiń 14.O6.1981г. 14.06.198 strase 5 \t STRASSE  6 antithin hin " * 20
    found = {(a["value"], *span, distance) for a, _, *span, _, method, distance in matcher.candidates(text) if method == 2}
    for _, a, pattern, k in matcher.aliases:
        n, own = normalize(text, a["profile"]), [x for x in matcher.candidates(text) if x[0] is a and x[5] < 2]
        spans = [(*n.span(s, e), d) for s, e, d in search.fuzzy_spans(n.value, pattern, k) if d and acceptable(n, s, e, a["profile"], a["field_name"], a["value"], 4)]
        assert {x[1:] for x in found if x[0] == a["value"]} == {x for x in spans if not any(x[0] < o[3] and o[2] < x[1] for o in own)}
    assert len(found) > 100
    asked = []
    monkeypatch.setattr(search, "prefix_distances", lambda *x, plain=search.prefix_distances: asked.append(x) or plain(*x))
    Matcher(aliases, MatchingConfig()).candidates(text)
    assert 0 < len(asked) < 100  # each hit was asked about three times, here some thousand
