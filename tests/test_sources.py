import json

import pytest

from entitrail.cli import main
from entitrail.plans.marking import mark_batch
from entitrail.sources.batch import parse_csv, read_batch, with_texts
from entitrail.sources.catalog import catalog_frame, parse_catalog, read_catalog, validate
from entitrail.sources.files import distinct_paths, write_utf8_atomic

PERSON = '[{"Фамилия": "Лыков", "Имя": "Андрей", "Отчество": "Андреевич", "Дата рождения": "02.09.1977"}]'


def quoted(x):
    return '"' + x.replace('"', '""') + '"'


def test_names_in_both_languages():
    a = parse_catalog('{"people": [{"id": "p", "first_name": "Андрей", "birth_date": "1981-06-14"}]}')
    b = parse_catalog('{"ФизЛицо": [{"id": "p", "Имя": "Андрей", "дата рождения": "14.06.1981"}]}')
    assert a == b


@pytest.mark.parametrize(
    "text",
    [
        '{"people": [{"id": 1}]}', '{"people": [{"id": " "}]}', '{"people": [{"id": "p", "x": "y"}]}', '{"other": []}', '{"people": {}}', "[]",
        '{"people": [{"id": "p", "first_name": "a", "Имя": "b"}]}', '{"people": [{"id": "p"}, {"id": "p"}]}', '{"people": [{"id": "p", "birth_date": "1981/06/14"}]}',
        '{"people": [{"first_name": "a"}]}', '{"cars": [{"id": "c", "vin": ""}]}', '{"people": [], "ФизЛицо": []}', "{",
    ],
)
def test_bad_catalogs(text):
    with pytest.raises(ValueError):
        parse_catalog(text)


def test_same_id_in_two_groups_and_empty_strings():
    got = parse_catalog('{"cars": [{"id": "x"}], "legal_entities": [{"id": "x", "inn": ""}]}')
    assert got["legal_entities"] == [{"id": "x", "inn": "", "name": None}]


def test_read_catalog_and_validate(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"cars": [{"id": "x", "vin": "V"}]}', encoding="utf-8")
    frame = read_catalog(spark, str(tmp_path / "c.json"))
    assert frame.head().cars[0].vin == "V" and validate(frame).count() == 0
    broken = {"people": [], "documents": [], "legal_entities": [], "senders": [], "miscellaneous": []}
    car = {"vin": None, "license_plate": None, "body_number": None, "chassis_number": None}
    broken["cars"] = [{"id": "x", **car}, {"id": "x", **car}, {"id": " ", **car}]
    assert {r.problem for r in validate(catalog_frame(spark, [("c", broken)])).collect()} == {"repeated id", "blank id"}


@pytest.mark.parametrize(
    "content",
    [
        "a;b\n1;2\n", "versionId;versionId\n1;2\n", "versionId;\n1;2\n", "versionId\n", "", "versionId;a\n1\n", "versionId\n..\n", "versionId\na/b\n", "versionId\n\\\n",
        'versionId;a\n1;"x\n', 'versionId;a\n1;"x"y\n', "versionId;InsuranceSubjects\n1;{}\n", "versionId;InsuranceSubjects\n1;[1]\n", "versionId;Sender;Отправитель\n1;a;b\n",
    ],
)
def test_bad_csv(content):
    import csv

    with pytest.raises((ValueError, csv.Error)):
        list(parse_csv(content.encode()))


def test_csv_rows():
    text = f'﻿versionId,cardId,fileId,InsuranceSubjects,PartnerName,PartnerKindName,RegDate\r\nv1,7,,{quoted(PERSON)},Ромашка,ЮЛ,01.02.2026 10:00:00\r\n\r\nv2,,,,Пётр,,\r\n'
    (n1, v1, ids, one), (n2, v2, none, two) = parse_csv(text.encode())
    assert (n1, v1, ids, n2, v2, none) == (2, "v1", {"cardId": "7"}, 3, "v2", {})
    assert one["people"][0]["last_name"] == "Лыков" and one["documents"] == [] and one["senders"][0]["organization_name"] == "Ромашка"
    assert str(one["miscellaneous"][0]["incoming_letter_date"]) == "2026-02-01"
    assert two["senders"][0]["full_name"] == "Пётр" and two["miscellaneous"] == []


def test_large_cells_and_line_ends():
    cell = "x\r\n" * 50_000
    [(_, _, _, got)] = parse_csv(f"versionId;AddressForAnswer\n1;{quoted(cell)}\n".encode())
    assert got["miscellaneous"][0]["reply_address"] == cell.strip()


def batch(tmp_path):
    (tmp_path / "txts").mkdir()
    (tmp_path / "in.csv").write_text(f"versionId;cardId;InsuranceSubjects;InsuranceSubjectsVehicle\na;1;{quoted(PERSON)};\nb;;;{quoted('[{"VIN": "WQ9MTRDVK20417365"}]')}\nc;;;\n", encoding="utf-8")
    (tmp_path / "txts/a.txt").write_bytes("Лыков Андрей\r\nWQ9MTRDVK20417365".encode())
    (tmp_path / "txts/b.txt").write_bytes("Лыков Андрей\r\nWQ9MTRDVK20417365".encode())
    return str(tmp_path / "in.csv")


def test_batch(spark, tmp_path):
    rows = with_texts(read_batch(spark, [batch(tmp_path)]))
    assert {r.version_id: r.text is None for r in rows.collect()} == {"a": False, "b": False, "c": True}
    m = mark_batch(rows)
    tasks = [json.loads(r.task) for r in m.predictions().orderBy("row_key").collect()]
    assert [t["data"]["versionId"] for t in tasks] == ["a", "b"] and tasks[0]["data"]["cardId"] == "1" and tasks[0]["data"]["source_row"] == 2
    labels = [[r["value"]["labels"][0] for r in t["predictions"][0]["result"]] for t in tasks]
    assert labels == [["PERSON_LAST_NAME", "PERSON_FIRST_NAME"], ["CAR_VIN"]]
    assert tasks[1]["predictions"][0]["result"][0]["value"]["start"] == 14


def test_empty_text_stops_the_batch(spark, tmp_path):
    path = batch(tmp_path)
    (tmp_path / "txts/c.txt").write_bytes(b"")
    rows = with_texts(read_batch(spark, [path]))
    with pytest.raises(Exception, match="empty text"):
        rows.collect()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text('{"cars": [{"id": "x", "vin": "WQ9MTRDVK20417365"}]}', encoding="utf-8")
    (tmp_path / "t.txt").write_text("VIN WQ9MTRDVK20417365", encoding="utf-8")
    args = ["mark", "--objects", str(tmp_path / "c.json"), "--text", str(tmp_path / "t.txt")]
    assert main(args) == 0
    assert json.loads(capsys.readouterr().out)[0]["predictions"][0]["result"][0]["value"]["labels"] == ["CAR_VIN"]
    assert main([*args, "--output", str(tmp_path / "o.json"), "--evidence-output", str(tmp_path / "e.json"), "--format", "annotations"]) == 0
    assert json.loads((tmp_path / "o.json").read_text())[0]["annotations"] and json.loads((tmp_path / "e.json").read_text())["occurrences"]
    assert main([*args, "--output", str(tmp_path / "t.txt")]) == 2
    assert main(["validate", "--objects", str(tmp_path / "c.json")]) == 0
    (tmp_path / "c.json").write_text("{}x")
    assert main(["validate", "--objects", str(tmp_path / "c.json")]) == 2


def test_files(tmp_path):
    write_utf8_atomic(str(tmp_path / "x"), "а")
    assert (tmp_path / "x").read_bytes() == "а\n".encode() and [p.name for p in tmp_path.iterdir()] == ["x"]
    with pytest.raises(ValueError):
        distinct_paths(["a"], ["b", "b"])


def test_a_link_must_not_lead_out_of_the_folder(spark, tmp_path):
    (tmp_path / "txts").mkdir()
    (tmp_path / "secret.txt").write_text("elsewhere", encoding="utf-8")
    (tmp_path / "txts/a.txt").write_text("within", encoding="utf-8")
    (tmp_path / "txts/b.txt").symlink_to(tmp_path / "txts/a.txt")
    (tmp_path / "in.csv").write_text("versionId;cardId\na;1\nb;2\n", encoding="utf-8")
    read = lambda: sorted(r.text for r in with_texts(read_batch(spark, [str(tmp_path / "in.csv")])).collect())
    assert read() == ["within", "within"]
    (tmp_path / "txts/b.txt").unlink()
    (tmp_path / "txts/b.txt").symlink_to(tmp_path / "secret.txt")
    with pytest.raises(Exception, match="inside its folder"):
        read()


def test_labels_command(capsys):
    assert main(["labels"]) == 0 and capsys.readouterr().out.count("<Label ") == 28


def test_aliases_are_distinct_without_a_shuffle_where_entities_come_once(spark, monkeypatch):
    from entitrail.config import MatchingConfig
    from entitrail.functions.morphology import SuffixInflector
    from entitrail.operators import aliases
    from entitrail.sources.catalog import catalog_frame, checked

    def catalog(*names):
        senders = [{"id": str(i), "full_name": n, "email": "a@b.c"} for i, n in enumerate(names)]
        people = [{"id": str(i), "first_name": n, "last_name": n, "previous_last_name": n, "birth_date": "1981-06-14"} for i, n in enumerate(names)]
        return checked({"senders": senders, "people": people, "miscellaneous": [{"id": "m", "case_number": "A57-31184/2023"}], "documents": [{"id": "d", "series": "1", "number": "2"}]})

    def rows(frame):
        return sorted(str(tuple(r)) for r in frame.collect())

    own = [("a", catalog("Ан Ан", "Лыков Андрей Олегович", "ООО «Х» 1", "х")), ("b", catalog("Ан Ан")), ("c", checked({}))]
    again = [*own, ("a", catalog("Ан", "Лыков Андрей")), ("b", catalog("Ан Ан"))]
    monkeypatch.setattr(aliases, "_without_repeats", lambda rows, catalogs: rows.distinct())
    cases = [(c, config, inflector) for c in (own, again) for config in (None, MatchingConfig(field_weights={"full_name": 0.0})) for inflector in (None, SuffixInflector())]
    expected = [rows(aliases.generate_aliases(catalog_frame(spark, c), *how)) for c, *how in cases]
    monkeypatch.undo()
    for (c, *how), x in zip(cases, expected):
        made = aliases.generate_aliases(catalog_frame(spark, c), *how)
        assert rows(made) == x and len(x) > 30
        if c is own:
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "HashAggregate" not in plan
    monkeypatch.setattr(aliases, "REPEATED", 1)
    assert rows(aliases.generate_aliases(catalog_frame(spark, again))) == expected[4]
