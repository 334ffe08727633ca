"""Records across byte ranges: every cut of a file gives what reading it whole gives."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.folder import normalize_folder
from tallyframe.sources import datasets, records
from tallyframe.plans.io import _small_ranges
from tallyframe.sources.ranges import csv_records, line_effect, structure


@pytest.fixture
def cut(spark):
    def session(size):
        s = spark.newSession()
        s.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        s.conf.set("spark.sql.files.openCostInBytes", "1")
        return s
    return session


def test_effects_of_lines_follow_the_reader_state_by_state():
    def walk(line, inside, delimiter):
        state = "quoted" if inside else "start"
        for c in line:
            if state == "quoted":
                state = "quote" if c == '"' else "quoted"
            elif state == "quote" and c == '"' or state == "start" and c == '"':
                state = "quoted"
            else:
                state = "start" if c == delimiter else "plain"
        return int(state == "quoted")
    rng = random.Random(1)
    for delimiter in ",;\t|":
        effect = line_effect(delimiter)
        for _ in range(5000):
            line = "".join(rng.choice('""a' + delimiter) for _ in range(rng.randint(0, 12)))
            assert effect(line) == (walk(line, False, delimiter), walk(line, True, delimiter))
    assert line_effect(",")('"' + 'x""' * 200_000) == (1, 0)


FIELDS = ["", "a", "b c", 'say "hi"', "two\nlines", "\n", "x,y", '"', 'é\n"\n",\n', "long " * 40]


@pytest.mark.parametrize("size, end", [(60, "\n"), (200, "\r\n"), (1 << 20, "\n")])
def test_csv_cut_anywhere(spark, cut, tmp_path, size, end):
    rng = random.Random(size)
    rows = [[str(i), *(rng.choice(FIELDS) for _ in range(2))] for i in range(15 if size < 100 else 60)]
    for name, part in (("a.csv", rows[:10]), ("b.csv", rows[10:])):
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=end).writerows([["id", "first\nname", "second"], *part])
        (tmp_path / name).write_bytes(out.getvalue().encode())
    got = datasets.read_dataset(cut(size), str(tmp_path), ["id", "x", "y"], multiline=True).orderBy("pos").collect()
    want = [(r[0], *(x.replace("\n", "") for x in r[1:])) for r in rows]
    assert [(r["id"], r["x"], r["y"]) for r in got] == want
    kept = datasets.read_dataset(cut(size), str(tmp_path), ["id", "x", "y"], multiline=True, newline_compat=False).orderBy("pos").collect()
    if end == "\n":
        assert [(r["id"], r["x"], r["y"]) for r in kept] == [tuple(r) for r in rows]


def test_one_file_is_read_by_several_tasks_and_a_stray_quote_is_plain(spark, cut, tmp_path):
    (tmp_path / "one.csv").write_text("id,t\n" + "".join(f'{i},5" disk no {i}\n{i},"two\nlines ""{i}"""\n' for i in range(300)))
    found = csv_records(cut(2000), str(tmp_path / "one.csv"))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 5
    rows = datasets.read_dataset(cut(2000), str(tmp_path / "one.csv"), ["id", "t"]).orderBy("pos").collect()
    assert len(rows) == 600 and rows[0]["t"] == '5" disk no 0' and rows[599]["t"] == 'twolines "299"'


def test_open_quote_blank_lines_and_no_rows(spark, cut, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,x\n\n2,"never closed\n3,y\n')
    rows = datasets.read_dataset(cut(6), str(tmp_path / "open.csv"), ["a", "b"], multiline=True).orderBy("pos").collect()
    assert [r["a"] for r in rows] == ["1", "2"] and rows[1]["b"].startswith("never closed3,y")
    (tmp_path / "empty.csv").write_text("")
    assert datasets.read_dataset(spark, str(tmp_path / "empty.csv"), ["a"], multiline=True).count() == 0


@pytest.mark.parametrize("size", [30, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_cut_anywhere(spark, cut, tmp_path, size, indent):
    odd = ["}", "]", "[{", '"', "\\", '\\"}', ",", "é\n\t", ""]
    rng = random.Random(size)
    items = [{"db_id": f"d{i}", "question": "".join(rng.choices(odd, k=3)), "extra": {"a": [{"b": [1, {}]}], "c": "}"}, "sql": str(i)}
             for i in range(4 if size < 50 else 20)]
    mixed = [None, *items[:2], 7, "x}", [{"db_id": "inner"}], *items[2:]]
    (tmp_path / "q.json").write_text(json.dumps(mixed, indent=indent, ensure_ascii=False))
    got = {r["index"]: (r["db_id"], r["question"], r["sql"]) for r in records.read_question_array(cut(size), str(tmp_path / "q.json")).collect()}
    assert got == {i: (x["db_id"], x["question"], x["sql"]) for i, x in enumerate(mixed) if isinstance(x, dict)}


@pytest.mark.parametrize("text", ["", "[]", "{}", '{"a": {"db_id": "x"}}', '[{"db_id": "x"}', '[{"db_id": "x}]', '[{"db_id": "x"}]]', '"[{}]"'])
def test_documents_that_are_no_closed_array_give_no_rows(spark, cut, tmp_path, text):
    (tmp_path / "q.json").write_text(text)
    assert records.read_question_array(cut(5), str(tmp_path / "q.json")).count() == 0


def test_structure_of_pieces():
    assert structure('a"[', 1) == (0, [("[", 2)]) and structure('a\\"', 1) == (1, []) and structure('["', 0) == (1, [("[", 0)])


def test_many_ranges_share_a_task(spark, tmp_path):
    rows = [(str(i), f'line one\nsays "{i}", ' + "x" * (i * 37 % 3000)) for i in range(5000)]
    (tmp_path / "in").mkdir()
    for name, part in (("a.csv", rows[:3500]), ("b.csv", rows[3500:])):
        with open(tmp_path / "in" / name, "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows([["id", "t"], *part])
    session = _small_ranges(spark, str(tmp_path / "in"))
    text = session.read.text(str(tmp_path / "in"))
    ranges = text.select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    assert ranges > 100 and text.rdd.getNumPartitions() < ranges / 2
    got = datasets.read_dataset(session, str(tmp_path / "in"), ["id", "t"], multiline=True, newline_compat=False).orderBy("pos").collect()
    assert [(r["id"], r["t"]) for r in got] == rows
    heads = csv_records(session, str(tmp_path / "in")).where("head").select("number", "record").orderBy("number").collect()
    assert [tuple(r) for r in heads] == [(0, "id,t"), (3501, "id,t")]


def test_many_ranges_of_an_array_share_a_task(spark, tmp_path):
    texts = [f'}}, "{{{i}' + "y" * (i * 37 % 3000) for i in range(5000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.json").write_text(json.dumps([{"db_id": "d", "question": t} for t in texts]))
    session = _small_ranges(spark, str(tmp_path / "in"))
    assert session.read.text(str(tmp_path / "in"), lineSep="}").rdd.getNumPartitions() < 60  # of over 110 ranges
    got = records.read_question_array(session, str(tmp_path / "in")).orderBy("index").collect()
    assert [(r["index"], r["question"]) for r in got] == list(enumerate(texts))


def test_no_file_is_an_error_if_files_are_required(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a")
    with pytest.raises(FileNotFoundError):
        datasets.list_datasets(spark, str(tmp_path), required=True)
    with pytest.raises(FileNotFoundError):
        normalize_folder(spark, str(tmp_path), str(tmp_path / "out"))
    assert datasets.list_datasets(spark, str(tmp_path)).count() == 0


def test_all_lines_decide_on_the_delimiter(spark, tmp_path):
    head = "".join(f"{i};a,b\n" for i in range(10_000))  # over 64 KiB of lines with one comma and one semicolon
    (tmp_path / "late.csv").write_text("id;note\n" + head + "".join(f"{i};plain\n" for i in range(10_000)))
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "names.csv").write_bytes('﻿"a;b"; "c" ;"d""e"\r\n1;2;3'.encode())
    got = {r["db_id"]: (r["delimiter"], r["encoding"], r["columns"]) for r in datasets.dataset_catalog(spark, str(tmp_path)).collect()}
    assert got == {"late": (";", "utf-8", ["id", "note"]),
                   "names": (";", "utf-8-sig", ["a;b", '"c"', 'd"e'])}


def test_folder_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("﻿Order No.;Day;Day\n1;5/1/2024;n/a\n2;2024-01-02;x\n".encode())
    (tmp_path / "in" / "b.csv").write_text("x\n-\n")
    report = {r["db_id"]: r for r in normalize_folder(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    a = report["a"]
    assert (a["encoding"], a["delimiter"], a["rows"], a["cols"], a["headers_changed"]) == ("utf-8-sig", ";", 2, 3, 3)
    assert (a["missing_normalized"], a["dates_normalized"], report["b"]["missing_normalized"]) == (1, 1, 1)
    back = spark.read.option("header", True).csv(a["output"])
    assert back.columns == ["order_no", "day", "day_2"]
    assert sorted(tuple(r) for r in back.collect()) == [("1", "2024-01-05", None), ("2", "2024-01-02", "x")]
