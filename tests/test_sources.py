"""Files: dialects, CSV scans, JSON arrays, answers, streaming replays."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.flatten import extract_results, flatten_responses
from tallyframe.sources import datasets, records
from tallyframe.streaming.ingest import ingest_batch_output, merge_micro_batch


def test_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffid;tên\n1;x\n2;y\n".encode())
    (tmp_path / "b.csv").write_bytes(b"id\tv w\n1\t2\n3\t4\n")
    (tmp_path / "c.csv").write_bytes(b"single\nx\ny\n")
    (tmp_path / ".hidden.csv").write_bytes(b"a,b\n")
    got = {r["db_id"]: (r["encoding"], r["delimiter"], r["columns"], r["size_bytes"], r["approx_tokens"])
           for r in datasets.dataset_catalog(spark, str(tmp_path)).collect()}
    assert got["a"][:3] == ("utf-8-sig", ";", ["id", "tên"])
    assert got["b"] == ("utf-8", "\t", ["id", "v w"], 15, 3)
    assert got["c"][1:3] == (",", ["single"]) and len(got) == 3


def test_only_the_head_is_read(spark, tmp_path):
    path = tmp_path / "odd name é.csv"
    path.write_bytes(b"\xef\xbb\xbfa|b\n" + b"1|2\n" * 50000)
    row = datasets.dataset_catalog(spark, str(tmp_path)).first()
    assert (row["db_id"], row["encoding"], row["delimiter"], row["columns"], row["size_bytes"]) == (
        "odd name é", "utf-8-sig", "|", ["a", "b"], path.stat().st_size)


def test_read_dataset(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_bytes('\ufeffa,b,a\n1,"x\ny",3\n4\n5,"say ""hi""",6,7\n'.encode())
    rows = datasets.read_dataset(spark, str(path), ["a", "b", "a"], row_order=None).toDF("a", "b", "a_2")
    assert [tuple(r) for r in rows.collect()] == [("3", "xy", "3"), ("", "", ""), ("6", 'say "hi"', "6")]


def test_normalized_sink_never_overwrites(spark, tmp_path):
    df = spark.createDataFrame([("a,b", "", 1)], "x string, y string, pos long").coalesce(1)
    datasets.write_normalized(df, str(tmp_path / "out"), "pos")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.csv"))
    assert text == 'x,y\n"a,b",\n'
    with pytest.raises(Exception):
        datasets.write_normalized(df, str(tmp_path / "out"), "pos")


def test_question_array(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"db_id": "a", "question": "né?"}, {"db_id": "b", "question": "2", "sql": "s"}], indent=1))
    rows = records.read_question_array(spark, str(path)).orderBy("index").collect()
    assert [(r["index"], r["db_id"], r["question"], r["sql"], r["cot"]) for r in rows] == [
        (0, "a", "né?", "", ""), (1, "b", "2", "s", "")]


def test_answer_array_absent_or_broken(spark, tmp_path):
    assert records.read_answer_array(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text('[{"index": 1,')
    assert records.read_answer_array(spark, str(tmp_path / "bad.json")).count() == 0


def test_response_files(spark, tmp_path):
    doc = {"model_version": "m", "usage_metadata": None, "candidates": [
        {"parts": [], "finish_reason": "MAX_TOKENS", "token_count": None}]}
    (tmp_path / "response_q12.json").write_text(json.dumps(doc, indent=2))
    row = records.read_response_documents(spark, str(tmp_path)).first()
    assert row["index"] == 12 and row["usage_metadata"] is None
    assert row["candidates"][0]["finish_reason"] == "MAX_TOKENS"


BODIES = [
    ("parts", {"candidates": []}, "ERROR:no_candidates"),
    ("parts", {"candidates": [{"parts": []}]}, "ERROR:no_output"),
    ("parts", {"candidates": [{"parts": [{"text": "[[9]]"}, {"code_execution_result": {"output": "[[1]]"}}]}]}, "[[1]]"),
    ("parts", {"candidates": [{"parts": [{"text": ""}, {"text": "[[2]]"}]}]}, "[[2]]"),
    ("items", {"output": None}, "ERROR:no_output"),
    ("items", {"output": [{"type": "message", "content": [{"type": "output_text", "text": "[[3]]"}]},
                          {"type": "code_interpreter_call", "outputs": [{"type": "logs", "logs": "[[4]]"}]}]}, "[[4]]"),
    ("chat", {"choices": [{"message": {"content": "```json\n[[5]]\n```"}}]}, "[[5]]"),
    ("chat", {"choices": []}, "ERROR:no_output"),
    ("blocks", {"content": [{"type": "text", "text": "[[6]]"}, {"type": "tool_result", "content": "[[7]]"}]}, "[[7]]"),
    ("blocks", {"content": [{"type": "text", "text": "[[6]]"}]}, "[[6]]"),
    ("blocks", {"content": []}, "ERROR:no_output"),
    ("chat", None, "ERROR:no_response"), ("who", {}, "ERROR:exception:ValueError:Unknown provider: who")]


def test_extract(spark):
    rows = [(i, s, None if b is None else json.dumps(b)) for i, (s, b, _) in enumerate(BODIES)]
    df = spark.createDataFrame(rows, "i int, shape string, body string")
    assert [r["result"] for r in extract_results(df).orderBy("i").collect()] == [w for _, _, w in BODIES]


def test_unreadable_document(spark):
    df = spark.createDataFrame([("chat", "{broken")], "shape string, body string")
    row = flatten_responses(df).first()
    assert (row["error"] or "ERROR").startswith("ERROR")


def _line(index, text):
    return json.dumps({"custom_id": str(index), "response": {"body": {"output": [
        {"type": "message", "content": [{"type": "output_text", "text": text}]}]}}})


def _questions(spark, n):
    return spark.range(n).select(F.col("id").alias("index"), *[F.lit(f).alias(f) for f in (
        "db_id", "sql_complexity", "question_style", "question", "external_knowledge", "cot", "sql")])


def test_stream_restart_and_replay(spark, tmp_path):
    folder, root, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    asked = _questions(spark, 4)

    def run():
        ingest_batch_output(spark, str(folder), asked, root, "r", "m", "openai", state).awaitTermination()

    def stored():
        return sorted((r["index"], r["result"]) for r in records.read_answer_parts(spark, root, "r", "m").collect())
    (folder / "1.jsonl").write_text("\n".join([_line(0, "[[0]]"), "", "{junk", _line(1, "[[8]]"), _line(1, "[[1]]")]))
    run()
    assert stored() == [(0, "[[0]]"), (1, "[[1]]")]
    (folder / "2.jsonl").write_text("\n".join([_line(1, "[[9]]"), _line(2, "[[2]]"), _line(77, "[[7]]")]))
    run()
    assert stored() == [(0, "[[0]]"), (1, "[[1]]"), (2, "[[2]]")]
    # A replayed epoch rewrites its own part and nothing else.
    lines = spark.createDataFrame([(_line(2, "[[2]]"), 0)], "value string, _split int")
    for _ in range(2):
        merge_micro_batch(lines, 7, asked, root + "2", "r", "m", "openai", "o")
    assert records.read_answer_parts(spark, root + "2", "r", "m").count() == 1


def test_requests_file(spark, tmp_path):
    lines = spark.createDataFrame([(json.dumps({"a": "é"}, ensure_ascii=False),)], "value string")
    records.write_lines(lines, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == '{"a": "é"}'


def test_own_batch_function(spark):
    """A caller's function answers even questions; the rest become error rows."""
    from tallyframe.operators.work import attach_responses, process_batches
    asked = _questions(spark, 6)

    def answer(frame):
        even = frame[frame["index"] % 2 == 0]
        return even[["index"]].assign(result="[[1]]", raw_output="x")
    got = process_batches(asked, answer, "index bigint, result string, raw_output string")
    rows = attach_responses(asked, got).orderBy("index").collect()
    assert [r["result"] for r in rows] == ["[[1]]", "ERROR:no_response"] * 3


def test_header_longer_than_one_read(spark, tmp_path):
    from tallyframe.sources import datasets
    names = [f"column_number_{i:05d}" for i in range(6000)]
    (tmp_path / "wide.csv").write_text(";".join(names) + "\n" + ";".join("x" for _ in names) + "\n")
    (tmp_path / "quoted.csv").write_text('"a\nb",c\n1,2\n')
    got = {r["db_id"]: (r["delimiter"], r["columns"]) for r in datasets.dataset_catalog(spark, str(tmp_path)).collect()}
    assert got["wide"] == (";", names) and got["quoted"] == (",", ["a\nb", "c"])


def test_a_broken_store_is_not_an_empty_one(spark, tmp_path):
    import pytest

    from tallyframe.sources import records
    assert records.read_answer_array(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(Exception):
        records.read_answer_array(spark, "nosuchscheme://x/y.json").count()


def test_stream_dedupe_with_bounded_state(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyframe.streaming.ingest import first_per_id
    rows = spark.createDataFrame([(i % 5, f"2024-01-01 00:{i % 50:02d}:00") for i in range(100)], "id int, at string")
    rows.withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    (first_per_id(stream, ["id"], "at", "2 hours").writeStream.format("parquet").option("path", str(tmp_path / "out"))
     .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination())
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(5))


def test_an_epoch_reads_no_more_files_the_more_epochs_there_were(spark, tmp_path):
    root, asked = str(tmp_path / "store"), _questions(spark, 400)
    read = []
    for epoch in range(13):
        lines = spark.createDataFrame([(_line(i, f"[[{i}]]"), 0) for i in range(epoch * 3, epoch * 3 + 5)], "value string, _split int")
        read.append(records.read_answer_parts(spark, root, "r", "m", [0, 1]).select(F.input_file_name()).distinct().count())
        merge_micro_batch(lines, epoch, asked, root, "r", "m", "openai", "o", compact_every=4)
    assert max(read) <= 2 * 4 and max(read[8:]) <= max(read[:8]) + 1
    before = sorted(tuple(r) for r in records.read_answers(spark, root, "r", "m").select("index", "result").collect())
    assert before == [(i, f"[[{i}]]") for i in range(41)]
    # A replay of an epoch that has been merged changes nothing.
    merge_micro_batch(spark.createDataFrame([(_line(3, "[[x]]"), 0)], "value string, _split int"), 1, asked, root, "r", "m", "openai", "o")
    assert sorted(tuple(r) for r in records.read_answers(spark, root, "r", "m").select("index", "result").collect()) == before


def test_compaction_without_removal_and_of_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    records.compact_answers(spark, root, "r", "m")
    assert records.read_answers(spark, root, "r", "m").count() == 0
    rows = _questions(spark, 3).withColumn("raw_output", F.lit(""))
    records.store_answers(rows.withColumn("result", F.lit("ERROR:no_output")), root, "r", "m", "a", 0)
    records.store_answers(rows.where("index < 2").withColumn("result", F.lit("[[1]]")), root, "r", "m", "b", 0)
    records.compact_answers(spark, root, "r", "m", remove=False)
    records.store_answers(rows.where("index = 2").withColumn("result", F.lit("[[2]]")), root, "r", "m", "a", 1)
    got = sorted((r["index"], r["result"]) for r in records.read_answers(spark, root, "r", "m").collect())
    assert got == [(0, "[[1]]"), (1, "[[1]]"), (2, "[[2]]")]
