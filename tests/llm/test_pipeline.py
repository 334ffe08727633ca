import pytest
from samples import frame, prose

import corpus_pipeline as p
from tallyframe.llm import bpe, decontaminate, near_dup, queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(queries.QUERIES)


@pytest.fixture(scope="module")
def duck():
    from check_queries import connect
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_runs_over_the_whole_table(spark, duck, name):
    from check_queries import compare
    if name in queries.ORACLES:
        problem, _ = compare(spark, duck, queries.QUERIES[name], queries.ORACLES[name], SF)
        assert problem is None, problem
        return
    rows = queries.QUERIES[name](spark, SF).collect()
    if name == "op10_benchmark_decontamination":
        return
    ids = [r.doc_id for r in rows]
    assert sorted(ids) == sorted(r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall())


def test_stages_take_effect_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns, name
        rows = {r.doc_id: r for r in after.collect()}
        had = {r.doc_id: r for r in before.collect()}
        assert set(rows) <= set(had)
        if name != "suffix_array_dedup":
            assert all(rows[i] == had[i] for i in rows)
        else:
            assert set(rows) == set(had)
            assert all(r.n_chars == len(r.text) for r in rows.values())
        if name == "near_duplicates":
            assert near_dup.near_duplicates(after).where("doc_id <> class_id").count() == 0
        if name == "decontamination":
            assert decontaminate.find_items(after, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        before = spark.createDataFrame([tuple(rows[i]) for i in sorted(rows)], docs.schema)
    name, stage = p.STAGES[-1]
    tokenizer = bpe.load_tokenizer(queries.tokenizer_path())
    got = {r.doc_id: r for r in stage(spark, before, SF).collect()}
    for r in before.collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].ids == ids and got[r.doc_id].text == tokenizer.decode(ids, skip_special_tokens=False)


def test_suffix_stage_keeps_other_columns(spark):
    passage = prose(60, 9)
    docs = frame(spark, [(1, "start " + passage), (2, passage + " end é"), (3, None), (None, passage)])
    got = {r.doc_id: r for r in p.suffix_stage(spark, docs, SF).collect()}
    assert got[None].text == passage and got[3].text == ""
    assert "end é" in got[2].text and len(got[2].text) < 20 and got[1].lang == "en" and got[1].block == "c"


def test_leaks_take_no_clean_row_of_their_id_along(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = frame(spark, [(None, leak), (None, prose(60, 9)), (4, "see " + leak), (4, prose(60, 10))])
    got = {(r.doc_id, r.text) for r in p.decontamination_stage(spark, docs, SF).collect()}
    assert got == {(None, prose(60, 9)), (4, prose(60, 10))}


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0
