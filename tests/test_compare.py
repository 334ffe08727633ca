"""Result-set comparison and run evaluation."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.values import decode_result, json_list, result_rows
from tallyframe.operators.compare import column_order_mismatch, compare_rows
from tallyframe.operators.evaluate import (evaluate_run, execute_gold, mismatch_preview, summarize,
                                           wrong_indices)


@pytest.fixture
def same(spark):
    def run(pred, gold, ordered=False, **options):
        df = spark.createDataFrame([(json.dumps(pred), json.dumps(gold))], "p string, g string")
        p, g = (result_rows(json_list(F.col(c))) for c in "pg")
        return df.select(compare_rows(p, g, F.lit(ordered), **options).alias("o")).first()["o"]
    return run


CASES = [
    ([], [], False, True), ([], [[1]], False, False), ([[1]], [], False, False),
    ([["a", 1], ["b", 2]], [[1], [2]], False, True),
    ([["a", 2], ["b", 1]], [["a", 1], ["b", 2]], False, True),
    ([[2], [1]], [[1], [2]], True, False), ([[2], [1]], [[1], [2]], False, True),
    ([[1.004]], [[1.0]], False, True), ([[1.02]], [[1.0]], False, False),
    ([["1"]], [[1]], False, False), ([[None]], [[None]], False, True), ([[None]], [[0]], False, False),
    ([[True]], [[1]], False, True), ([[1e7 + 1]], [[1e7]], False, False),
    ([[1e12 + 1]], [[1e12]], False, True), ([[10.001], [10.5]], [[9.999], [10.5]], False, False),
    ([[1, 2], [3]], [[1], [3]], False, False), ([[1], [1]], [[1]], False, False),
    ([[[1, 2]]], [[[1, 2]]], False, True), ([1, 2], [[1], [2]], False, True)]


def test_compare(spark):
    rows = [(i, json.dumps(p), json.dumps(g), o) for i, (p, g, o, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, p string, g string, o boolean")
    p, g = (result_rows(json_list(F.col(c))) for c in "pg")
    out = df.select("i", compare_rows(p, g, F.col("o")).alias("same")).orderBy("i").collect()
    assert [(CASES[r["i"]], r["same"]) for r in out] == [(c, c[3]) for c in CASES]


def test_options(same):
    assert same([[10.001], [10.5]], [[9.999], [10.5]], order="numeric")
    assert not same([["a", 2], ["b", 1]], [["a", 1], ["b", 2]], row_aligned=True)
    assert not same([[1, "a"]], [["a", 1]], strict_columns=True)
    assert same([[1.4]], [[1.0]], tolerance=0.5)


def test_column_order(spark):
    def check(pred, gold):
        df = spark.createDataFrame([(json.dumps(pred), json.dumps(gold))], "p string, g string")
        p, g = (result_rows(json_list(F.col(c))) for c in "pg")
        return df.select(column_order_mismatch(p, g).alias("o")).first()["o"]
    assert check([[1, "a"], [2, "b"]], [["a", 1], ["b", 2]])
    assert not check([["a", 1]], [["a", 1]])
    assert not check([["a", 3]], [["a", 1]])


def test_decode(column):
    got = column(lambda c: F.size(decode_result(c)), ["ERROR:x", "{}", "[]", "[[1],[2]]", "[1]", "no"])
    assert got == [None, None, 0, 2, 1, None]


def test_evaluate_run(spark):
    def register(session, db_id):
        session.createDataFrame([("a", 1.004), ("b", 2.0)], "k string, v double").createOrReplaceTempView("t")
    sql = ["SELECT k, v FROM t", "SELECT v FROM t ORDER BY v", "SELECT nope FROM t", "SELECT k FROM t WHERE v > 9",
           "SELECT k FROM t", "SELECT k FROM t"]
    results = ['[["b", 2], ["a", 1]]', "[[2.0], [1.0]]", "[[1]]", "[]", "ERROR:no_output", '[["a"]]']
    questions = spark.createDataFrame([(i, "d", s) for i, s in enumerate(sql)], "index long, db_id string, sql string")
    answers = spark.createDataFrame([(i, r) for i, r in enumerate(results)] + [(99, "[]")], "index long, result string")
    rows, status = execute_gold(spark, questions, register)
    details = evaluate_run(answers, questions, rows, status)
    got = {r["index"]: r["reason"].split(":")[0] for r in details.collect()}
    assert got == {0: "match", 1: "value_mismatch", 2: "gold_sql_error", 3: "match", 4: "invalid_result",
                   5: "value_mismatch"}
    total = summarize(details).first()
    assert (total["total"], total["correct"], total["wrong"], total["error_outputs"]) == (6, 2, 4, 1)
    assert sorted(r["index"] for r in wrong_indices(details).collect()) == [1, 2, 4, 5]
    shown = mismatch_preview(details, n=1).first()
    assert shown["index"] == 1 and shown["predicted"] == [["2"], ["1"]] and shown["expected"] == [["1.004"], ["2"]]
