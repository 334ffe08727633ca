"""Result sets in long form against the comparison inside one row, and failing statements."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyframe.functions.values import decode_result
from tallyframe.operators import evaluate, longform
from tallyframe.operators.compare import compare_rows
from tallyframe.operators.longform import compare_long


def _random_set(rng, rows, width):
    def cell():
        return rng.choice(["null", '"a"', '"b"', "1", "1.004", "2", "true", '"1"', "10", "9"])
    return [[cell() for _ in range(width)] for _ in range(rows)]


def _case(rng):
    gold = _random_set(rng, rng.choice([0, 1, 3, 6]), rng.choice([1, 2, 3]))
    pred = [list(r) for r in gold]
    kind = rng.randrange(7)
    if kind == 1:
        rng.shuffle(pred)
    elif kind == 2:
        pred = [r[::-1] + ["7"] for r in pred]
    elif kind == 3 and pred:
        rng.choice(pred)[0] = "null"
    elif kind == 4 and pred:
        pred = pred[1:]
    elif kind == 5 and pred:
        pred[-1] = pred[-1][:-1]
    elif kind == 6:
        pred = _random_set(rng, len(gold), 2)
    return ["[" + ",".join("[" + ",".join(r) + "]" for r in side) + "]" for side in (gold, pred)]


@pytest.mark.parametrize("order", ["text", "numeric"])
def test_long_form_decides_like_one_row(spark, order):
    rng = random.Random(3)
    cases = [(i, *_case(rng), bool(rng.randrange(2))) for i in range(150)]
    both = spark.createDataFrame(cases, "index long, gold string, pred string, ordered boolean").select(
        "index", "ordered", decode_result(F.col("gold")).alias("g"), decode_result(F.col("pred")).alias("p")).cache()
    want = {r["index"]: r["same"] for r in both.select("index", compare_rows(
        F.col("p"), F.col("g"), F.col("ordered"), order=order).alias("same")).collect()}
    gold = both.select(F.col("index").cast("string").alias("gold_id"), F.posexplode("g").alias("row_no", "cells"))
    pred = both.select("index", F.posexplode("p").alias("row_no", "cells"))
    pairs = both.select("index", F.col("index").cast("string").alias("gold_id"), "ordered")
    assert {r["index"]: r["same"] for r in compare_long(pairs, pred, gold, order=order).collect()} == want
    assert {True, False} == set(want.values())


def test_statements_that_fail_while_running_are_errors(spark):
    def register(session, db_id):
        session.createDataFrame([(1,), (2,)], "v int").createOrReplaceTempView("t")
    sql = ["SELECT (SELECT v FROM t) AS x FROM t", "SELECT raise_error('boom') AS x FROM t", "SELECT v FROM t", "SELECT broken FROM",
           "SELECT element_at(array(v), 0) AS x FROM t", "SELECT v FROM gone"]
    asked = spark.createDataFrame([(i, "d", s) for i, s in enumerate(sql)], "index long, db_id string, sql string")
    answers = spark.createDataFrame([(i, "[[1],[2]]") for i in range(len(sql))], "index long, result string")
    rows, status = evaluate.execute_gold(spark, asked, register)
    details = {r["index"]: r for r in evaluate.evaluate_run(answers, asked, rows, status).collect()}
    assert [details[i]["reason"].split(":")[0] for i in range(len(sql))] == ["gold_sql_error"] * 2 + ["match"] + ["gold_sql_error"] * 3
    assert "boom" in details[1]["detail"]
    conditions = {r["condition"] for r in status.collect()}
    assert {"SCALAR_SUBQUERY_TOO_MANY_ROWS", "USER_RAISED_EXCEPTION", "TABLE_OR_VIEW_NOT_FOUND"} <= conditions


def test_what_is_not_the_statement_s_fault_stops_the_run(spark, tmp_path):
    @F.udf("int")
    def lost(v):
        import os
        os._exit(1)  # what a killed worker looks like to the driver

    def register(session, db_id):
        session.createDataFrame([(1,), (2,)], "v int").select(lost("v").alias("v")).createOrReplaceTempView("t")
    asked = spark.createDataFrame([(0, "d", "SELECT v FROM t")], "index long, db_id string, sql string")
    with pytest.raises(Exception) as caught:
        evaluate.execute_gold(spark, asked, register)
    assert evaluate.statement_failure(caught.value) is None
    assert evaluate.statement_failure(RuntimeError("disk full")) is None
    with pytest.raises(AnalysisException) as wrong:
        spark.sql("SELECT nothing FROM nowhere")
    assert evaluate.statement_failure(wrong.value)[0] == "TABLE_OR_VIEW_NOT_FOUND"


def test_gold_rows_are_there_whatever_the_answer_s_size(spark):
    def register(session, db_id):
        session.range(12).selectExpr("id", "'n' || id AS n").createOrReplaceTempView("t")
    asked = spark.createDataFrame([(i, "d", "SELECT id, n FROM t") for i in range(3)], "index long, db_id string, sql string")
    good = "[" + ",".join(f'["n{i}",{i}]' for i in range(12)) + "]"
    answers = spark.createDataFrame([(0, "[[1]]"), (1, good), (2, good.replace("n7", "n8"))], "index long, result string")
    rows, status = evaluate.execute_gold(spark, asked, register)
    for cell_rows in (1_000_000, 5):
        got = {r["index"]: r for r in evaluate.evaluate_run(answers, asked, rows, status, cell_rows=cell_rows).collect()}
        assert [got[i]["status"] for i in range(3)] == ["wrong", "correct", "wrong"] and got[0]["n_gold"] == 12
        assert got[0]["gold"] is None if cell_rows == 5 else len(got[0]["gold"]) == 12
    tables = evaluate.report_tables(evaluate.evaluate_run(answers, asked, rows, status, cell_rows=5), rows)
    assert tables["expected"].groupBy("index").count().orderBy("index").collect() == [(0, 12), (2, 12)]
    assert tables["predicted"].where("index = 0").collect()[0]["cells"] == ["1"]


def test_rows_of_large_gold_sets_leave_before_they_are_gathered(spark):
    rows = spark.range(2003).selectExpr("id AS row_no", "array(named_struct('is_null', false, 'text', string(id), 'is_num', true, 'num', double(id))) AS cells",
                                        "CASE WHEN id < 2000 THEN 'large' WHEN id < 2002 THEN 'small' ELSE 'unasked' END AS gold_id")
    answers = spark.createDataFrame([("large",), ("small",), ("small",), ("none",)], "gold_id string")
    got = evaluate.gold_for_answers(answers, rows, cell_rows=5)
    assert {r["gold_id"]: (r["n_gold"], r["gold"] and len(r["gold"])) for r in got.collect()} == {"large": (2000, None), "small": (2, 2)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "strategy=broadcast" in plan


def test_only_unlike_number_columns_are_ranked_cell_by_cell(spark, monkeypatch):
    ranked = []
    plain = longform.rank_within
    monkeypatch.setattr(longform, "rank_within", lambda df, *a: ranked.append((df.columns, df.count())) or plain(df, *a))
    gold = [[f'"t{i % 7}"', str(i), "null" if i == 3 else f"{i}.25"] for i in range(40)]
    off = [r[:2] + [r[2].replace(".25", ".254")] for r in gold]
    sets = [gold, gold[::-1], [r[::-1] for r in off], gold, gold[::-1]]
    text = ["[" + ",".join("[" + ",".join(r) + "]" for r in rows) + "]" for rows in sets]
    both = spark.createDataFrame([(i, text[0], p, i > 2) for i, p in enumerate(text)], "index long, gold string, pred string, ordered boolean").select(
        "index", "ordered", decode_result(F.col("gold")).alias("g"), decode_result(F.col("pred")).alias("p"))
    gold_rows = both.select(F.col("index").cast("string").alias("gold_id"), F.posexplode("g").alias("row_no", "cells"))
    pred = both.select("index", F.posexplode("p").alias("row_no", "cells"))
    got = compare_long(both.select("index", F.col("index").cast("string").alias("gold_id"), "ordered"), pred, gold_rows)
    assert {r["index"]: r["same"] for r in got.collect()} == {0: True, 1: True, 2: True, 3: True, 4: False}
    cells = sum(n for columns, n in ranked if "cells" not in columns)
    assert cells == 2 * 40 and sum(n for columns, n in ranked if "cells" in columns) == 4 * 40


def test_a_cell_that_equals_nothing_matches_nothing(spark):
    def sets(key):
        return spark.sql(f"SELECT {key}, row_no, array(named_struct('is_null', id = 2, 'text', 'NaN', 'is_num', id < 1, 'num', "
                         "CASE WHEN id = 0 THEN double('NaN') END)) AS cells FROM (SELECT id, 0L AS row_no FROM range(3))")
    pairs = spark.range(3).selectExpr("id AS index", "string(id) AS gold_id", "false AS ordered")
    got = compare_long(pairs, sets("id AS index"), sets("string(id) AS gold_id"))
    assert {r["index"]: r["same"] for r in got.collect()} == {0: False, 1: True, 2: True}
