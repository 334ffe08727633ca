"""Partition invariance, hot keys, and the plans scale depends on."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyframe.operators.ordering import first_within, rank_within, running_sum
from tallyframe.operators.profile import melt, profile_columns, ranked_values, value_counts
from tallyframe.operators.work import mini_batches

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of the rows; positions are unique and have gaps."""
    rows = [(i * 3 + 1, "hot" if i % 3 == 0 else f"k{i % 40}", i % 7) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "index long, db_id string, v long").repartition(7)


def frame(rows):
    return pd.DataFrame(rows, columns=["index", "db_id", "v"]).sort_values("index")


@pytest.mark.parametrize("spacing", [1, 64, 1 << 47])
def test_rank_and_sum(hot, spacing):
    """Sparse positions, such as hashes, cost no more than dense ones."""
    rows = [(i * spacing, *rest) for i, *rest in hot[0]]
    df = hot[1].withColumn("index", F.col("index") * spacing)
    want = frame(rows)
    want["rn"] = want.groupby("db_id").cumcount() + 1
    want["total"] = want.groupby("db_id")["v"].cumsum()
    ranked = rank_within(df, ["db_id"], "index")
    assert "SinglePartition" not in plan_of(ranked)
    summed = running_sum(df, ["db_id"], "index", F.col("v"), "total")
    assert sorted((r["index"], r["rn"]) for r in ranked.collect()) == list(zip(want["index"], want["rn"]))
    assert sorted((r["index"], r["total"]) for r in summed.collect()) == list(zip(want["index"], want["total"]))


@pytest.mark.parametrize("n", [1, 50, 900, 5000])
def test_first_within(hot, n):
    rows, df = hot
    want = frame(rows).groupby("db_id").head(n)["index"]
    assert sorted(r["index"] for r in first_within(df, ["db_id"], "index", n).collect()) == list(want)


def test_mini_batches(hot):
    rows, df = hot
    want = frame(rows).sort_values(["db_id", "index"]).reset_index(drop=True)
    want = {ix: i // 20 for i, ix in enumerate(want["index"])}
    assert {r["index"]: r["batch"] for r in mini_batches(df, 20).collect()} == want


def test_running_sum_without_keys(hot):
    rows, df = hot
    want = frame(rows)["v"].cumsum()
    got = running_sum(df, [], "index", F.col("v"), "t").orderBy("index")
    assert [r["t"] for r in got.collect()] == list(want)


@pytest.mark.parametrize("parts", [1, 8])
def test_profile_does_not_depend_on_partitions(spark, hot, parts):
    rows, df = hot
    got = profile_columns(df.repartition(parts), "index").orderBy("column").collect()
    assert [r["column"] for r in got] == ["db_id", "v"]
    top = [(t["value"], t["count"]) for t in got[0]["top_values"]]
    assert top[0] == ("hot", 1000) and got[1]["sample_values"] == list("01234")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_values_are_limited_before_the_shuffle(hot):
    plan = plan_of(ranked_values(value_counts(melt(hot[1], "index")), 5, True))
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["normalize_dates", "normalize_numbers", "normalize_table", "annotated_dates",
                                  "flatten_dispatch", "parse_stages", "score_answers", "compare_tolerance"])
def test_row_operators_do_not_shuffle(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    if name == "parse_stages":
        assert plan_of(df).count("Exchange") == 1  # the count per stage only
    else:
        assert "Exchange" not in plan_of(df)


def test_no_query_multiplies_rows(spark):
    """No unbounded nested-loop or cartesian join: only one-row sides are paired."""
    for name, fn in entry.queries().items():
        if not name.startswith(("wk_", "cost_", "select_", "resume", "remaining", "prompt_per", "exec_")):
            continue
        assert "CartesianProduct" not in plan_of(fn(spark, SF_DIR)), name


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["wk_filter"](spark, SF_DIR))
    assert "GreaterThanOrEqual(p_size,20)" in plan and "p_retailprice" not in plan


def test_profile_counts_values_once(hot):
    plan = plan_of(profile_columns(hot[1], "index"))
    assert "values-" in plan and "Expand" not in plan and "index" not in plan.split("ReadSchema")[1]


def test_late_evidence_counts(spark):
    """Cells far behind the first thousands decide like the first ones."""
    from tallyframe.operators.clean import normalize_table, pick_numeric_columns
    from tallyframe.operators.profile import column_stats, melt, mixed_layout_columns, value_counts
    rows = spark.range(9000).select(
        F.col("id").alias("pos"), F.when(F.col("id") < 5500, "n/a").otherwise("$1,500").alias("fee"),
        F.when(F.col("id") < 8000, "2024-01-05").otherwise("5/1/2024").alias("day"))
    assert pick_numeric_columns(rows, "pos") == ["fee"]
    cleaned = normalize_table(rows, "pos").where("pos = 8999").first()
    assert (cleaned["fee"], cleaned["day"]) == ("1500", "2024-01-05")
    mixed = mixed_layout_columns(column_stats(value_counts(melt(rows, "pos"))))
    assert [r["column"] for r in mixed.collect()] == ["day"]


def test_questions_of_unknown_datasets_are_not_lost(spark):
    from tallyframe.operators.cost import dataset_volumes
    from tallyframe.operators.prompts import user_prompts
    from tallyframe.operators.select import require_datasets, select_smallest, unknown_datasets
    questions = spark.createDataFrame([(0, "a", "q0", ""), (1, "gone", "q1", "")],
                                      "index long, db_id string, question string, external_knowledge string")
    catalog = spark.createDataFrame([("a", 40, 10)], "db_id string, size_bytes long, approx_tokens long")
    assert [r["index"] for r in select_smallest(questions, catalog).collect()] == [0, 1]
    contexts = spark.createDataFrame([("a", "H", "")], "db_id string, header string, rules string")
    got = {r["index"]: (r["prompt"] is None, r["error_class"]) for r in user_prompts(questions, contexts).collect()}
    assert got == {0: (False, None), 1: (True, "unknown_dataset")}
    assert {r["db_id"]: r["approx_tokens"] for r in dataset_volumes(questions, catalog).collect()} == {"a": 10, "gone": None}
    assert [tuple(r) for r in unknown_datasets(questions, catalog).collect()] == [("gone", 1)]
    with pytest.raises(ValueError):
        require_datasets(questions, catalog)


def test_resume_takes_a_repeated_response_once(spark):
    from tallyframe.operators.work import QUESTION_FIELDS, resume_merge
    ddl = "index long, " + ", ".join(f"{f} string" for f in QUESTION_FIELDS[1:])
    questions = spark.createDataFrame([(0, *"abcdefg"), (1, *"abcdefg")], ddl)
    answers = spark.createDataFrame([(0, *"abcdefg", "[]", "")], ddl + ", result string, raw_output string")
    batch = spark.createDataFrame([(1, "[[1]]", "x"), (1, "[[2]]", "y")], "index long, result string, raw_output string").coalesce(1)
    got = sorted((r["index"], r["result"]) for r in resume_merge(answers, questions, batch).collect())
    assert got == [(0, "[]"), (1, "[[2]]")]


def test_gold_statements_are_isolated(spark):
    from tallyframe.operators.evaluate import evaluate_run, execute_gold, mismatch_preview

    def register(session, db_id):
        session.createDataFrame([("a", 1), ("b", 2)], "k string, v int").createOrReplaceTempView("t")
    sql = ["DROP VIEW t", "SELECT 'abc' AS x, k AS x FROM t", "INSERT INTO t VALUES ('c', 3)", "CREATE VIEW u AS SELECT 1",
           "SELECT v FROM t", "SELECT k, v FROM t ORDER BY v DESC -- newest first", "SELECT v / 0 FROM t WHERE k LIKE 'a'"]
    questions = spark.createDataFrame([(i, "d", s) for i, s in enumerate(sql)], "index long, db_id string, sql string")
    results = ["[]", '[["abc","a"],["abc","b"]]', "[]", "[]", "[[1]]", '[["b",2],["a",1]]', "[[null]]"]
    answers = spark.createDataFrame(list(enumerate(results)), "index long, result string")
    rows, status = execute_gold(spark, questions, register)
    details = evaluate_run(answers, questions, rows, status)
    got = {r["index"]: r["reason"].split(":")[0] for r in details.collect()}
    failed = "gold_sql_error"
    assert got == {0: failed, 1: "match", 2: failed, 3: failed, 4: "value_mismatch", 5: "match", 6: "match"}
    shown = {r["index"]: r for r in mismatch_preview(details, 10, 3, rows).collect()}
    assert shown[4]["expected"] == [["1"], ["2"]] and shown[4]["predicted"] == [["1"]]
    assert len(shown[0]["detail"]) >= len(shown[0]["reason"]) - len("gold_sql_error:")
    assert sorted(r["dialect_risk"] or "" for r in status.collect())[-1] == "division,like"
