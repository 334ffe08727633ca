"""Comparison and scoring queries: every event is a question with an answer."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.values import (decode_result, json_list, result_rows, scalars_equal, typed_cell)
from tallyframe.operators.compare import (column_order_mismatch, compare_rows, is_order_sensitive,
                                          preview)
from tallyframe.operators.evaluate import (accuracy_breakdown, accuracy_score, evaluate_run,
                                           execute_gold, execution_accuracy, gold_key,
                                           mismatch_preview, report_tables, score_rows, summarize, wrong_indices)
from tallyframe.operators.longform import compare_long
from tallyframe.plans.messy import by_key, money
from tallyframe.plans.registry import TABLES, query, table
from tallyframe.session import materialize, shared_dir


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("compare_tolerance", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE (l_orderkey + l_linenumber) % 5
    WHEN 2 THEN l_extendedprice * 1e-9 >= 0.02 WHEN 3 THEN false ELSE true END AS equal
FROM lineitem""")
def compare_tolerance(spark, sf_dir):
    """Within tolerance, outside it, one null, both null, equal."""
    price = F.col("l_extendedprice")
    none = F.lit(None).cast("double")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    pairs = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        by_key(k, 5, price, price, price, price, none).alias("gold"),
        by_key(k, 5, price, price + 0.004, price - 0.02, none, none).alias("pred"))
    return pairs.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        scalars_equal(F.col("gold"), F.col("pred")).alias("equal"))


def answer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and answer texts per event; the answer departs from gold in one of
    twelve ways. Odd users' questions ask for an order."""
    k, kind, user = F.col("event_id") % 12, F.col("event_type"), F.col("user_id").cast("string")
    value = money(F.col("value"))

    def rows(first: Column, second: Column) -> Column:
        return _cat("[", first, ", ", second, "]")

    def row(*cells) -> Column:
        parts = []
        for i, c in enumerate(cells):
            parts += [", ", c] if i else [c]
        return _cat("[", *parts, "]")

    def text(c: Column) -> Column:
        return _cat('"', c, '"')
    first, second = row(text(kind), value), row(text(_cat("user ", user)), user)
    near = money(F.col("value") + 0.0)
    close = (F.col("value").cast("decimal(18,2)") + F.lit(0.004).cast("decimal(18,3)")).cast("string")
    far = (F.col("value").cast("decimal(18,2)") + F.lit(0.5).cast("decimal(18,3)")).cast("string")
    cases = (
        rows(first, second),                                            # 0 equal
        rows(row(text(kind), close), second),                           # 1 within tolerance
        rows(row(text(kind), far), second),                             # 2 outside it
        rows(second, first),                                            # 3 rows swapped
        rows(row(text(kind), value, "1"), row(text(_cat("user ", user)), user, "2")),  # 4 more columns
        rows(row(text(kind)), row(text(_cat("user ", user)))),          # 5 a column missing
        rows(row(value, text(kind)), row(user, text(_cat("user ", user)))),  # 6 columns swapped
        rows(row(text(kind), text(near)), second),                      # 7 number as text
        F.lit("ERROR:no_output"),                                       # 8 error
        F.lit("[]"),                                                    # 9 empty
        rows(first, _cat(second, ", ", second)),                        # 10 a row too many
        rows(row(text(kind), "null"), second),                          # 11 a null cell
    )
    result = cases[0]
    for i, case in enumerate(cases):
        result = F.when(k == i, case).otherwise(result)
    sql = F.when(F.col("user_id") % 2 == 1, "SELECT a, b FROM t ORDER BY a").otherwise("SELECT a, b FROM t")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("index"), kind.alias("question_style"),
        F.when(F.col("value") > 100, "Moderate").otherwise("Simple").alias("sql_complexity"),
        result.alias("result"), rows(first, second).alias("gold_text"), sql.alias("sql"))


def scored(spark, sf_dir, **options) -> DataFrame:
    answers = answer_table(spark, sf_dir).withColumns({
        "predicted": decode_result(F.col("result")), "gold": result_rows(json_list(F.col("gold_text")))})
    return score_rows(answers, **options)


# Which cases match: swapped rows only where no order is asked for. A swapped
# pair of rows keeps each column's values, so columns still match one by one.
OK = "(event_id % 12 IN (0, 1, 4, 6) OR (event_id % 12 = 3 AND user_id % 2 = 0))"
DETAILS = f"""
details AS (SELECT event_id AS "index", event_type AS question_style,
    CASE WHEN value > 100 THEN 'Moderate' ELSE 'Simple' END AS sql_complexity,
    CASE WHEN {OK} THEN 'correct' ELSE 'wrong' END AS status,
    CASE WHEN event_id % 12 = 8 THEN 'invalid_result:ERROR:no_output' WHEN {OK} THEN 'match'
         ELSE 'value_mismatch' END AS reason FROM events)"""


@query("score_answers", oracle=f'WITH {DETAILS} SELECT "index", status, reason FROM details')
def score_answers(spark, sf_dir):
    return scored(spark, sf_dir).select("index", "status", "reason")


@query("compare_strict_columns", oracle="""
SELECT event_id AS "index", event_id % 12 IN (0, 1) OR (event_id % 12 = 3 AND user_id % 2 = 0) AS same FROM events""")
def compare_strict(spark, sf_dir):
    """Same columns in the same places."""
    return scored(spark, sf_dir, strict_columns=True).select(
        "index", (F.col("status") == "correct").alias("same"))


@query("compare_row_aligned", oracle="""
SELECT event_id AS "index", event_id % 12 IN (0, 1) OR (event_id % 12 = 3 AND user_id % 2 = 0) AS same FROM events""")
def compare_aligned(spark, sf_dir):
    """Whole rows paired."""
    return scored(spark, sf_dir, row_aligned=True).select("index", (F.col("status") == "correct").alias("same"))


def _two_rows(a: Column, b: Column) -> Column:
    return result_rows(json_list(_cat("[[", a, "], [", b, "]]")))


@query("compare_independent_columns", oracle="""
SELECT event_id AS "index", true AS by_column, false AS by_row FROM events""")
def compare_independent(spark, sf_dir):
    """Cells re-paired across rows: columns match, rows do not."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    low, high = user, (F.col("user_id") + 10).cast("string")
    gold = _two_rows(_cat('"', kind, '", ', low), _cat('"z', kind, '", ', high))
    pred = _two_rows(_cat('"', kind, '", ', high), _cat('"z', kind, '", ', low))
    sides = table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), gold.alias("g"), pred.alias("p"))
    no = F.lit(False)
    return sides.select("index", compare_rows(F.col("p"), F.col("g"), no).alias("by_column"),
                        compare_rows(F.col("p"), F.col("g"), no, row_aligned=True).alias("by_row"))


@query("compare_text_order", oracle="""
WITH n AS (SELECT event_id, CAST(value AS DECIMAL(18,2)) AS v FROM events),
t AS (SELECT event_id, v, rtrim(rtrim(CAST(v AS VARCHAR), '0'), '.') AS a,
        rtrim(rtrim(CAST(v + 0.7 AS VARCHAR), '0'), '.') AS b,
        rtrim(rtrim(CAST(CAST(v + 0.005 AS DECIMAL(18,3)) AS VARCHAR), '0'), '.') AS c FROM n)
SELECT event_id AS "index", (a < b) = (c < b) AS text_order, true AS numeric_order FROM t""")
def compare_text_order(spark, sf_dir):
    """Numbers sorted as text can pair up wrongly; sorted by value they cannot."""
    v = F.col("value").cast("decimal(18,2)")
    high = (v + F.lit(0.7).cast("decimal(18,2)")).cast("decimal(18,2)").cast("string")
    near = (v + F.lit(0.005).cast("decimal(18,3)")).cast("decimal(18,3)").cast("string")
    sides = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("index"), _two_rows(v.cast("string"), high).alias("g"),
        _two_rows(high, near).alias("p"))
    no = F.lit(False)
    return sides.select("index", compare_rows(F.col("p"), F.col("g"), no).alias("text_order"),
                        compare_rows(F.col("p"), F.col("g"), no, order="numeric").alias("numeric_order"))


@query("order_sensitivity", oracle="""
SELECT doc_id, regexp_matches(lower(text || ' order' || chr(10) || ' by ' || lang), '\\border\\s+by\\b') AS asked,
  false AS plain FROM documents""")
def order_sensitivity(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", is_order_sensitive(_cat(F.col("text"), " Order\n BY ", F.col("lang"))).alias("asked"),
                    is_order_sensitive(_cat("reorder byte ", F.col("lang"))).alias("plain"))


@query("decode_results", oracle="""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN -1 ELSE 2 END :: BIGINT AS n_rows,
  CASE event_id % 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END :: BIGINT AS width,
  CASE WHEN event_id % 3 <> 0 THEN event_type END AS first_text FROM events""")
def decode_results(spark, sf_dir):
    """Errors decode to null; a bare item becomes a one-cell row."""
    kind, value = F.col("event_type"), money(F.col("value"))
    raw = by_key(F.col("event_id"), 3, _cat("ERROR:parse_failed:", kind),
                 _cat('[["', kind, '", ', value, '], [1, true]]'), _cat('["', kind, '", ', value, "]"))
    rows = table(spark, sf_dir, "events").select("event_id", decode_result(raw).alias("r"))
    first = F.try_element_at("r", F.lit(1))
    return rows.select("event_id", F.coalesce(F.size("r"), F.lit(-1)).cast("bigint").alias("n_rows"),
                       F.when(F.col("r").isNotNull(), F.size(first)).cast("bigint").alias("width"),
                       F.try_element_at(first, F.lit(1))["text"].alias("first_text"))


@query("exec_accuracy", oracle=f"""
SELECT event_id AS instance_id, {OK} AND value > 20 AS correct,
  CASE WHEN value <= 20 THEN 'no gold found' WHEN event_id % 12 = 8 THEN 'timeout' END AS error
FROM events""")
def exec_accuracy(spark, sf_dir):
    """Scoring by instance: ids without gold, own errors, stale gold versions."""
    a = answer_table(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    predictions = a.select(F.col("index").alias("instance_id"), F.when(
        F.col("result").startswith("ERROR"), '{"error": "timeout"}').otherwise(F.col("result")).alias("exec_answer"),
        F.col("sql").alias("sql_answer"))
    known = e.where(F.col("value") > 20).select(F.col("event_id").alias("index"))
    gold = a.join(known, "index").select(F.col("index").alias("instance_id"), F.explode(F.array(
        F.struct(F.lit(2).alias("version"), F.col("gold_text").alias("exec_answer")),
        F.struct(F.lit(1).alias("version"), F.lit('[["stale"]]').alias("exec_answer")))).alias("g"))
    return execution_accuracy(predictions, gold.select("instance_id", "g.*"), version="version")


@query("exec_accuracy_score", oracle=f"""
SELECT avg(CASE WHEN {OK} AND value > 20 THEN 1.0 ELSE 0.0 END) AS score,
  count(*) FILTER ({OK} AND value > 20) AS correct, count(*) AS total FROM events""")
def exec_accuracy_score(spark, sf_dir):
    return accuracy_score(exec_accuracy(spark, sf_dir))


@query("eval_summary", oracle=f"""
WITH {DETAILS} SELECT count(*) AS total, count(*) FILTER (status = 'correct') AS correct,
  count(*) FILTER (status = 'wrong') AS wrong, count(*) FILTER (reason LIKE 'invalid_result%') AS error_outputs,
  round(count(*) FILTER (status = 'correct') * 100.0 / count(*), 6) AS accuracy_percent FROM details""")
def eval_summary(spark, sf_dir):
    return summarize(scored(spark, sf_dir)).withColumn("accuracy_percent", F.round("accuracy_percent", 6))


@query("wrong_indices", oracle=f"""WITH {DETAILS} SELECT "index" FROM details WHERE status = 'wrong'""")
def wrong(spark, sf_dir):
    return wrong_indices(scored(spark, sf_dir))


@query("eval_preview", oracle="""
SELECT 3 :: BIGINT AS "index", 'value_mismatch' AS reason, min(year(o_orderdate)) || '|' || (min(year(o_orderdate)) + 1) AS expected,
  (min(year(o_orderdate)) + 1) || '|' || (min(year(o_orderdate)) + 2) AS predicted, true AS whole FROM orders
UNION ALL SELECT 2, 'value_mismatch', string_agg(o_orderkey, '|' ORDER BY o_totalprice DESC, o_orderkey),
  string_agg(o_orderkey, '|' ORDER BY o_orderkey), true FROM (
  SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)
UNION ALL SELECT 5, 'gold_sql_error', NULL, '', true
UNION ALL SELECT 6, 'value_mismatch', 'a', 'b', true""")
def eval_preview(spark, sf_dir):
    """Expected beside predicted rows, also where sizes differ: first cells of the first two rows.

    The top-k answer (2) is compared by its two largest orders.
    """
    asked = gold_questions(spark).where("index IN (2, 3, 5)").withColumn("sql", F.regexp_replace(
        F.regexp_replace("sql", "LIMIT 5", "LIMIT 2"), "GROUP BY 1;", "GROUP BY 1 ORDER BY 1;"))
    twin = spark.createDataFrame([(6, "warehouse", "SELECT 'a' AS x, 1 AS x")], asked.schema)
    answers = materialize(worked_answers(spark, sf_dir, top=2).where("index IN (2, 3, 5)").unionByName(
        table(spark, sf_dir, "orders").agg(F.lit(6).cast("bigint").alias("index"), F.lit('[["b",1]]').alias("result"))), "answers")
    asked = asked.unionByName(twin)
    rows, status = execute_gold(spark, asked, _register(spark, sf_dir))
    shown = mismatch_preview(evaluate_run(answers, asked, rows, status), 10, 2, rows)

    def first_cells(side: str) -> Column:
        return F.array_join(F.transform(side, lambda r: F.try_element_at(r, F.lit(1))), "|")
    return shown.select("index", F.regexp_replace("reason", "(?s):.*", "").alias("reason"),
                        F.when(F.col("expected").isNotNull(), first_cells("expected")).alias("expected"),
                        first_cells("predicted").alias("predicted"),
                        ((F.col("reason") == "value_mismatch") | F.col("detail").contains("no_such_column")).alias("whole"))


@query("preview_rows", oracle="""
SELECT event_id AS "index", event_type || '|' || regexp_replace(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '')
  || '|user ' || user_id || '|' || user_id AS shown FROM events""")
def preview_rows(spark, sf_dir):
    rows = answer_table(spark, sf_dir).select("index", result_rows(json_list(F.col("gold_text"))).alias("r"))
    return rows.select("index", F.array_join(F.flatten(preview(F.col("r"))), "|").alias("shown"))


@query("column_order_mismatch", oracle="""
SELECT event_id AS "index", event_id % 12 = 6 AS swapped FROM events WHERE event_id % 12 <> 8""")
def order_mismatch(spark, sf_dir):
    """Right values, swapped columns. Answers that are errors have no rows to test."""
    a = answer_table(spark, sf_dir).select(
        "index", decode_result(F.col("result")).alias("p"), result_rows(json_list(F.col("gold_text"))).alias("g"))
    return a.where(F.col("p").isNotNull()).select(
        "index", column_order_mismatch(F.col("p"), F.col("g")).alias("swapped"))


@query("accuracy_cube", oracle=f"""
WITH {DETAILS} SELECT sql_complexity, question_style, count(*) AS total,
  count(*) FILTER (status = 'correct') AS correct,
  round(avg(CASE status WHEN 'correct' THEN 1.0 ELSE 0.0 END) * 100, 4) AS accuracy_percent
FROM details GROUP BY CUBE (sql_complexity, question_style)""")
def accuracy_cube(spark, sf_dir):
    details = scored(spark, sf_dir)
    return accuracy_breakdown(details.select("index", "status"), answer_table(spark, sf_dir))


# Gold statements over the given tables: having, in-list, top-k, derived key,
# an empty result, a statement that fails, repeated names and a command.
GOLD_SQL = {
    "having": "SELECT o_orderpriority, AVG(o_totalprice) AS a FROM orders GROUP BY o_orderpriority HAVING AVG(o_totalprice) > 1000",
    "in_list": "SELECT c_mktsegment, COUNT(*) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    "by_year": "SELECT CAST(YEAR(o_orderdate) AS INT) AS y, SUM(o_totalprice) FROM orders GROUP BY 1;",
    "empty": "SELECT p_name FROM part WHERE p_size < 0",
    "broken": "SELECT no_such_column FROM region",
    "same_names": "SELECT 'abc' AS x, 7/2 AS x, r_name AS x FROM region WHERE r_name LIKE 'EU%'",
    "command": "DROP VIEW region",
    "after_command": "SELECT COUNT(*) FROM region",
}


def gold_questions(spark) -> DataFrame:
    rows = [(i, "warehouse", sql) for i, sql in enumerate(GOLD_SQL.values())]
    return spark.createDataFrame(rows, "index bigint, db_id string, sql string")


def _register(spark: SparkSession, sf_dir: str):
    """Registers the tables as views; their schemas are read once for all statements."""
    schemas = {name: table(spark, sf_dir, name).schema for name in TABLES}

    def register(session: SparkSession, db_id: str) -> None:
        for name, schema in schemas.items():
            session.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return register


@query("gold_execution", oracle="""
SELECT * FROM (
  SELECT 0 :: BIGINT AS "index", o_orderpriority AS key, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 2
  UNION ALL SELECT 1, c_mktsegment, count(*) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 2
  UNION ALL (SELECT 2, CAST(o_orderkey AS VARCHAR), round(o_totalprice, 2) FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)
  UNION ALL SELECT 3, CAST(year(o_orderdate) AS VARCHAR), round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) FROM orders GROUP BY 2
  UNION ALL SELECT 6, 'abc', 3.5 FROM region WHERE r_name LIKE 'EU%'
  UNION ALL SELECT 8, CAST(count(*) AS VARCHAR), NULL FROM region)""")
def gold_execution(spark, sf_dir):
    """The statements' rows as cells, each statement run once."""
    asked = gold_questions(spark)
    rows, _ = execute_gold(spark, asked, _register(spark, sf_dir))
    ids = asked.select("index", gold_key(F.col("db_id"), F.col("sql")).alias("gold_id"))
    return rows.join(F.broadcast(ids), "gold_id").select(
        "index", F.col("cells")[0]["text"].alias("key"),
        F.round(F.try_element_at("cells", F.lit(2))["num"], 2).alias("value"))


@query("gold_status", oracle="""
SELECT i :: BIGINT AS "index", i IN (5, 7) AS failed, CASE WHEN i = 6 THEN 'division,like' END AS dialect_risk FROM range(9) t(i)
WHERE (SELECT count(*) FROM region) > 0""")
def gold_status(spark, sf_dir):
    """Which statements failed; a command fails and changes nothing for the others."""
    asked = gold_questions(spark)
    _, status = execute_gold(spark, asked, _register(spark, sf_dir))
    ids = asked.select("index", gold_key(F.col("db_id"), F.col("sql")).alias("gold_id"))
    return ids.join(status, "gold_id").select("index", F.col("error").isNotNull().alias("failed"), "dialect_risk")


def worked_answers(spark, sf_dir: str, top: int = 5) -> DataFrame:
    """(index, result) for the gold statements, worked out from the tables.

    Each answer holds one row per priority, segment, year or rank, so its array is
    small by construction.
    """
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")

    def answer(index: int, df: DataFrame, *cells: Column) -> DataFrame:
        # Cells are JSON texts already: numbers stay numbers in one array of mixed cells.
        row = F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]"))
        return df.agg(F.sort_array(F.collect_list(row)).alias("r")).select(
            F.lit(index).cast("bigint").alias("index"),
            F.concat(F.lit("["), F.array_join("r", ","), F.lit("]")).alias("result"))

    def quoted(name: str) -> Column:
        return F.concat(F.lit('"'), F.col(name), F.lit('"'))
    by_priority = orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("a"))
    segments = (customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
                .groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")))
    best = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(top)
    years = orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    first_year = years.agg(F.min("y").alias("y0"))
    late = years.join(F.broadcast(first_year), F.col("y") > F.col("y0"))
    europe = table(spark, sf_dir, "region").where("r_name LIKE 'EU%'")
    answers = answer(0, by_priority, quoted("o_orderpriority"), F.col("a").cast("string"))
    for part in (answer(1, segments, quoted("c_mktsegment"), F.col("n").cast("string")),
                 answer(2, best, F.lpad(F.col("o_orderkey").cast("string"), 12, " "), money(F.col("o_totalprice"))),
                 answer(3, late, F.col("y").cast("string"), money(F.col("s"))),
                 answer(4, orders.where("false"), quoted("o_orderpriority")),
                 answer(5, orders.where("false"), quoted("o_orderpriority")),
                 answer(6, europe, F.lit('"abc"'), F.lit("3.5"), quoted("r_name")),
                 answer(7, europe, quoted("r_name")),
                 answer(8, table(spark, sf_dir, "region").groupBy().count(), F.col("count").cast("string"))):
        answers = answers.unionByName(part)
    return answers


@query("evaluation_run", oracle="""
SELECT * FROM (VALUES (0 :: BIGINT, 'correct', 'match'), (1, 'correct', 'match'), (2, 'wrong', 'value_mismatch'),
  (3, 'wrong', 'value_mismatch'), (4, 'correct', 'match'), (5, 'wrong', 'gold_sql_error'), (6, 'correct', 'match'),
  (7, 'wrong', 'gold_sql_error'), (8, 'correct', 'match')) t("index", status, reason)
WHERE (SELECT count(*) FROM orders) > 5""")
def evaluation_run(spark, sf_dir):
    """Answers worked out from the tables against executed gold SQL.

    Averages rounded to two decimals match; a top-k in key order, a year left
    out, a failing statement and a command do not. Answers are stored once, since
    scoring reads them more than once.
    """
    answers = materialize(worked_answers(spark, sf_dir), "answers")
    asked = gold_questions(spark)
    rows, status = execute_gold(spark, asked, _register(spark, sf_dir))
    return evaluate_run(answers, asked, rows, status).select(
        "index", "status", F.regexp_replace("reason", "(?s):.*", "").alias("reason"))


#: Statements that fail only when they run, and one that does not.
FAILING_SQL = ("SELECT (SELECT r_regionkey FROM region) AS x FROM nation",
               "SELECT raise_error(concat('stop at ', r_name)) AS x FROM region",
               "SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey")


@query("gold_runtime_errors", oracle="""
SELECT 0 :: BIGINT AS "index", 'SCALAR_SUBQUERY_TOO_MANY_ROWS' AS condition, 0 :: BIGINT AS n_gold, 'wrong' AS status, 'gold_sql_error' AS reason
WHERE (SELECT count(*) FROM region) > 1
UNION ALL SELECT 1, 'USER_RAISED_EXCEPTION', 0, 'wrong', 'gold_sql_error' WHERE (SELECT count(*) FROM region) > 0
UNION ALL SELECT 2, NULL, count(DISTINCT n_regionkey), 'correct', 'match' FROM nation""")
def gold_runtime_errors(spark, sf_dir):
    """A failing statement is an error row whenever it fails; the others are scored."""
    asked = spark.createDataFrame([(i, "warehouse", sql) for i, sql in enumerate(FAILING_SQL)], "index bigint, db_id string, sql string")
    per_region = table(spark, sf_dir, "nation").groupBy("n_regionkey").count()
    row = F.concat(F.lit("["), F.col("n_regionkey").cast("string"), F.lit(","), F.col("count").cast("string"), F.lit("]"))
    right = per_region.agg(F.array_join(F.sort_array(F.collect_list(row)), ",").alias("r")).select(
        F.concat(F.lit("["), "r", F.lit("]")).alias("result"))
    answers = materialize(spark.range(3).withColumnRenamed("id", "index").crossJoin(F.broadcast(right)), "answers")
    rows, status = execute_gold(spark, asked, _register(spark, sf_dir))
    details = evaluate_run(answers, asked, rows, status)
    found = details.join(status.select("gold_id", "condition"), "gold_id")
    return found.select("index", "condition", F.col("n_gold").cast("bigint").alias("n_gold"), "status",
                        F.regexp_replace("reason", "(?s):.*", "").alias("reason"))


#: How an answer of all orders departs from the gold set.
_LONG_CASES = ("within tolerance", "one cell off", "columns swapped, one more", "one row missing", "other order", "same order")


@query("compare_long", oracle="""
WITH g AS (SELECT o_orderkey AS k, o_orderstatus || o_orderpriority AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders),
edge AS (SELECT max(k) AS top, count(*) AS n FROM g),
p AS (SELECT i, CAST(k AS VARCHAR) AS k, s, v + CASE i WHEN 0 THEN 0.004 WHEN 1 THEN CASE WHEN k = top THEN 0.5 ELSE 0 END ELSE 0 END AS v,
        CASE i WHEN 4 THEN -k ELSE k END AS place FROM g, edge, range(6) t(i) WHERE NOT (i = 3 AND k = top)),
gold AS (SELECT i, 'k' AS c, CAST(k AS VARCHAR) AS x, NULL AS v, CASE WHEN i >= 4 THEN lpad(CAST(k AS VARCHAR), 20, '0') ELSE CAST(k AS VARCHAR) END AS o FROM g, range(6) t(i)
  UNION ALL SELECT i, 's', s, NULL, CASE WHEN i >= 4 THEN lpad(CAST(k AS VARCHAR), 20, '0') ELSE s END FROM g, range(6) t(i)
  UNION ALL SELECT i, 'v', '', v, CASE WHEN i >= 4 THEN lpad(CAST(k AS VARCHAR), 20, '0') ELSE CAST(v AS VARCHAR) END FROM g, range(6) t(i)),
pred AS (SELECT i, 'k' AS c, k AS x, NULL AS v, CASE WHEN i >= 4 THEN lpad(CAST(place + 1e15 :: BIGINT AS VARCHAR), 20, '0') ELSE k END AS o FROM p
  UNION ALL SELECT i, 's', s, NULL, CASE WHEN i >= 4 THEN lpad(CAST(place + 1e15 :: BIGINT AS VARCHAR), 20, '0') ELSE s END FROM p
  UNION ALL SELECT i, 'v', '', v, CASE WHEN i >= 4 THEN lpad(CAST(place + 1e15 :: BIGINT AS VARCHAR), 20, '0') ELSE CAST(v AS VARCHAR) END FROM p),
a AS (SELECT *, row_number() OVER (PARTITION BY i, c ORDER BY o) AS r FROM gold),
b AS (SELECT *, row_number() OVER (PARTITION BY i, c ORDER BY o) AS r FROM pred),
m AS (SELECT a.i, a.c, count(b.r) AS pairs, bool_and(coalesce(a.x = b.x AND (a.v IS NULL AND b.v IS NULL OR abs(a.v - b.v) <= 0.01), false)) AS ok
      FROM a LEFT JOIN b ON a.i = b.i AND a.c = b.c AND a.r = b.r GROUP BY a.i, a.c)
SELECT m.i AS "index", bool_and(ok AND pairs = (SELECT n FROM edge)) AS same FROM m GROUP BY m.i""")
def compare_all_orders(spark, sf_dir):
    """Gold rows of all orders against six answers of that size, no array per result set."""
    o = table(spark, sf_dir, "orders")
    top = F.broadcast(o.agg(F.max("o_orderkey").alias("top")))
    kind, key = F.concat("o_orderstatus", "o_orderpriority"), F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    gold = o.select("o_orderkey", F.array(typed_cell(key, "bigint"), typed_cell(kind, "string"), typed_cell(price, "decimal(18,2)")).alias("cells"))
    case = F.col("case")
    shifted = (price + F.when(case == 0, F.lit(0.004)).when((case == 1) & (key == F.col("top")), F.lit(0.5)).otherwise(F.lit(0.0))
               .cast("decimal(18,3)")).cast("decimal(18,3)")
    k, s, v = typed_cell(key, "bigint"), typed_cell(kind, "string"), typed_cell(shifted, "decimal(18,3)")
    answers = (o.crossJoin(top).withColumn("case", F.explode(F.array(*[F.lit(i) for i in range(len(_LONG_CASES))])))
               .where(~((case == 3) & (key == F.col("top")))))
    predicted = answers.select(case.cast("bigint").alias("index"), F.when(case == 4, -key).otherwise(key).alias("row_no"),
                               F.when(case == 2, F.array(v, s, k, typed_cell(F.lit(1), "int"))).otherwise(F.array(k, s, v)).alias("cells"))
    pairs = spark.range(len(_LONG_CASES)).select(F.col("id").alias("index"), F.when(F.col("id") < 4, "any").otherwise("ordered").alias("gold_id"),
                                                 (F.col("id") >= 4).alias("ordered"))
    golds = gold.select(F.explode(F.array(F.lit("any"), F.lit("ordered"))).alias("gold_id"), F.col("o_orderkey").alias("row_no"), "cells")
    return compare_long(pairs, predicted, golds)


@query("evaluation_report", oracle="""
SELECT 0 :: BIGINT AS "index", 'wrong' AS status, 'value_mismatch' AS reason, count(*) AS n_gold, 1 :: BIGINT AS n_predicted, count(*) AS expected_rows,
  CAST(sum(o_orderkey) AS DOUBLE) AS expected_keys, 1 :: BIGINT AS predicted_rows, CAST(min(o_orderkey) AS VARCHAR) AS predicted_first FROM orders
UNION ALL SELECT 1, 'correct', 'match', count(*), count(*), 0, NULL, 0, NULL FROM nation
UNION ALL SELECT 2, 'wrong', 'gold_sql_error', 0, 0, 0, NULL, 0, NULL WHERE (SELECT count(*) FROM region) > 1
UNION ALL SELECT 3, 'wrong', 'value_mismatch', count(*), count(*), count(*), CAST(sum(n_nationkey) AS DOUBLE), count(*), min(CAST(n_nationkey AS VARCHAR)) FROM nation""")
def evaluation_report(spark, sf_dir):
    """A run's report, written and read back: every wrong answer beside all gold rows.

    Sets of more than ten rows count as beyond a cell here, so nations are compared in
    long form, once equal and once with two columns' cells out of step.
    """
    sql = ["SELECT o_orderkey, o_totalprice FROM orders", "SELECT n_name, n_regionkey FROM nation", FAILING_SQL[0],
           "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey"]
    asked = spark.createDataFrame([(i, "warehouse", s) for i, s in enumerate(sql)], "index bigint, db_id string, sql string")
    n = table(spark, sf_dir, "nation")

    def answer(index: int, df: DataFrame, row: Column) -> DataFrame:
        return df.agg(F.array_join(F.sort_array(F.collect_list(row)), ",").alias("r")).select(
            F.lit(index).cast("bigint").alias("index"), F.concat(F.lit("["), "r", F.lit("]")).alias("result"))
    first = table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(1)
    nations = _cat('["', F.col("n_name"), '",', F.col("n_regionkey").cast("string"), "]")
    shifted = _cat("[", F.col("n_nationkey").cast("string"), ',"', F.col("n_name"), '?"]')
    answers = materialize(answer(0, first, _cat("[", F.col("o_orderkey").cast("string"), ",0]")).unionByName(answer(1, n, nations))
                          .unionByName(answer(2, n.where("false"), nations)).unionByName(answer(3, n, shifted)), "answers")
    rows, status = execute_gold(spark, asked, _register(spark, sf_dir))
    report = report_tables(materialize(evaluate_run(answers, asked, rows, status, cell_rows=10), "details"), rows)
    root = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    back = {}
    for name, part in report.items():
        part.write.json(f"{root}/{name}")
        back[name] = spark.read.schema(part.schema).json(f"{root}/{name}")
    first_cell = F.try_element_at("cells", F.lit(1))
    expected = back["expected"].groupBy("index").agg(F.count(F.lit(1)).alias("expected_rows"), F.sum(first_cell.cast("double")).alias("expected_keys"))
    predicted = back["predicted"].groupBy("index").agg(F.count(F.lit(1)).alias("predicted_rows"), F.min(first_cell).alias("predicted_first"))
    zero = F.lit(0)
    return back["answers"].join(expected, "index", "left").join(predicted, "index", "left").select(
        "index", "status", F.regexp_replace("reason", "(?s):.*", "").alias("reason"), F.coalesce("n_gold", zero).alias("n_gold"),
        F.coalesce("n_predicted", zero).alias("n_predicted"), F.coalesce("expected_rows", zero).alias("expected_rows"), "expected_keys",
        F.coalesce("predicted_rows", zero).alias("predicted_rows"), "predicted_first")
