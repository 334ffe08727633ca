"""Result parsing queries: every event prints a small result in some shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.parse import error_counts, parse_results, reparse, reparse_summary
from tallyframe.plans.messy import by_key, money
from tallyframe.plans.registry import query, table


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def kind() -> Column:
    return F.col("event_type")


def value() -> Column:
    return money(F.col("value"))


def user() -> Column:
    return F.col("user_id").cast("string")


# The same value as JSON prints it: no trailing zeros.
NUM = "regexp_replace(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '')"
PAIR = f"""'[["' || event_type || '",' || {NUM} || '],[' || user_id || ',null]]'"""


def _parsed(spark, sf_dir, text: Column, **options) -> DataFrame:
    printed = table(spark, sf_dir, "events").select("event_id", "event_type", text.alias("printed"))
    return parse_results(printed, "printed", **options).select(
        "event_id", "result", F.col("parse_stage").alias("stage"))


def json_text() -> Column:
    return _cat('[["', kind(), '", ', value(), "], [", user(), ", null]]")



@query("parse_json", oracle=f"SELECT event_id, {PAIR} AS result, 'json' AS stage FROM events")
def parse_json(spark, sf_dir):
    return _parsed(spark, sf_dir, _cat(" \n", json_text(), "\n"))


@query("parse_flat_json", oracle=f"""
SELECT event_id, CASE WHEN event_type = 'error' THEN '[null,' || user_id || ']'
  ELSE '["' || event_type || '",' || {NUM} || ']' END AS result, 'json' AS stage FROM events""")
def parse_flat_json(spark, sf_dir):
    """A flat list is accepted whole; bare NaN becomes null."""
    return _parsed(spark, sf_dir, F.when(kind() == "error", _cat("[NaN, ", user(), "]")).otherwise(
        _cat('["', kind(), '", ', value(), "]")))


@query("parse_last_array", oracle=f"""
SELECT event_id, CASE event_id % 3 WHEN 2 THEN '[]' ELSE {PAIR} END AS result, 'last_array' AS stage FROM events""")
def parse_last_array(spark, sf_dir):
    """The last array that parses: later ones may be broken, or empty."""
    text = _cat("rows: [[1, 2], [3, 4]]\nthen ", json_text())
    return _parsed(spark, sf_dir, by_key(F.col("event_id"), 3, _cat(text, " done."),
                                         _cat(text, " and [[oops]] at the end"),
                                         _cat(text, "\nnothing left: []\n.")))


@query("parse_python_list", oracle=f"""
SELECT event_id, CASE event_id % 4
    WHEN 0 THEN '[["' || event_type || '",null],["it",' || {NUM} || '],[null,true]]'
    WHEN 1 THEN '[["' || event_type || '",' || user_id || ']]'
    WHEN 2 THEN '[["it''s ' || event_type || '",' || {NUM} || ']]'
    ELSE '[["None of ' || event_type || '",' || user_id || '],["x",false]]' END AS result, 'literal' AS stage
FROM events""")
def parse_python_list(spark, sf_dir):
    """Plain literals stay in the JVM; tuples, escapes and tricky strings do not."""
    return _parsed(spark, sf_dir, by_key(
        F.col("event_id"), 4,
        _cat("rows = [['", kind(), "', nan], ['it', np.float64(", value(), ")], [None, True]]"),
        _cat("see [('", kind(), "', ", user(), ")]\n\nthat is all"),
        _cat("[[\"it's ", kind(), '", ', value(), "], ]"),
        _cat("[1 of 2]\n\n[['None of ", kind(), "', ", user(), "], ['x', False]]")))


@query("parse_printed_table", oracle=f"""
SELECT event_id, '[["' || event_type || '",' || {NUM} || '],["user id",' || user_id || '],["x y","nan"]]' AS result,
  'table' AS stage FROM events""")
def parse_printed_table(spark, sf_dir):
    return _parsed(spark, sf_dir, _cat(
        "preview 1  2\n\n    kind   value\n0   ", kind(), "    ", value(), "\n1   user id   ", user(),
        ".0\n2   x y       nan\n"))


@query("parse_column_artifact", oracle="""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ERROR:parse_failed:''picked [["event_type", "value"]]'''
  ELSE '[["event_type","' || event_type || '"]]' END AS result,
  CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'last_array' END AS stage FROM events""")
def parse_column_artifact(spark, sf_dir):
    """A bare list of the dataset's own columns is no result."""
    names = F.array(F.lit("event_id"), F.lit("event_type"), F.lit("value"))
    return _parsed(spark, sf_dir, by_key(
        F.col("event_id"), 2, _cat('picked [["event_type", "value"]]'),
        _cat('picked [["event_type", "', kind(), '"]]')), names=names)


@query("parse_failures", oracle="""
SELECT event_id, CASE WHEN event_type = 'view' THEN 'ERROR:no_output'
    WHEN event_type = 'click' THEN 'ERROR:tool_limit_exceeded'
    ELSE 'ERROR:parse_failed:''[["' || event_type || '", ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || '], [\\n .''' END AS result
FROM events""")
def parse_failures(spark, sf_dir):
    """Blank, out of tool calls (even beside an array), and cut-off arrays."""
    return _parsed(spark, sf_dir, F.when(kind() == "view", _cat(" \n "))
                   .when(kind() == "click", _cat("Sorry, I've hit the tool limit. ", json_text()))
                   .otherwise(_cat('[["', kind(), '", ', value(), "], [\n ."))).select(
        "event_id", "result")


def _mixed() -> Column:
    return by_key(F.col("event_id"), 6, json_text(), _cat("got ", json_text(), "."),
                  _cat("[['", kind(), "', ", value(), "], [", user(), ", None]]"),
                  _cat("0  ", kind(), "  ", value(), "\n1  ", user(), "  -"),
                  F.lit("please run the code"), _cat("no result for ", user()))


@query("classify_errors", oracle="""
SELECT CASE event_id % 6 WHEN 4 THEN 'tool_limit_exceeded' ELSE 'parse_failed' END AS error_class, count(*) AS n
FROM events WHERE event_id % 6 IN (4, 5) GROUP BY 1""")
def classify_errors(spark, sf_dir):
    return error_counts(_parsed(spark, sf_dir, _mixed()))


@query("parse_stages", oracle="""
SELECT stage, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'last_array'
  WHEN 2 THEN 'literal' WHEN 3 THEN 'table' WHEN 4 THEN 'tool_limit' ELSE 'failed' END AS stage FROM events) GROUP BY stage""")
def parse_stages(spark, sf_dir):
    """How each text was read, over all shapes at once."""
    return _parsed(spark, sf_dir, _mixed()).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("parse_json_first", oracle=f"SELECT event_id, '[[\"temporarily unavailable\",' || {NUM} || ']]' AS result FROM events")
def parse_json_first(spark, sf_dir):
    """Data that holds a tool-limit phrase survives when JSON is tried first."""
    return _parsed(spark, sf_dir, _cat('[["temporarily unavailable", ', value(), "]]"), json_first=True).select(
        "event_id", "result")


def _stored(spark, sf_dir) -> DataFrame:
    framed = _cat("[CODE]\nprint([[0]])\n[/CODE]\n\n[OUTPUT]\n", json_text(), "\n[/OUTPUT]")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("index"),
        by_key(F.col("event_id"), 4, framed, json_text(), F.lit(""), _cat("ran out of tool calls")).alias("raw_output"),
        by_key(F.col("event_id"), 4, json_text(), F.lit("ERROR:parse_failed:'x'"), F.lit("[[7]]"),
               F.lit("ERROR:tool_limit_exceeded")).alias("result"))


@query("reparse_answers", oracle=f"""
SELECT event_id AS "index", CASE event_id % 4 WHEN 2 THEN '[[7]]' WHEN 3 THEN 'ERROR:tool_limit_exceeded'
  ELSE {PAIR} END AS result, event_id % 4 = 1 AS changed FROM events""")
def reparse_answers(spark, sf_dir):
    """Framed, unframed, missing and limited raw outputs; one kind changes."""
    return reparse(_stored(spark, sf_dir)).select("index", "result", "changed")


@query("reparse_changed", oracle="""
SELECT count(*) AS total, count(*) FILTER (event_id % 4 = 1) AS changed,
  count(*) FILTER (event_id % 4 = 3) AS errors, count(*) FILTER (event_id % 4 = 3) AS tool_limit FROM events""")
def reparse_changed(spark, sf_dir):
    return reparse_summary(reparse(_stored(spark, sf_dir)))
