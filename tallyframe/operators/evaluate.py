"""Gold SQL execution, run scoring, summaries and breakdowns."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.values import decode_result, result_rows, typed_cell
from tallyframe.functions.text import col, let
from tallyframe.operators.compare import compare_rows, is_order_sensitive, preview
from tallyframe.operators.longform import compare_long
from tallyframe.session import materialize, shared_dir

CELL_DDL = "struct<is_null: boolean, text: string, is_num: boolean, num: double>"
ROWS_DDL = f"array<array<{CELL_DDL}>>"


#: Classes of SQLSTATE that name what a statement itself does wrong: unsupported features,
#: cardinality, data, constraints, routines, names, syntax, limits, raised errors. Anything
#: else, such as a lost executor or a full disk, stops the run instead of passing for a
#: wrong statement.
STATEMENT_STATES = frozenset("07 0A 20 21 22 23 2B 2F 34 38 39 3D 3F 42 44 46 54 P0".split())
STATEMENTS_AT_ONCE = 4
_STATUS_ROWS = 1000
#: Result sets of up to so many rows are gathered into one cell; larger ones stay tables.
CELL_ROWS = 1_000_000
GOLD_ROWS_DDL = f"row_no bigint, cells array<{CELL_DDL}>, gold_id string"
GOLD_STATUS_DDL = "gold_id string, error string, condition string"


def rows_as_cells(df: DataFrame) -> DataFrame:
    """(row_no, cells): a result DataFrame in row order, any column types and names."""
    cells = [typed_cell(F.col(f"c{i}"), kind) for i, (_, kind) in enumerate(df.dtypes)]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(F.monotonically_increasing_id().alias("row_no"),
                        F.array(*cells).cast(f"array<{CELL_DDL}>").alias("cells"))


def _thrown(exc: BaseException):
    """The exceptions of the engine behind a Python one, outermost first."""
    cause = getattr(exc, "java_exception", None) or getattr(exc, "_origin", None)
    while cause is not None:
        yield cause
        cause = cause.getCause()


def statement_failure(exc: BaseException) -> tuple[str, str] | None:
    """(condition, message) if the statement itself is wrong, None for any other failure.

    The innermost cause that carries a SQLSTATE decides: a failed task or write only
    wraps what the statement did.
    """
    state, condition, message = None, None, str(exc)
    if isinstance(exc, PySparkException):
        state, condition = exc.getSqlState(), exc.getCondition()
    for cause in _thrown(exc):
        # Only exceptions of the engine name a condition and a state.
        if hasattr(cause, "getSqlState") and cause.getClass().getName().startswith("org.apache.spark"):
            found = _call(cause, "getSqlState")
            if found:
                state, condition, message = found, _call(cause, "getCondition"), cause.getMessage()
    return (condition or "", message) if (state or "")[:2] in STATEMENT_STATES else None


def _call(cause, name: str):
    """A getter that exceptions of the engine may lack."""
    try:
        return getattr(cause, name)()
    except Py4JError:
        return None


def execute_sql(session: SparkSession, sql: str) -> tuple[DataFrame | None, tuple[str, str] | None]:
    """(rows, None) or (None, (condition, error text)); a statement's own failures are data.

    As the source of a query only queries parse, so a command or an insert is
    refused before anything runs.
    """
    try:
        return rows_as_cells(session.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)")), None
    except Exception as exc:
        failure = statement_failure(exc)
        if failure is None:
            raise
        return None, failure


def namespace(spark: SparkSession, register: Callable[[SparkSession], None]) -> SparkSession:
    """A session of its own for one statement's views, with lenient SQL.

    Division by zero and bad casts give NULL, as gold SQL expects. What one
    statement does cannot reach another.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.ansi.enabled", "false")
    register(session)
    return session


def dialect_risk(sql: Column) -> Column:
    """What in a statement another dialect would read differently: ``division``
    (of whole numbers) and ``like`` (which may ignore case); null if neither."""
    risks = F.concat_ws(",", F.when(F.regexp_like(sql, F.lit(r"/")), "division"),
                        F.when(F.regexp_like(sql, F.lit(r"(?i)\blike\b")), "like"))
    return F.nullif(risks, F.lit(""))


def execute_gold(spark: SparkSession, questions: DataFrame,
                 register: Callable[[SparkSession, str], None]) -> tuple[DataFrame, DataFrame]:
    """Run each distinct (db_id, sql) once; returns (gold rows, gold status).

    Rows go straight from the query to a table in the shared folder: (gold_id,
    row_no, cells). Only the SQL texts pass the driver, since a statement has to
    be planned there; ``STATEMENTS_AT_ONCE`` run at a time, each in a session of
    its own. Status: (gold_id, error, condition, dialect_risk), stored in the same
    folder; a statement that fails while it runs is an error like one that fails to plan.
    """
    root = f"{shared_dir(spark)}/gold-{uuid.uuid4().hex}"
    wanted = questions.select("db_id", "sql").distinct()

    def run(q) -> tuple[str, str | None, str | None]:
        gold_id = gold_key_text(q["db_id"], q["sql"])
        rows, failure = execute_sql(namespace(spark, lambda s: register(s, q["db_id"])), q["sql"] or "")
        if rows is not None:
            try:
                rows.write.mode("overwrite").parquet(f"{root}/rows/gold_id={gold_id}")
            except Exception as exc:
                failure = statement_failure(exc)
                if failure is None:
                    raise
        return gold_id, failure and failure[1], failure and failure[0]

    spark.createDataFrame([], GOLD_ROWS_DDL).write.mode("overwrite").partitionBy("gold_id").parquet(f"{root}/rows")
    spark.createDataFrame([], GOLD_STATUS_DDL).write.parquet(f"{root}/status")
    statements = wanted.toLocalIterator()
    with ThreadPoolExecutor(STATEMENTS_AT_ONCE) as pool:
        while group := list(islice(statements, _STATUS_ROWS)):
            spark.createDataFrame(list(pool.map(run, group)), GOLD_STATUS_DDL).write.mode("append").parquet(f"{root}/status")
    rows = spark.read.schema(GOLD_ROWS_DDL).option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    risks = wanted.select(gold_key(F.col("db_id"), F.col("sql")).alias("gold_id"), dialect_risk(F.col("sql")).alias("dialect_risk"))
    return rows, spark.read.schema(GOLD_STATUS_DDL).parquet(f"{root}/status").join(risks, "gold_id", "left")


def gold_key_text(db_id: str, sql: str) -> str:
    import hashlib
    return hashlib.md5(f"{db_id}\x1f{sql or ''}".encode()).hexdigest()


def gold_key(db_id: Column, sql: Column) -> Column:
    """The id :func:`execute_gold` files a statement's rows under."""
    return F.md5(F.concat(db_id, F.lit("\x1f"), F.coalesce(sql, F.lit(""))))


def gold_for_answers(answers: DataFrame, gold_rows: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(gold_id, n_gold, gold): the gold rows of the statements that answers belong to.

    Sets of more than ``cell_rows`` rows stay in ``gold_rows`` and have a null here.
    """
    asked = answers.select("gold_id").distinct()
    sizes = gold_rows.groupBy("gold_id").agg(F.count(F.lit(1)).alias("n_gold"))
    counts = sizes.join(asked, "gold_id", "left_semi")
    # Rows of large sets leave before any shuffle by statement; each such id stands for over ``cell_rows`` rows.
    large = sizes.where(F.col("n_gold") > cell_rows).select("gold_id")
    gathered = (gold_rows.join(F.broadcast(large), "gold_id", "left_anti").join(asked, "gold_id", "left_semi")
                .groupBy("gold_id").agg(F.sort_array(F.collect_list(F.struct("row_no", "cells"))).alias("r"))
                .select("gold_id", F.transform("r", lambda x: x["cells"]).alias("gold")))
    return counts.join(gathered, "gold_id", "left")


def _same_beyond_cells(full: DataFrame, gold_rows: DataFrame, cell_rows: int, options: dict) -> DataFrame:
    """(index, same) of the answers to gold sets that are too large for a cell, compared in long form."""
    large = full.where((F.col("n_gold") > cell_rows) & F.col("predicted").isNotNull() & (F.size("predicted") == F.col("n_gold")))
    pairs = large.select("index", "gold_id", is_order_sensitive(F.col("sql")).alias("ordered"))
    predicted = large.select("index", F.posexplode("predicted").alias("row_no", "cells")).withColumn("row_no", F.col("row_no").cast("long"))
    # At most one id per ``cell_rows`` gold rows, so the rows need no shuffle.
    gold = gold_rows.join(F.broadcast(pairs.select("gold_id").distinct()), "gold_id", "left_semi")
    return compare_long(pairs, predicted, gold, **options)


def evaluate_run(answers: DataFrame, questions: DataFrame, gold_rows: DataFrame,
                 gold_status: DataFrame, cell_rows: int = CELL_ROWS, **options) -> DataFrame:
    """One detail row per answer that has a question: status, reason, rows.

    ``detail`` is the whole text behind the reason; ``gold`` and ``predicted`` are both
    sides, whatever their sizes. A gold set of more than ``cell_rows`` rows is compared
    in long form and stays a table: ``gold`` is null there, ``n_gold`` its size and
    :func:`report_tables` gives its rows. ``options`` go to :func:`compare_rows`; a set
    beyond a cell takes ``order`` and ``tolerance`` only.
    """
    asked = questions.select("index", "db_id", "sql")
    joined = (answers.select("index", "result").join(asked, "index")
              .withColumn("gold_id", gold_key(F.col("db_id"), F.col("sql")))
              .withColumn("predicted", decode_result(F.col("result"))))
    gold = gold_for_answers(joined, gold_rows, cell_rows)
    # One row per statement, then a single join: AQE can split a statement that
    # a third of all answers belong to, which it cannot in a chain of joins.
    per_statement = gold_status.join(gold, "gold_id", "left")
    full = joined.join(per_statement, "gold_id", "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))
    full = full.withColumn("gold", F.when(F.col("error").isNull() & (F.col("n_gold") == 0), F.array().cast(ROWS_DDL))
                           .otherwise(F.col("gold")))
    same = None
    if not gold_rows.groupBy("gold_id").count().where(F.col("count") > cell_rows).isEmpty():
        beyond = _same_beyond_cells(full, gold_rows, cell_rows, options)
        full, same = full.join(beyond.withColumnRenamed("same", "_same"), "index", "left"), F.col("_same")
    return score_rows(full, error=F.col("error"), same=same, **options).select(
        "index", "status", "reason", "detail", "gold_id", "gold", "predicted", "n_gold")


def score_rows(df: DataFrame, error: Column | None = None, same: Column | None = None, **options) -> DataFrame:
    """Add ``status``, ``reason`` and ``detail`` to rows holding result, sql, gold, predicted.

    The reason shows the head of a result or error, the detail all of it. ``same`` is a
    verdict found elsewhere, for gold sets beyond a cell; a null gold set without one
    is a mismatch.
    """
    error = F.lit(None).cast("string") if error is None else error
    known = F.lit(None).cast("boolean") if same is None else same
    ordered = is_order_sensitive(F.col("sql"))

    def reason(sides: Column) -> Column:
        same = F.coalesce(known, compare_rows(sides["p"], sides["g"], ordered, **options), F.lit(False))
        return (F.when(sides["p"].isNull(),
                       F.concat(F.lit("invalid_result:"), F.left("result", F.lit(80))))
                .when(error.isNotNull(), F.concat(F.lit("gold_sql_error:"), F.left(error, F.lit(120))))
                .when(same, "match").otherwise("value_mismatch"))
    both = F.struct(F.col("predicted").alias("p"), F.col("gold").alias("g"))
    return (df.withColumn("reason", let(both, reason))
            .withColumn("detail", F.when(F.col("reason").startswith("invalid_result:"), F.col("result"))
                        .when(F.col("reason").startswith("gold_sql_error:"), error))
            .withColumn("status", F.when(F.col("reason") == "match", "correct").otherwise("wrong")))


def summarize(details: DataFrame) -> DataFrame:
    """One row: totals and accuracy. Wrong indices: :func:`wrong_indices`."""
    return details.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "correct").alias("correct"),
        F.count_if(F.col("status") == "wrong").alias("wrong"),
        F.count_if(F.col("reason").startswith("invalid_result")).alias("error_outputs"),
        F.coalesce(F.try_divide(F.count_if(F.col("status") == "correct") * 100.0,
                                F.count(F.lit(1))), F.lit(0.0)).alias("accuracy_percent"))


def wrong_indices(details: DataFrame) -> DataFrame:
    """The wrong answers' indices as a table; unbounded, so not one array."""
    return details.where(F.col("status") == "wrong").select("index")


def mismatch_preview(details: DataFrame, n: int = 10, rows: int = 3,
                     gold_rows: DataFrame | None = None) -> DataFrame:
    """The first wrong answers with the first rows of each side.

    With ``gold_rows`` the expected rows come from the gold table by key, also
    where the sizes differ; only ``n`` statements are looked up and ``rows`` rows
    of each are gathered.
    """
    shown = details.where(F.col("status") == "wrong").orderBy("index").limit(n)
    if gold_rows is not None:
        shown = materialize(shown, "wrong-answers")  # n rows, looked up twice below
    else:
        return shown.select("index", "reason", preview(F.col("gold"), rows).alias("expected"),
                            preview(F.col("predicted"), rows).alias("predicted"))
    asked = gold_rows.join(F.broadcast(shown.select("gold_id").distinct()), "gold_id")  # at most n keys
    heads = (asked.withColumn("_n", F.row_number().over(Window.partitionBy("gold_id").orderBy("row_no")))
             .where(F.col("_n") <= rows).groupBy("gold_id")
             .agg(F.sort_array(F.collect_list(F.struct("_n", "cells"))).alias("_r"))
             .select("gold_id", F.transform("_r", lambda x: x["cells"]).alias("_gold")))
    return shown.join(heads, "gold_id", "left").select(
        "index", "reason", "detail", preview(F.col("_gold"), rows).alias("expected"),
        preview(F.col("predicted"), rows).alias("predicted"))


def report_tables(details: DataFrame, gold_rows: DataFrame) -> dict[str, DataFrame]:
    """The report of a run as tables: summary, answers, and both sides of every wrong answer.

    ``expected`` and ``predicted`` have one row per result row (index, row_no, cells as
    texts), so a set of any size is in the report whole.
    """
    wrong = details.where(F.col("status") == "wrong")
    texts = F.transform("cells", lambda c: F.when(~c["is_null"], c["text"]))
    expected = gold_rows.join(wrong.select("index", "gold_id"), "gold_id").select("index", "row_no", texts.alias("cells"))
    predicted = wrong.select("index", F.posexplode("predicted").alias("row_no", "cells")).select(
        "index", F.col("row_no").cast("long").alias("row_no"), texts.alias("cells"))
    answers = details.select("index", "status", "reason", "detail", "n_gold",
                             F.when(F.col("predicted").isNotNull(), F.size("predicted")).cast("long").alias("n_predicted"))
    return {"summary": summarize(details), "answers": answers, "expected": expected, "predicted": predicted}


def accuracy_breakdown(details: DataFrame, questions: DataFrame,
                       by: tuple[str, ...] = ("sql_complexity", "question_style")) -> DataFrame:
    """Accuracy over every combination of the question labels and their totals."""
    return details.join(questions.select("index", *by), "index").cube(*map(col, by)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "correct").alias("correct"),
        F.round(F.avg((F.col("status") == "correct").cast("double")) * 100, 4).alias("accuracy_percent"))


def execution_accuracy(predictions: DataFrame, gold: DataFrame, version: str | None = None,
                       **options) -> DataFrame:
    """Score predictions against gold answers by ``instance_id``.

    ``exec_answer`` is JSON text on both sides: a list of rows, or for a
    prediction an object with ``error``. ``sql_answer`` decides whether order
    counts. When gold holds an id twice, the last row by ``version`` wins.
    """
    order = col(version) if version else F.lit(0)
    golds = (gold.groupBy("instance_id")
             .agg(F.max_by(F.struct(F.col("exec_answer").alias("gold_answer")), order).alias("g"))
             .select("instance_id", "g.gold_answer", F.lit(True).alias("has_gold")))
    joined = predictions.join(golds, "instance_id", "left")
    pred_doc, gold_doc = F.try_parse_json("exec_answer"), F.try_parse_json("gold_answer")
    own_error = F.try_variant_get(pred_doc, "$.error", "string")
    joined = joined.withColumns({"_p": pred_doc, "_g": gold_doc, "_e": own_error})

    def is_list(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    usable = is_list(F.col("_p")) & is_list(F.col("_g"))
    error = (F.when(F.col("has_gold").isNull(), "no gold found")
             .when(F.col("_e").isNotNull(), F.col("_e"))
             .when(~usable, "invalid exec_answer format"))
    joined = joined.withColumn("error", error)
    rows = joined.withColumns({c: F.when(F.col("error").isNull(), result_rows(F.col(v)))
                               for c, v in (("_pr", "_p"), ("_gr", "_g"))})
    same = compare_rows(F.col("_pr"), F.col("_gr"),
                        is_order_sensitive(F.col("sql_answer")), **options)
    return rows.select("instance_id", (F.col("error").isNull() & F.coalesce(same, F.lit(False)))
                       .alias("correct"), "error")


def accuracy_score(details: DataFrame) -> DataFrame:
    return details.agg(F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("score"),
                       F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"))
