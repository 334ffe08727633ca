"""Incremental work: what is done, what remains, batches, merging answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.ordering import in_ranges, range_offsets

QUESTION_FIELDS = ("index", "db_id", "sql_complexity", "question_style", "question",
                   "external_knowledge", "cot", "sql")


def is_error(result: str = "result"):
    return F.coalesce(F.col(result), F.lit("")).startswith("ERROR:")


def done_indices(answers: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Distinct answered indices; with retry, errors do not count as answered."""
    kept = answers.where(~is_error()) if retry_errors else answers
    return kept.select("index").distinct()


def remaining_work(questions: DataFrame, answers: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Questions without a counted answer."""
    kept = answers.where(~is_error()) if retry_errors else answers
    return questions.join(kept.select("index"), "index", "left_anti")


def drop_errors(answers: DataFrame) -> DataFrame:
    return answers.where(~is_error())


def locality_order(questions: DataFrame, partitions: int | None = None) -> DataFrame:
    """Questions of one dataset adjacent, split over tasks by range.

    The index is part of the range key, so a dataset holding a third of all
    questions spreads over several tasks.
    """
    keys = ["db_id", "index"]
    ranged = (questions.repartitionByRange(partitions, *keys) if partitions
              else questions.repartitionByRange(*keys))
    return ranged.sortWithinPartitions(*keys)


def mini_batches(questions: DataFrame, size: int) -> DataFrame:
    """Add ``batch`` = position in (db_id, index) order // size.

    Positions come from one count per range of that order; no window sees more
    than a range.
    """
    placed = in_ranges(questions, "db_id", "index")
    starts = range_offsets(placed, [], F.count(F.lit(1)))
    local = Window.partitionBy("_part").orderBy("db_id", "index")
    return (placed.join(starts, "_part")
            .withColumn("batch", F.floor((F.col("_offset") + F.row_number().over(local) - 1) / F.lit(size)).cast("bigint"))
            .drop("_part", "_offset"))


def latest_per_key(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Keep the row with the highest ``version`` per key, by partial max."""
    fields = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), version).alias("_r")).select(
        key, *[F.col("_r")[f].alias(f) for f in fields])


def attach_responses(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """Question fields plus ``result`` and ``raw_output``; a missing response is an error row."""
    found = responses.select("index", "result", "raw_output")
    return (questions.select(*QUESTION_FIELDS).join(found, "index", "left")
            .withColumn("result", F.coalesce("result", F.lit("ERROR:no_response")))
            .withColumn("raw_output", F.coalesce("raw_output", F.lit(""))))


def resume_merge(answers: DataFrame, questions: DataFrame, responses: DataFrame,
                 retry_errors: bool = False) -> DataFrame:
    """Stored answers plus those of a finished batch for questions not yet done.

    Only questions present in the batch are appended, each once: of a repeated
    index the last response counts. With retry, stored error rows go even where
    the batch has no replacement.
    """
    responses = latest_per_key(responses.withColumn("_v", F.monotonically_increasing_id()), "index", "_v").drop("_v")
    kept = drop_errors(answers) if retry_errors else answers
    todo = remaining_work(questions, answers, retry_errors)
    present = todo.join(responses.select("index"), "index", "left_semi")
    return kept.unionByName(attach_responses(present, responses))


def process_batches(questions: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame],
                    schema: str = "index bigint, body string") -> DataFrame:
    """Responses from a caller's own batch function, batch by batch in the tasks.

    ``answer`` takes a frame of questions and returns a frame of ``schema``;
    questions it leaves out count as missing. Arrow batch size sets how many it
    sees at once.
    """
    return questions.mapInPandas(lambda frames: map(answer, frames), schema)


def error_total(answers: DataFrame) -> DataFrame:
    return answers.agg(F.count(F.lit(1)).alias("answers"), F.count_if(is_error()).alias("errors"))
