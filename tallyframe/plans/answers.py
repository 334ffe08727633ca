"""Work planning queries: documents are the questions, labels the stored answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators.work import (attach_responses, done_indices, drop_errors, error_total,
                                       latest_per_key, locality_order, mini_batches,
                                       remaining_work, resume_merge)
from tallyframe.plans.registry import query, table
from tallyframe.plans.selection import questions
from tallyframe.session import materialize


def stored(spark, sf_dir):
    """Answers for the labelled documents; low quality ones are errors."""
    done = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("index"),
        F.when(F.col("quality") == 0, "ERROR:parse_failed:'x'").otherwise(
            F.concat(F.lit("[["), F.col("toxic").cast("string"), F.lit("]]"))).alias("result"))
    return done.join(questions(spark, sf_dir), "index").withColumn("raw_output", F.lit("stored"))


def responses(spark, sf_dir):
    """A finished batch: the documents not in English have a response."""
    d = table(spark, sf_dir, "documents")
    return d.where(F.col("lang") != "en").select(
        F.col("doc_id").alias("index"),
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("[["), "n_chars", F.lit("]]")))
        .otherwise("ERROR:no_output").alias("result"),
        F.concat(F.lit("new "), "lang").alias("raw_output"))


BASE = """
questions AS (SELECT doc_id AS "index", source AS db_id, lang AS question_style FROM documents),
stored AS (SELECT doc_id AS "index", source AS db_id, 'stored' AS raw_output,
             CASE WHEN quality = 0 THEN 'ERROR:parse_failed:''x''' ELSE '[[' || toxic || ']]' END AS result
           FROM labels JOIN documents USING (doc_id)),
responses AS (SELECT doc_id AS "index", 'new ' || lang AS raw_output,
                CASE WHEN doc_id % 10 = 0 THEN '[[' || n_chars || ']]' ELSE 'ERROR:no_output' END AS result
              FROM documents WHERE lang <> 'en')"""


@query("done_indices", oracle=f'WITH {BASE} SELECT DISTINCT "index" FROM stored')
def done(spark, sf_dir):
    return done_indices(stored(spark, sf_dir))


@query("done_indices_retry", oracle=f"""
WITH {BASE} SELECT DISTINCT "index" FROM stored WHERE result NOT LIKE 'ERROR:%'""")
def done_retry(spark, sf_dir):
    return done_indices(stored(spark, sf_dir), retry_errors=True)


@query("remaining_work", oracle=f"""
WITH {BASE} SELECT "index", db_id FROM questions WHERE "index" NOT IN (SELECT "index" FROM stored)""")
def remaining(spark, sf_dir):
    return remaining_work(questions(spark, sf_dir), stored(spark, sf_dir)).select("index", "db_id")


@query("retry_errors", oracle=f"""
WITH {BASE} SELECT "index", db_id FROM questions
WHERE "index" NOT IN (SELECT "index" FROM stored WHERE result NOT LIKE 'ERROR:%')""")
def retry(spark, sf_dir):
    return remaining_work(questions(spark, sf_dir), stored(spark, sf_dir), True).select("index", "db_id")


@query("drop_errors", oracle=f"""
WITH {BASE} SELECT "index", result FROM stored WHERE result NOT LIKE 'ERROR:%'""")
def dropped(spark, sf_dir):
    return drop_errors(stored(spark, sf_dir)).select("index", "result")


@query("locality_order", oracle=f"""
WITH {BASE} SELECT "index", db_id, true AS in_order, true AS after_earlier_tasks FROM questions""")
def locality(spark, sf_dir):
    """Order is part of the result: inside each task, and from task to task."""
    placed = materialize(locality_order(questions(spark, sf_dir).select("index", "db_id"), 6).select(
        "*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place")), "locality")
    key = F.struct("db_id", "index")
    inside = Window.partitionBy("task").orderBy("place")
    ends = placed.groupBy("task").agg(F.max(key).alias("last"))
    before = ends.select("task", F.max("last").over(
        Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # one row per task
    return (placed.withColumn("in_order", F.coalesce(F.lag(key).over(inside) < key, F.lit(True)))
            .join(before, "task").select("index", "db_id", "in_order",
                                         F.coalesce(F.col("before") < key, F.lit(True)).alias("after_earlier_tasks")))


@query("mini_batches", oracle=f"""
WITH {BASE} SELECT "index", db_id, (row_number() OVER (ORDER BY db_id, "index") - 1) // 20 AS batch FROM questions""")
def batches(spark, sf_dir):
    return mini_batches(questions(spark, sf_dir).select("index", "db_id"), 20)


ATTACHED = """
attached AS (SELECT q."index", q.db_id, coalesce(r.result, 'ERROR:no_response') AS result,
               coalesce(r.raw_output, '') AS raw_output FROM questions q LEFT JOIN responses r USING ("index"))"""


@query("attach_responses", oracle=f"WITH {BASE}, {ATTACHED} SELECT * FROM attached")
def attached(spark, sf_dir):
    return attach_responses(questions(spark, sf_dir), responses(spark, sf_dir)).select(
        "index", "db_id", "result", "raw_output")


MERGED = """
SELECT "index", db_id, result, raw_output FROM stored WHERE {keep}
UNION ALL
SELECT a."index", a.db_id, a.result, a.raw_output FROM attached a
WHERE a."index" IN (SELECT "index" FROM responses)
  AND a."index" NOT IN (SELECT "index" FROM stored WHERE {keep})"""


@query("resume_merge", oracle=f"WITH {BASE}, {ATTACHED} " + MERGED.format(keep="true"))
def merged(spark, sf_dir):
    return resume_merge(stored(spark, sf_dir), questions(spark, sf_dir), responses(spark, sf_dir)).select(
        "index", "db_id", "result", "raw_output")


@query("resume_merge_retry", oracle=f"WITH {BASE}, {ATTACHED} " + MERGED.format(keep="result NOT LIKE 'ERROR:%'"))
def merged_retry(spark, sf_dir):
    return resume_merge(stored(spark, sf_dir), questions(spark, sf_dir), responses(spark, sf_dir),
                        retry_errors=True).select("index", "db_id", "result", "raw_output")


@query("error_total", oracle=f"""
WITH {BASE} SELECT count(*) AS answers, count(*) FILTER (result LIKE 'ERROR:%') AS errors FROM stored""")
def errors(spark, sf_dir):
    return error_total(stored(spark, sf_dir))


@query("latest_per_key", oracle="""
SELECT user_id AS "index", arg_max(event_type, event_id) AS result FROM events GROUP BY user_id""")
def latest(spark, sf_dir):
    """Later duplicates win: a partial max, no window over a hot id."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("index"), F.col("event_type").alias("result"), "event_id")
    return latest_per_key(e, "index", "event_id").select("index", "result")
