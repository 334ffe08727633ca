"""Streaming queries: files arrive, the stream runs until none is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.plans.io import batch_lines, fresh_dir
from tallyframe.plans.registry import query, table
from tallyframe.sources import records
from tallyframe.streaming.ingest import dedupe_stream, ingest_batch_output

ANSWERED = """
SELECT event_id AS "index", CASE WHEN event_type IN ('click', 'error') THEN 'ERROR:no_response'
    WHEN event_type = 'view' THEN 'ERROR:no_output' ELSE '[["' || event_type || '"]]' END AS result
FROM events"""


def _questions(spark, sf_dir):
    none = F.lit("")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("index"), F.col("event_type").alias("db_id"), none.alias("sql_complexity"),
        none.alias("question_style"), F.col("props").alias("question"), none.alias("external_knowledge"),
        none.alias("cot"), none.alias("sql"))


def _ingested(spark, sf_dir, files_per_batch: int, restart: bool):
    folder, root, state = (fresh_dir(spark, x) for x in ("incoming", "answers", "state"))
    lines = batch_lines(spark, sf_dir).select("event_id", "value")
    asked = _questions(spark, sf_dir)

    def run():
        ingest_batch_output(spark, folder, asked, root, "run", "model", "openai", state,
                            files_per_batch).awaitTermination()
    if restart:
        # Half the files, a stop, then everything again as new files.
        early = lines.join(table(spark, sf_dir, "events").where(F.col("value") > 30).select("event_id"), "event_id")
        early.repartition(2).select("value").write.mode("append").text(folder)
        run()
        lines.repartition(2).select("value").write.mode("append").text(folder)
    else:
        lines.repartition(4).select("value").write.mode("append").text(folder)
    run()
    parts = records.read_answer_parts(spark, root, "run", "model")
    return parts.select("index", "result")


@query("stream_ingest", oracle=ANSWERED)
def stream_ingest(spark, sf_dir):
    """Batch-output files to answers, two files per micro-batch."""
    return _ingested(spark, sf_dir, 2, restart=False)


@query("stream_restart", oracle=ANSWERED)
def stream_restart(spark, sf_dir):
    """Stopped, fed repeats, started again: still one stored answer per question."""
    return _ingested(spark, sf_dir, 1000, restart=True)


@query("stream_dedupe", oracle="SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    """One row per id over the whole stream and a restart; old ids leave the state store."""
    target, state, source = (fresh_dir(spark, x) for x in ("deduped", "state", "events"))
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    keys = ["user_id", "event_type"]

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
        dedupe_stream(stream, keys, target, state).awaitTermination()
    events.where("user_id % 3 > 0").repartition(4).write.parquet(source)
    run()
    events.repartition(2).write.mode("append").parquet(source)
    run()
    return spark.read.parquet(target).select(*keys)


@query("answer_compaction", oracle="""
SELECT doc_id AS "index", '[[' || (n_chars + CASE WHEN lang = 'en' THEN 4 ELSE 0 END) || ']]' AS result, true AS few_files FROM documents""")
def answer_compaction(spark, sf_dir):
    """Five parts, merged twice on the way: errors make way for answers, answers stay, few files are left."""
    root = fresh_dir(spark, "answers")
    docs = table(spark, sf_dir, "documents")
    none = [F.lit("").alias(f) for f in ("db_id", "sql_complexity", "question_style", "question", "external_knowledge", "cot", "sql")]
    for epoch in range(5):
        right = F.concat(F.lit("[["), (F.col("n_chars") + epoch).cast("string"), F.lit("]]"))
        late = (F.col("lang") == "en") & F.lit(epoch < 4)
        some = F.lit(epoch == 0) | ((F.col("lang") == "en") & (F.lit(epoch == 4) | (F.col("doc_id") % 7 == 1)))
        rows = docs.where(some).select(F.col("doc_id").alias("index"), *none, F.when(late, "ERROR:no_output").otherwise(right).alias("result"),
                                       F.lit("").alias("raw_output"))
        records.store_answers(rows, root, "run", "m", "batch", epoch)
        if epoch in (1, 3):
            records.compact_answers(spark, root, "run", "m")
    few = len(records.read_answer_parts(spark, root, "run", "m").inputFiles()) <= 2 * records.BUCKETS
    return records.read_answers(spark, root, "run", "m").select(
        "index", F.when(F.col("result").startswith("[["), F.col("result")).otherwise("?").alias("result"), F.lit(few).alias("few_files"))
