"""Batch-output files -> answer table, one answer per question, across restarts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tallyframe.operators.flatten import extract_results
from tallyframe.operators.work import attach_responses, remaining_work
from tallyframe.session import materialize
from tallyframe.sources.records import (bucket_of, compact_answers, parse_batch_lines, read_answer_parts,
                                        split_order, store_answers, with_line_order)

#: So many epochs go into an answer store before its parts are merged.
COMPACT_EVERY = 16


def batch_output_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New batch-output files as a stream of lines with their split's order."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return lines.select("value", split_order().alias("_split"))


def first_per_id(stream: DataFrame, keys: list[str], time_col: str | None = None,
                 within: str | None = None) -> DataFrame:
    """One row per id over the life of the stream, or ``within`` a delay of ``time_col``.

    The state holds one small entry per distinct id and is spread over the
    state partitions by id, so repeats of a hot id cost a lookup each. With a
    delay, entries older than the watermark are dropped and the state stays
    bounded; repeats must then come no later than that.
    """
    if time_col is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time_col, within or "1 hour").dropDuplicatesWithinWatermark(keys)


def dedupe_stream(stream: DataFrame, keys: list[str], target: str, checkpoint_location: str,
                  memory: str = "1 hour") -> StreamingQuery:
    """Store the first row per id in the table ``target``, across restarts and with bounded state.

    The state store remembers an id for ``memory`` of processing time; the table itself
    is the memory beyond that, looked up for the ids of a micro-batch only. Every epoch
    owns one part and replaces it, so a replay changes nothing.
    """
    schema = stream.schema
    recent = (stream.withColumn("_seen_at", F.current_timestamp()).withWatermark("_seen_at", memory)
              .dropDuplicatesWithinWatermark(keys).drop("_seen_at"))

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        if epoch:
            stored = spark.read.schema(StructType([*schema.fields, StructField("epoch", LongType())])).parquet(target)
            rows = rows.join(stored.where(F.col("epoch") < epoch).select(*keys).distinct(), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
    return (recent.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_location)
            .trigger(availableNow=True).start())


def merge_micro_batch(lines: DataFrame, epoch: int, questions: DataFrame, root: str,
                      checkpoint: str, model_id: str, shape: str, origin: str,
                      retry_errors: bool = False, compact_every: int = COMPACT_EVERY) -> None:
    """Parse one micro-batch and store answers to questions not answered yet.

    Every epoch owns one part and replaces it, and its own part does not count
    as stored, so replaying an epoch after a failure changes nothing. Of the stored
    answers only the buckets of the batch are read, and parts are merged into one base
    after ``compact_every`` epochs: the files an epoch reads do not grow with their number.
    """
    spark = lines.sparkSession
    bodies = materialize(parse_batch_lines(with_line_order(lines, F.col("_split")), "_order"), "bodies")
    buckets = [r[0] for r in bodies.select(bucket_of(F.col("index"))).distinct().collect()]  # BUCKETS at most
    parts = read_answer_parts(spark, root, checkpoint, model_id, buckets)
    stored = parts.where((F.col("origin") != origin) | (F.col("epoch") != epoch))
    # The batch first: what is stored is looked up for its questions only.
    asked = questions.join(bodies.select("index"), "index", "left_semi")
    present = remaining_work(asked, stored, retry_errors)
    results = extract_results(bodies.withColumn("shape", F.lit(shape)))
    store_answers(attach_responses(present, results), root, checkpoint, model_id, origin, epoch)
    if epoch % compact_every == compact_every - 1:
        compact_answers(spark, root, checkpoint, model_id)


def ingest_batch_output(spark: SparkSession, folder: str, questions: DataFrame, root: str,
                        checkpoint: str, model_id: str, shape: str, checkpoint_location: str,
                        files_per_batch: int = 1000, retry_errors: bool = False) -> StreamingQuery:
    """Start the ingest; it stops by itself when all present files are done.

    ``shape`` is a provider or response-shape name. Run it again with the same
    ``checkpoint_location`` to take up files that came since.
    """
    origin = hashlib.md5(checkpoint_location.encode()).hexdigest()[:12]

    def merge(batch: DataFrame, epoch: int) -> None:
        merge_micro_batch(batch, epoch, questions, root, checkpoint, model_id, shape, origin,
                          retry_errors)
    return (batch_output_stream(spark, folder, files_per_batch).writeStream.foreachBatch(merge)
            .option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start())
