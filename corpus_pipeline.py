"""Corpus cleaning: quality rules, near-duplicates, repeated passages, benchmark leaks, tokens.

Every stage works on all documents that the stage before it kept. Stages ahead of
the last return the columns of ``documents``; a clean document passes all of them
unchanged, but for passages of 100 bytes that stand earlier in the corpus.

Defined results: null and empty texts fail the quality rules and go; rows that repeat
id and text are one document from the second stage on; rows of one or no ``doc_id``
with different texts are documents of their own; a text whose every byte stands
earlier goes on as an empty one, without tokens; an empty table passes all stages. The
columns are those of ``documents``, others pass through the first four stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, near_dup, queries, suffix_dedup
from tallyframe.llm import decontaminate as leaks
from tallyframe.llm import quality_rules as quality
from tallyframe.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; base failures go."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest doc_id; rows of one or no id are told apart."""
    return near_dup.keep_one(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the characters whose bytes a repeated passage covers."""
    left = (suffix_dedup.remove_repeats(docs, whole_characters=True)
            .select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("kept").cast("string").alias("_kept"))
            .dropDuplicates(["_id", "_tie"]))
    rest = docs.withColumn("_tie_of", F.xxhash64(F.coalesce("text", F.lit("")))).drop("text", "n_chars")
    joined = rest.join(left, rest["doc_id"].eqNullSafe(left["_id"]) & (F.col("_tie_of") == F.col("_tie")))
    return (joined.withColumn("text", F.col("_kept")).withColumn("n_chars", F.length("_kept").cast("long"))
            .select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows of one or no id are judged one by one."""
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), per_row=True)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, text, ids): ids of every text and what they decode to."""
    path = queries.tokenizer_path()
    return bpe.decode(bpe.encode(docs, path), path, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_array_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("bpe", token_stage),
]

#: EM, sketches and suffix arrays have no SQL form; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes its result to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/corpus-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
