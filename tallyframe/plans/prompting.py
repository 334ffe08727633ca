"""Prompt and request queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators.profile import profile_document
from tallyframe.operators.prompts import (dataset_contexts, file_message_prefix, guidelines,
                                          question_suffixes, request_lines, static_prefixes,
                                          token_estimate, user_prompts)
from tallyframe.plans.messy import MELTED, messy_orders
from tallyframe.plans.profiling import FLAGS
from tallyframe.plans.registry import query, table
from tallyframe.plans.selection import questions
from tallyframe.session import materialize

RULES = f"""
{MELTED}, {FLAGS},
named AS (SELECT string_agg("column", ', ' ORDER BY "column") FILTER (date_columns) AS dates,
    string_agg("column", ', ' ORDER BY "column") FILTER (numeric_columns) AS numbers,
    string_agg("column", ', ' ORDER BY "column") FILTER (boolean_like_columns) AS booleans,
    string_agg("column", ', ' ORDER BY "column") FILTER (numeric_as_text_columns) AS texts,
    string_agg("column", ', ' ORDER BY "column") FILTER (high_missing_columns) AS gaps FROM flags),
rules AS (SELECT chr(10) || 'DATASET-AWARE RULES (must follow):' || chr(10) || concat_ws(chr(10),
    '- Parse date columns before filtering/sorting: ' || dates || '.',
    '- Cast numeric columns with pd.to_numeric(errors=''coerce''): ' || numbers || '.',
    '- Treat these as boolean-like flags (0/1): ' || booleans || '.',
    '- These may look numeric but are text in many rows; convert carefully only when needed: ' || texts || '.',
    '- High-missing columns: ' || gaps || '. Handle null/empty explicitly.',
    '- Mixed date formats detected in: order_date. Normalize with pd.to_datetime(..., errors=''coerce'').',
    '- CSV may not be comma-delimited; use robust read_csv settings.') || chr(10) AS rules FROM named)"""


def _profile(spark, sf_dir):
    return profile_document(messy_orders(spark, sf_dir), "orders", "pos", delimiter=";")


@query("prompt_guidelines", oracle=f"WITH {RULES} SELECT 'orders' AS db_id, rules FROM rules")
def prompt_guidelines(spark, sf_dir):
    return _profile(spark, sf_dir).select("db_id", guidelines(
        F.col("inferred_types"), F.col("quality_flags")).alias("rules"))


@query("prompt_table", oracle=f"""
WITH {RULES}
SELECT item_id AS "index", 'DATASET: orders' || chr(10) || 'DELIMITER: '';''  |  ENCODING: ''utf-8''' || chr(10)
  || 'COLUMNS: order_date, ship_note, total_price, mixed_score, is_open, order_code, priority' || chr(10)
  || rules
  || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'EXTERNAL KNOWLEDGE (important — use this to interpret the question correctly):'
       || chr(10) || 'item ' || item_id || chr(10) ELSE '' END
  || chr(10) || 'QUESTION: ' || text AS prompt
FROM benchmark, rules""")
def prompt_table(spark, sf_dir):
    """Every benchmark passage as a question over the profiled table."""
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("index"), F.lit("orders").alias("db_id"), F.col("text").alias("question"),
        F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" item "), F.col("item_id").cast("string"), F.lit("\n")))
        .otherwise(" ").alias("external_knowledge"))
    profile = materialize(_profile(spark, sf_dir), "profile")
    contexts = dataset_contexts(profile.select("db_id", "delimiter", "encoding", "columns"), profile)
    return user_prompts(asked, contexts).select("index", "prompt")


def _contexts(spark, sf_dir):
    """Per-source headers: delimiter and columns vary by source."""
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("db_id")).distinct()
    return sources.select("db_id", F.when(F.col("db_id").endswith("1"), "\t").otherwise(",").alias("delimiter"),
                          F.lit("utf-8-sig").alias("encoding"),
                          F.array(F.lit("doc_id"), F.lit("text")).alias("columns"))


HEADER = """'DATASET: ' || source || chr(10) || 'DELIMITER: '''
    || CASE WHEN source LIKE '%1' THEN '\\t' ELSE ',' END || '''  |  ENCODING: ''utf-8-sig''' || chr(10)
    || 'COLUMNS: doc_id, text' || chr(10)"""
KNOWN = """CASE WHEN doc_id % 3 = 0 THEN chr(10)
    || 'EXTERNAL KNOWLEDGE (important — use this to interpret the question correctly):' || chr(10)
    || 'about ' || lang || chr(10) ELSE '' END || chr(10) || 'QUESTION: ' || text"""


@query("prompt_per_document", oracle=f"""
SELECT doc_id AS "index", md5({HEADER} || {KNOWN}) AS prompt_md5,
  strlen({HEADER} || {KNOWN}) // 4 AS tokens FROM documents""")
def prompt_per_document(spark, sf_dir):
    """Prompts without a profile, whole texts, with their token estimate."""
    prompts = user_prompts(questions(spark, sf_dir), dataset_contexts(_contexts(spark, sf_dir)))
    return prompts.select("index", F.md5("prompt").alias("prompt_md5"),
                          token_estimate(F.col("prompt")).alias("tokens"))


@query("request_lines", oracle=f"""
SELECT doc_id AS "index", CAST(doc_id AS VARCHAR) AS custom_id, 'POST' AS method, '/v1/responses' AS url,
  'model-x' AS model, '4096' AS max_tokens, 'file-' || source AS file_id, 'user' AS role,
  md5({HEADER} || {KNOWN}) AS content_md5 FROM documents""")
def requests(spark, sf_dir):
    """Request lines, read back field by field."""
    prompts = user_prompts(questions(spark, sf_dir), dataset_contexts(_contexts(spark, sf_dir)))
    lines = request_lines(prompts.withColumn("file_id", F.concat(F.lit("file-"), "db_id")),
                          "model-x", "Answer from the table.")
    doc = F.from_json("value", """custom_id string, method string, url string, body struct<model: string,
        max_output_tokens: string, tools: array<struct<container: struct<file_ids: array<string>>>>,
        input: array<struct<role: string, content: string>>>""")
    d = lines.select("index", doc.alias("d"))
    return d.select("index", "d.custom_id", "d.method", "d.url", "d.body.model",
                    F.col("d.body.max_output_tokens").alias("max_tokens"),
                    F.col("d.body.tools")[0]["container"]["file_ids"][0].alias("file_id"),
                    F.col("d.body.input")[0]["role"].alias("role"),
                    F.md5(F.col("d.body.input")[0]["content"]).alias("content_md5"))


@query("static_prefixes", oracle="""
SELECT 'doc' || doc_id AS db_id, md5('DATASET: doc' || doc_id || chr(10) || 'DELIMITER: '',''  |  ENCODING: ''utf-8''' || chr(10)
  || 'COLUMNS: text' || chr(10) || chr(10) || 'CSV DATA:' || chr(10) || text) AS prefix_md5,
  md5('<csv filename="doc' || doc_id || '.csv">' || chr(10) || text || chr(10) || '</csv>' || chr(10) || chr(10)) AS message_md5
FROM documents""")
def prefixes(spark, sf_dir):
    """One shared prefix per dataset file; each document stands for a file."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select(name.alias("db_id"), "text")
    catalog = files.select("db_id", F.lit(",").alias("delimiter"), F.lit("utf-8").alias("encoding"),
                           F.array(F.lit("text")).alias("columns"))
    shared = static_prefixes(catalog, files).select("db_id", F.md5("prefix").alias("prefix_md5"))
    wrapped = files.select("db_id", F.md5(file_message_prefix(
        F.concat("db_id", F.lit(".csv")), F.col("text"))).alias("message_md5"))
    return shared.join(wrapped, "db_id")


@query("question_suffixes", oracle=f"""
SELECT doc_id AS "index", source AS db_id, md5({KNOWN}) AS suffix_md5 FROM documents""")
def suffixes(spark, sf_dir):
    return question_suffixes(questions(spark, sf_dir)).select(
        "index", "db_id", F.md5("suffix").alias("suffix_md5"))


@query("token_estimate", oracle="SELECT doc_id, strlen(text) // 4 AS tokens FROM documents")
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))
