"""Response flattening queries: each conversation turn is a nested document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.flatten import (execution_outcomes, extract_code, finish_reasons,
                                          flatten_responses, strip_code_fence, usage_by_model)
from tallyframe.operators.parse import unframe_output
from tallyframe.plans.registry import query, table

def _lines() -> Column:
    return F.split("text", "\n")


def _document(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _variant(c: Column) -> Column:
    return F.parse_json(F.to_json(c))


def _block(kind: str, text=None, code=None, content=None) -> Column:
    return F.struct(F.lit(kind).alias("type"),
                    (F.lit(None).cast("string") if text is None else text).alias("text"),
                    F.struct((F.lit(None).cast("string") if code is None else code).alias("code")).alias("input"),
                    (F.lit(None).cast("variant") if content is None else content).alias("content"))


def block_body() -> Column:
    """Assistant: code, an error block, one result block per line. System: the
    legacy list. User: text blocks only."""
    code = _block("server_tool_use", code=F.concat(F.lit("print("), F.col("turn").cast("string"), F.lit(")")))
    failed = _block("bash_code_execution_tool_result",
                    content=_variant(F.struct(F.lit("bash_code_execution_tool_result_error").alias("type"))))
    results = F.transform(_lines(), lambda x: _block("bash_code_execution_tool_result", content=_variant(
        F.struct(F.lit("bash_code_execution_result").alias("type"), x.alias("stdout")))))
    legacy = F.array(_block("tool_result", content=_variant(F.transform(_lines(), lambda x: F.struct(
        F.lit("text").alias("type"), x.alias("text"))))))
    texts = F.transform(_lines(), lambda x: _block("text", text=x))
    intro = F.array(_block("text", text=F.lit("let me see")))
    content = (F.when(F.col("role") == "assistant", F.concat(intro, F.array(code, failed), results))
               .when(F.col("role") == "system", F.concat(intro, legacy)).otherwise(texts))
    return _document(content=content)


def _part(text=None, output=None) -> Column:
    none = F.lit(None).cast("string")
    ran = F.struct(F.lit("OUTCOME_OK").alias("outcome"), (none if output is None else output).alias("output"))
    return F.struct((none if text is None else text).alias("text"),
                    (F.lit(None).cast(ran_type) if output is None else ran).alias("code_execution_result"))


ran_type = "struct<outcome: string, output: string>"


def parts_body() -> Column:
    """Assistant: one execution result per line. System: no candidates. User:
    texts, the opening turn none at all."""
    ran = F.concat(F.array(_part(text=F.lit("thinking"))), F.transform(_lines(), lambda x: _part(output=x)))
    texts = F.transform(_lines(), lambda x: _part(text=x))
    parts = F.when(F.col("role") == "assistant", ran).when(F.col("turn") == 0, F.slice(texts, 1, 0)).otherwise(texts)
    candidates = F.array(F.struct(parts.alias("parts"), F.lit("STOP").alias("finish_reason")))
    return _document(candidates=F.when(F.col("role") == "system", F.slice(candidates, 1, 0)).otherwise(candidates))


def items_body() -> Column:
    """Assistant: an interpreter call with one log per line. Others: a message."""
    logs = F.transform(_lines(), lambda x: F.struct(F.lit("logs").alias("type"), x.alias("logs")))
    said = F.transform(_lines(), lambda x: F.struct(F.lit("output_text").alias("type"), x.alias("text")))
    call = F.struct(F.lit("code_interpreter_call").alias("type"), logs.alias("outputs"),
                    F.slice(said, 1, 0).alias("content"))
    message = F.struct(F.lit("message").alias("type"), F.slice(logs, 1, 0).alias("outputs"), said.alias("content"))
    return _document(output=F.when(F.col("role") == "assistant", F.array(call, message)).otherwise(F.array(message)))


def chat_body() -> Column:
    """Assistant: the text inside a fence. System: null content."""
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))
    content = F.when(F.col("role") == "assistant", fenced).when(F.col("role") == "user", F.col("text"))
    return _document(choices=F.array(F.struct(F.struct(content.alias("content")).alias("message"))))


def _flattened(spark, sf_dir, shape: str, body: Column) -> DataFrame:
    docs = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", body.alias("body"), F.lit(shape).alias("shape"))
    return flatten_responses(docs).select(
        "conv_id", "turn", F.md5("stdout").alias("stdout_md5"), F.md5("raw_output").alias("raw_md5"),
        F.coalesce("error", F.lit("")).alias("error"))


FRAME = ("'[CODE]' || chr(10) || 'print(' || turn || ')' || chr(10) || '[/CODE]' || chr(10) || chr(10) || '[OUTPUT]'"
         " || chr(10) || text || chr(10) || '[/OUTPUT]'")


@query("flatten_blocks", oracle=f"""
SELECT conv_id, turn, md5(text) AS stdout_md5,
  md5(CASE role WHEN 'assistant' THEN {FRAME} ELSE text END) AS raw_md5, '' AS error FROM conversations""")
def blocks(spark, sf_dir):
    return _flattened(spark, sf_dir, "claude", block_body())


PARTS = """CASE WHEN role = 'system' THEN 'ERROR:no_candidates'
   WHEN role = 'user' AND turn = 0 THEN 'ERROR:no_output' ELSE '' END"""


@query("flatten_parts", oracle=f"""
WITH t AS (SELECT *, {PARTS} AS error FROM conversations)
SELECT conv_id, turn, md5(CASE error WHEN '' THEN text ELSE '' END) AS stdout_md5,
  md5(CASE error WHEN '' THEN text ELSE '' END) AS raw_md5, error FROM t""")
def parts(spark, sf_dir):
    return _flattened(spark, sf_dir, "gemini", parts_body())


@query("flatten_outputs", oracle="""
SELECT conv_id, turn, md5(text) AS stdout_md5, md5(text) AS raw_md5, '' AS error FROM conversations""")
def outputs(spark, sf_dir):
    return _flattened(spark, sf_dir, "openai", items_body())


@query("flatten_chat", oracle="""
SELECT conv_id, turn, md5(CASE role WHEN 'system' THEN '' ELSE text END) AS stdout_md5,
  md5(CASE role WHEN 'system' THEN '' WHEN 'assistant' THEN '```json' || chr(10) || text || chr(10) || '```'
      ELSE text END) AS raw_md5, CASE role WHEN 'system' THEN 'ERROR:no_output' ELSE '' END AS error
FROM conversations""")
def chat(spark, sf_dir):
    return _flattened(spark, sf_dir, "openrouter", chat_body())


@query("flatten_dispatch", oracle=f"""
WITH t AS (SELECT *, (conv_id + turn) % 6 AS k FROM conversations),
e AS (SELECT *, CASE k WHEN 4 THEN 'ERROR:exception:ValueError:Unknown provider: other'
        WHEN 5 THEN 'ERROR:no_response' WHEN 1 THEN {PARTS}
        WHEN 3 THEN CASE role WHEN 'system' THEN 'ERROR:no_output' ELSE '' END ELSE '' END AS error FROM t)
SELECT conv_id, turn, md5(CASE error WHEN '' THEN text ELSE '' END) AS stdout_md5, error FROM e""")
def dispatch(spark, sf_dir):
    """Four shapes, an unknown provider and missing responses in one table."""
    k = (F.col("conv_id") + F.col("turn")) % 6
    kinds = [("claude", block_body()), ("gemini", parts_body()), ("openai", items_body()),
             ("openrouter", chat_body()), ("other", F.lit("{}"))]
    shape, body = F.lit("claude"), F.lit(None).cast("string")
    for i, (name, doc) in enumerate(kinds):
        shape, body = F.when(k == i, name).otherwise(shape), F.when(k == i, doc).otherwise(body)
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", shape.alias("shape"), body.alias("body"))
    return flatten_responses(docs).select("conv_id", "turn", F.md5("stdout").alias("stdout_md5"),
                                          F.coalesce("error", F.lit("")).alias("error"))


@query("strip_code_fence", oracle="""
SELECT conv_id, turn, md5(text) AS stripped_md5, CASE WHEN turn % 2 = 0 THEN md5(trim(text)) END AS code_md5
FROM conversations""")
def fences(spark, sf_dir):
    """Fenced on even turns; code is found only there."""
    fenced = F.concat(F.lit("```python\n"), F.col("text"), F.lit("\n```"))
    raw = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 0, fenced).otherwise(F.col("text")).alias("raw"))
    return raw.select("conv_id", "turn", F.md5(strip_code_fence(F.col("raw"))).alias("stripped_md5"),
                      F.md5(extract_code(F.col("raw"))).alias("code_md5"))


@query("unframe_output", oracle="SELECT conv_id, turn, md5(text) AS output_md5 FROM conversations")
def unframed(spark, sf_dir):
    framed = F.concat(F.lit("[CODE]\nx = 1\n[/CODE]\n\n[OUTPUT]"), F.col("text"), F.lit("[/OUTPUT]"))
    raw = F.when(F.col("role") == "assistant", framed).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(unframe_output(raw)).alias("output_md5"))


def response_table(spark, sf_dir) -> DataFrame:
    """Events as parts-shaped responses with usage, outcomes and finish reasons."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    usage = F.struct((F.col("user_id") * 1000).alias("prompt_token_count"),
                     cents.alias("candidates_token_count"),
                     (F.col("user_id") * 1000 + cents).alias("total_token_count"),
                     F.when(F.col("event_type") == "view", F.col("user_id")).alias("cached_content_token_count"))

    def ran(outcome: Column, made: Column) -> Column:
        return F.struct(F.lit(None).cast("string").alias("text"), F.when(made, F.struct(
            outcome.alias("outcome"), F.lit("x").alias("output"))).alias("code_execution_result"))
    parts = F.array(ran(F.lit("OUTCOME_OK"), F.lit(True)),
                    ran(F.concat(F.lit("OUTCOME_"), F.upper("event_type")), F.col("value") > 50))
    candidates = F.array(F.struct(parts.alias("parts"), F.when(
        F.col("event_type") == "error", "MAX_TOKENS").otherwise("STOP").alias("finish_reason")))
    return e.select("event_id", F.concat(F.lit("m-"), "event_type").alias("model_version"),
                    usage.alias("usage_metadata"), candidates.alias("candidates"))


@query("usage_by_model", oracle="""
SELECT 'm-' || event_type AS model_version, count(*) AS responses, (sum(user_id) * 1000) :: BIGINT AS prompt_token_count_sum,
  sum(CAST(round(value * 100) AS BIGINT)) :: BIGINT AS candidates_token_count_sum,
  sum(user_id * 1000 + CAST(round(value * 100) AS BIGINT)) :: BIGINT AS total_token_count_sum,
  sum(CASE WHEN event_type = 'view' THEN user_id END) :: BIGINT AS cached_content_token_count_sum,
  quantile_cont(user_id * 1000, 0.5) AS prompt_token_median
FROM events GROUP BY event_type""")
def usage(spark, sf_dir):
    return usage_by_model(response_table(spark, sf_dir))


@query("execution_outcomes", oracle="""
SELECT outcome, count(*) AS n FROM (
  SELECT 'OUTCOME_OK' AS outcome FROM events UNION ALL
  SELECT 'OUTCOME_' || upper(event_type) FROM events WHERE value > 50) GROUP BY outcome""")
def outcomes(spark, sf_dir):
    return execution_outcomes(response_table(spark, sf_dir))


@query("finish_reasons", oracle="""
SELECT CASE event_type WHEN 'error' THEN 'MAX_TOKENS' ELSE 'STOP' END AS finish_reason, count(*) AS n
FROM events GROUP BY 1""")
def reasons(spark, sf_dir):
    return finish_reasons(response_table(spark, sf_dir))
