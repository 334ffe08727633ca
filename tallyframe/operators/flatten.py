"""Nested response documents -> (stdout, raw_output, error) per response.

Each shape is one struct Column; flattening is ``filter``/``transform`` over
its arrays, so a response never leaves its row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import strip
from tallyframe.operators.parse import parse_results

# The field layout of the four response shapes.
BLOCK_DDL = """struct<content: array<struct<type: string, text: string,
    input: struct<code: string>, content: variant>>>"""
PARTS_DDL = """struct<model_version: string, response_id: string,
    usage_metadata: struct<prompt_token_count: bigint, candidates_token_count: bigint,
        total_token_count: bigint, cached_content_token_count: bigint>,
    candidates: array<struct<role: string,
        parts: array<struct<text: string,
            executable_code: struct<code: string, language: string, id: string>,
            code_execution_result: struct<outcome: string, output: string, id: string>>>,
        finish_reason: string, token_count: bigint, index: bigint>>>"""
ITEMS_DDL = """struct<output: array<struct<type: string,
    outputs: array<struct<type: string, logs: string>>,
    content: array<struct<type: string, text: string>>>>>"""
CHAT_DDL = "struct<choices: array<struct<message: struct<content: string>>>>"


def _flat(stdout: Column, raw: Column, error: Column) -> Column:
    return F.struct(stdout.alias("stdout"), raw.alias("raw_output"), error.alias("error"))


def _pick(first: Column, second: Column) -> Column:
    """Joined tool output if any tool part exists, else the joined texts."""
    return F.array_join(F.when(F.size(first) > 0, first).otherwise(second), "\n")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _no_output(stdout: Column) -> Column:
    return F.when(strip(stdout) == "", "ERROR:no_output")


def flatten_blocks(doc: Column) -> Column:
    """Block list: tool results (current and legacy form), else text blocks.

    The raw output frames the submitted code and the output when code exists.
    """
    blocks = F.coalesce(doc["content"], F.from_json(F.lit("[]"), "array<struct<type: string,"
                        "text: string, input: struct<code: string>, content: variant>>"))

    def tool_texts(b: Column) -> Column:
        content = b["content"]
        kind = F.schema_of_variant(content)
        current = F.when(F.try_variant_get(content, "$.type", "string") == "bash_code_execution_result",
                         F.array(_text(F.try_variant_get(content, "$.stdout", "string"))))
        items = F.filter(F.try_variant_get(content, "$", "array<variant>"),
                         lambda x: F.try_variant_get(x, "$.type", "string") == "text")
        legacy = F.when(kind.startswith("ARRAY"), F.transform(
            items, lambda x: _text(F.try_variant_get(x, "$.text", "string")))).when(
            kind == "STRING", F.array(F.try_variant_get(content, "$", "string")))
        chosen = F.when(b["type"] == "bash_code_execution_tool_result", current).when(
            b["type"] == "tool_result", legacy)
        return F.coalesce(chosen, F.array().cast("array<string>"))
    tools = F.flatten(F.transform(blocks, tool_texts))
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: _text(b["text"]))
    codes = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "server_tool_use"),
                                 lambda b: _text(b["input"]["code"])), lambda x: x != "")
    stdout = _pick(tools, texts)
    framed = F.concat(F.lit("[CODE]\n"), F.array_join(codes, "\n\n"), F.lit("\n[/CODE]\n\n[OUTPUT]\n"),
                      stdout, F.lit("\n[/OUTPUT]"))
    return _flat(stdout, F.when(F.size(codes) > 0, framed).otherwise(stdout), _no_output(stdout))


def flatten_parts(doc: Column) -> Column:
    """First candidate's execution outputs, else its non-empty texts."""
    first = F.try_element_at(doc["candidates"], F.lit(1))
    parts = first["parts"]
    outputs = F.transform(F.filter(parts, lambda p: p["code_execution_result"].isNotNull()),
                          lambda p: _text(p["code_execution_result"]["output"]))
    texts = F.transform(F.filter(parts, lambda p: p["code_execution_result"].isNull()
                                 & (_text(p["text"]) != "")), lambda p: p["text"])
    stdout = _text(_pick(outputs, texts))
    error = F.when(first.isNull(), "ERROR:no_candidates").otherwise(_no_output(stdout))
    return _flat(stdout, F.when(error.isNull(), stdout).otherwise(""), error)


def flatten_items(doc: Column) -> Column:
    """Interpreter logs of the output items, else their message texts."""
    items = F.coalesce(doc["output"], F.from_json(F.lit("[]"), ITEMS_DDL[len("struct<output: "):-1]))

    def inner(kind: str, field: str, part: str, value: str) -> Column:
        chosen = F.filter(items, lambda i: (i["type"] == kind) & i[field].isNotNull())
        return F.flatten(F.transform(chosen, lambda i: F.transform(
            F.filter(i[field], lambda x: x["type"] == part), lambda x: _text(x[value]))))
    stdout = _pick(inner("code_interpreter_call", "outputs", "logs", "logs"),
                   inner("message", "content", "output_text", "text"))
    error = _no_output(stdout)
    return _flat(stdout, F.when(error.isNull(), stdout).otherwise(""), error)


def strip_code_fence(text: Column) -> Column:
    """Drop an opening fence line and a closing one; other text is unchanged."""
    lines = F.split(strip(text), "\n")
    body = F.slice(lines, F.lit(2), F.size(lines))
    closed = strip(_text(F.try_element_at(body, F.lit(-1)))) == "```"
    kept = F.when(closed, F.slice(body, F.lit(1), F.greatest(F.size(body) - 1, F.lit(0)))).otherwise(body)
    return F.when(strip(text).startswith("```"), F.array_join(kept, "\n")).otherwise(text)


def extract_code(text: Column) -> Column:
    """First fenced block, or a multi-line text that reads a CSV, else null."""
    body = strip(_text(text))
    fence = r"(?is)```(?:python)?\s*(.*?)```"
    fenced = strip(F.regexp_extract(body, fence, 1))
    bare = body.contains("\n") & (body.contains("import pandas") | body.contains("pd.read_csv"))
    return F.when(body.rlike(fence), F.nullif(fenced, F.lit(""))).when(bare, body)


def flatten_chat(doc: Column) -> Column:
    """First choice's message text; the fence is stripped for parsing only."""
    content = F.try_element_at(doc["choices"], F.lit(1))["message"]["content"]
    error = F.when(content.isNull(), "ERROR:no_output")
    return _flat(strip_code_fence(_text(content)), _text(content), error)


# Response shape by provider family: DDL of the document and its flattener.
SHAPES = {
    "blocks": (BLOCK_DDL, flatten_blocks),
    "parts": (PARTS_DDL, flatten_parts),
    "items": (ITEMS_DDL, flatten_items),
    "chat": (CHAT_DDL, flatten_chat),
}

# Which shape each provider answers in.
PROVIDER_SHAPES = {"claude": "blocks", "gemini": "parts", "openai": "items", "openrouter": "chat"}


def flatten_responses(df: DataFrame, body: str = "body", shape: str = "shape",
                      shapes: dict | None = None) -> DataFrame:
    """Add ``stdout``, ``raw_output`` and ``error`` from JSON documents.

    ``shape`` names a column holding a shape or provider name; each row's
    document is parsed under its own shape only. A null body is a missing
    response, an unknown shape or unreadable document an ``exception``.
    ``shapes`` can add further (DDL, flattener) pairs.
    """
    name = F.col(shape)
    for provider, kind in PROVIDER_SHAPES.items():
        name = F.when(F.col(shape) == provider, kind).otherwise(name)
    out = df.withColumn("_shape", name)
    flat = None
    for kind, (ddl, build) in {**SHAPES, **(shapes or {})}.items():
        hit = F.col("_shape") == kind
        doc = F.from_json(F.when(hit, F.col(body)), ddl)
        value = F.when(doc.isNull(), _flat(F.lit(""), F.lit(""), F.lit("ERROR:exception:ValueError:"
                       "unreadable document"))).otherwise(build(doc))
        flat = F.when(hit, value) if flat is None else flat.when(hit, value)
    unknown = _flat(F.lit(""), F.lit(""), F.concat(F.lit("ERROR:exception:ValueError:Unknown provider: "),
                                                   _text(F.col(shape))))
    missing = _flat(F.lit(""), F.lit(""), F.lit("ERROR:no_response"))
    return (out.withColumn("_flat", F.when(F.col(body).isNull(), missing).otherwise(flat.otherwise(unknown)))
            .withColumns({f: F.col("_flat")[f] for f in ("stdout", "raw_output", "error")})
            .drop("_flat", "_shape"))


def extract_results(df: DataFrame, body: str = "body", shape: str = "shape", **options) -> DataFrame:
    """Flatten, then parse: adds ``result`` and ``raw_output``."""
    flat = flatten_responses(df, body, shape)
    parsed = parse_results(flat, "stdout", **options)
    return (parsed.withColumn("result", F.coalesce("error", "result"))
            .drop("stdout", "error", "parse_stage"))


def usage_by_model(responses: DataFrame) -> DataFrame:
    """Token totals and medians per model version over parts-shaped documents.

    The exact median counts distinct token numbers, of which there are no more
    than a context window is long.
    """
    flat = responses.select("model_version", "usage_metadata.*")
    names = ("prompt_token_count", "candidates_token_count", "total_token_count",
             "cached_content_token_count")
    return flat.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("responses"),
        *[F.sum(n).alias(f"{n}_sum") for n in names],
        F.percentile("prompt_token_count", F.lit(0.5)).alias("prompt_token_median"))


def execution_outcomes(responses: DataFrame) -> DataFrame:
    """Code runs per outcome over every candidate."""
    parts = responses.select(F.explode(F.flatten("candidates.parts")).alias("part"))
    return (parts.where(F.col("part.code_execution_result").isNotNull())
            .groupBy(F.col("part.code_execution_result.outcome").alias("outcome"))
            .agg(F.count(F.lit(1)).alias("n")))


def finish_reasons(responses: DataFrame) -> DataFrame:
    """Candidates per finish reason."""
    return (responses.select(F.explode("candidates.finish_reason").alias("finish_reason"))
            .groupBy("finish_reason").agg(F.count(F.lit(1)).alias("n")))
