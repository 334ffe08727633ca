"""Prompt and request tables: string and JSON construction over joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import python_repr, strip

# The dataset rules, in output order. {} takes the column list.
GUIDELINES = (
    ("date_columns", "- Parse date columns before filtering/sorting: {}."),
    ("numeric_columns", "- Cast numeric columns with pd.to_numeric(errors='coerce'): {}."),
    ("boolean_like_columns", "- Treat these as boolean-like flags (0/1): {}."),
    ("numeric_as_text_columns", "- These may look numeric but are text in many rows; "
                                "convert carefully only when needed: {}."),
    ("high_missing_columns", "- High-missing columns: {}. Handle null/empty explicitly."),
    ("mixed_date_format_columns", "- Mixed date formats detected in: {}. "
                                  "Normalize with pd.to_datetime(..., errors='coerce')."),
    ("non_comma_delimiter", "- CSV may not be comma-delimited; use robust read_csv settings."),
    ("has_bom", "- File may have UTF-8 BOM; handle encoding carefully when loading."),
)
# The heads of the two optional sections.
GUIDELINE_HEAD = "\nDATASET-AWARE RULES (must follow):\n"
KNOWLEDGE_HEAD = "\nEXTERNAL KNOWLEDGE (important — use this to interpret the question correctly):\n"
RESPONSES_ENDPOINT = "/v1/responses"


def guidelines(inferred: Column, flags: Column) -> Column:
    """The conditional rule lines of one profile; empty text when none applies."""
    lines = []
    for field, template in GUIDELINES:
        if "{}" in template:
            names = (flags if field == "mixed_date_format_columns" else inferred)[field]
            before, after = template.split("{}")
            lines.append(F.when(F.size(names) > 0, F.concat(
                F.lit(before), F.array_join(names, ", "), F.lit(after))))
        else:
            lines.append(F.when(flags[field], F.lit(template)))
    body = F.concat_ws("\n", *lines)
    return F.when(body != "", F.concat(F.lit(GUIDELINE_HEAD), body, F.lit("\n"))).otherwise("")


def knowledge_section(knowledge: Column) -> Column:
    text = strip(F.coalesce(knowledge, F.lit("")))
    return F.when(text != "", F.concat(F.lit(KNOWLEDGE_HEAD), text, F.lit("\n"))).otherwise("")


def dataset_header(db_id: Column, delimiter: Column, encoding: Column, columns: Column) -> Column:
    return F.concat(F.lit("DATASET: "), db_id, F.lit("\nDELIMITER: "), python_repr(delimiter),
                    F.lit("  |  ENCODING: "), python_repr(encoding), F.lit("\nCOLUMNS: "),
                    F.array_join(columns, ", "), F.lit("\n"))


def dataset_contexts(catalog: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(db_id, header, rules): the question-independent text, once per dataset."""
    base = catalog.select("db_id", dataset_header(
        F.col("db_id"), F.col("delimiter"), F.col("encoding"), F.col("columns")).alias("header"))
    if profiles is None:
        return base.withColumn("rules", F.lit(""))
    rules = profiles.select("db_id", guidelines(F.col("inferred_types"), F.col("quality_flags"))
                            .alias("rules"))
    return base.join(rules, "db_id", "left").withColumn("rules", F.coalesce("rules", F.lit("")))


def user_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Add ``prompt``: dataset header, rules, optional knowledge, question.

    The contexts are per dataset and carry no data rows; AQE broadcasts them
    when their measured size allows and splits a hot dataset otherwise. A question
    of an unknown dataset has a null prompt and ``error_class`` says so.
    """
    return (questions.join(contexts, "db_id", "left").withColumn("prompt", F.concat(
        "header", "rules", knowledge_section(F.col("external_knowledge")), F.lit("\nQUESTION: "), "question"))
        .withColumn("error_class", F.when(F.col("header").isNull(), "unknown_dataset")).drop("header", "rules"))


def token_estimate(text: Column) -> Column:
    """Four bytes per token."""
    return F.floor(F.octet_length(text) / 4).cast("bigint")


def request_body(prompt: Column, model: str, instructions: str, max_tokens: int,
                 file_id: Column) -> Column:
    """The nested body of one batch request."""
    return F.struct(
        F.lit(model).alias("model"), F.lit(max_tokens).alias("max_output_tokens"),
        F.array(F.struct(F.lit("code_interpreter").alias("type"), F.struct(
            F.lit("auto").alias("type"), F.array(file_id).alias("file_ids")).alias("container")))
        .alias("tools"),
        F.lit(instructions).alias("instructions"),
        F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("input"))


def request_lines(prompts: DataFrame, model: str, instructions: str, max_tokens: int = 4096,
                  file_id: str = "file_id") -> DataFrame:
    """(index, value): one JSON line per question of a batch request file."""
    body = request_body(F.col("prompt"), model, instructions, max_tokens, F.col(file_id))
    return prompts.select("index", F.to_json(F.struct(
        F.col("index").cast("string").alias("custom_id"), F.lit("POST").alias("method"),
        F.lit(RESPONSES_ENDPOINT).alias("url"), body.alias("body"))).alias("value"))


def static_prefixes(catalog: DataFrame, texts: DataFrame) -> DataFrame:
    """(db_id, prefix): header and full dataset text, the part prompts share.

    Kept apart from the questions: joining it in would repeat the dataset once
    per question. Requests refer to it by ``db_id``. Datasets that do not fit a row
    are served by :func:`prefix_chunks`.
    """
    header = dataset_header(F.col("db_id"), F.col("delimiter"), F.col("encoding"), F.col("columns"))
    return catalog.join(texts, "db_id").select(
        "db_id", F.concat(header, F.lit("\nCSV DATA:\n"), "text").alias("prefix"))


def prefix_chunks(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """(db_id, block, piece, text, sha256): the prefix of :func:`static_prefixes` in chunks, the header ahead.

    No row holds a whole dataset; equal chunks of several datasets share their address.
    """
    header = F.concat(dataset_header(F.col("db_id"), F.col("delimiter"), F.col("encoding"), F.col("columns")), F.lit("\nCSV DATA:\n"))
    heads = catalog.select("db_id", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("piece"), header.alias("text"))
    heads = heads.withColumn("sha256", F.sha2("text", 256))
    return chunks.join(catalog.select("db_id"), "db_id", "left_semi").select(*heads.columns).unionByName(heads)


def write_prefixes(chunks: DataFrame, path: str) -> None:
    """Text files per dataset whose parts, in order of their names, are its prefix."""
    ordered = chunks.repartitionByRange("db_id", "block", "piece").sortWithinPartitions("db_id", "block", "piece")
    ordered.select("db_id", F.col("text").alias("value")).write.option("lineSep", "\u0000").partitionBy("db_id").text(path)


def question_suffixes(questions: DataFrame) -> DataFrame:
    """(index, db_id, suffix): the part that differs per question."""
    return questions.select("index", "db_id", F.concat(
        knowledge_section(F.col("external_knowledge")), F.lit("\nQUESTION: "), "question")
        .alias("suffix"))


def file_message_prefix(filename: Column, text: Column) -> Column:
    """The dataset text of a chat message, wrapped and named."""
    return F.concat(F.lit('<csv filename="'), filename, F.lit('">\n'), text, F.lit("\n</csv>\n\n"))
