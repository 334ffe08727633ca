"""Questions, answers, responses, profiles and reports as tables."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.flatten import PARTS_DDL
from tallyframe.operators.work import QUESTION_FIELDS, latest_per_key
from tallyframe.sources.ranges import json_elements

QUESTION_DDL = ("index bigint, db_id string, sql_complexity string, question_style string, "
                "question string, external_knowledge string, cot string, sql string")
ANSWER_DDL = QUESTION_DDL + ", result string, raw_output string"
_ITEM_DDL = QUESTION_DDL.replace("index bigint, ", "")


def question_arrays(texts: DataFrame, value: str = "value") -> DataFrame:
    """Questions of JSON-array texts, one array per row, other columns kept.

    ``index`` is the position in the array; unreadable texts give no rows.
    """
    keep = [c for c in texts.columns if c != value]
    items = texts.select(*keep, F.posexplode(
        F.from_json(value, f"array<struct<{_ITEM_DDL}>>")).alias("index", "q"))
    return _filled(items.select(*keep, F.col("index").cast("bigint"), "q.*"), keep)


def read_question_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions per file, of any size and with or without line breaks.

    A file is cut at the borders of its elements by all tasks that read it; ``index``
    is the place in its array. A file that is no array or does not close gives no rows.
    """
    doc = F.from_json("record", f"struct<{_ITEM_DDL}>")
    items = json_elements(spark, path).select(F.col("number").alias("index"), doc.alias("q"))
    return _filled(items.where(F.col("q").isNotNull()).select("index", "q.*"))


def read_questions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Questions from a table or JSON lines that carry their index."""
    return _filled(spark.read.schema(QUESTION_DDL).format(fmt).load(path))


def _filled(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    optional = [f for f in QUESTION_FIELDS if f not in ("index", "db_id", "question")]
    return df.withColumns({f: F.coalesce(f, F.lit("")) for f in optional}).select(*keep, *QUESTION_FIELDS)


def write_questions(questions: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII text kept."""
    questions.write.mode("overwrite").json(path)


def _absent(exc: AnalysisException) -> bool:
    """Whether a read failed because nothing is stored; any other failure is raised."""
    return exc.getCondition() == "PATH_NOT_FOUND"


#: Answers of a part lie in so many files by the hash of their index.
BUCKETS = 64
_PART_DDL = ANSWER_DDL + ", origin string, epoch bigint, bucket int"


def run_dir(root: str, checkpoint: str, model_id: str) -> str:
    return f"{root}/checkpoint={checkpoint}/model_id={model_id.replace('/', '%2F')}"


def bucket_of(index: Column) -> Column:
    return F.pmod(F.xxhash64(index.cast("bigint")), F.lit(BUCKETS)).cast("int")


def _manifest(spark: SparkSession, run: str) -> tuple[str | None, dict[str, int]]:
    """(base, last epoch by origin that it holds) of the latest compaction, as its manifest says."""
    try:
        rows = spark.read.schema("version long, base string, origin string, epoch long").json(f"{run}/_manifests")
        latest = rows.agg(F.max("version")).first()[0]
    except AnalysisException as exc:
        if not _absent(exc):
            raise
        return None, {}
    found = rows.where(F.col("version") == latest).collect()  # a row per origin
    return (found[0]["base"], {r["origin"]: r["epoch"] for r in found}) if found else (None, {})


def read_answer_parts(spark: SparkSession, root: str, checkpoint: str, model_id: str,
                      buckets: list[int] | None = None) -> DataFrame:
    """Stored answers of a run with the (origin, epoch) part each came from.

    The base of the last compaction and the parts stored since are read, of both only
    the files of ``buckets`` if given. An absent run gives an empty table.
    """
    run = run_dir(root, checkpoint, model_id)
    base, included = _manifest(spark, run)

    def stored(path: str) -> DataFrame:
        try:
            found = spark.read.schema(_PART_DDL).parquet(path)
        except AnalysisException as exc:
            if not _absent(exc):
                raise
            return spark.createDataFrame([], _PART_DDL)
        return found.where(F.col("bucket").isin(buckets)) if buckets is not None else found
    parts = stored(run)
    for origin, epoch in included.items():
        parts = parts.where((F.col("origin") != origin) | (F.col("epoch") > epoch))
    return (stored(f"{run}/{base}").unionByName(parts) if base else parts).drop("bucket")


def read_answers(spark: SparkSession, root: str, checkpoint: str, model_id: str) -> DataFrame:
    """One stored answer per index: a valid one before an error, then the latest."""
    return _best(read_answer_parts(spark, root, checkpoint, model_id)).select(
        *QUESTION_FIELDS, "result", F.coalesce("raw_output", F.lit("")).alias("raw_output"))


def _best(parts: DataFrame) -> DataFrame:
    version = F.struct(~F.coalesce("result", F.lit("")).startswith("ERROR:"), "epoch", "origin")
    return latest_per_key(parts.withColumn("_v", version), "index", "_v").drop("_v")


def store_answers(answers: DataFrame, root: str, checkpoint: str, model_id: str, origin: str,
                  epoch: int) -> None:
    """Write one part of a run. Storing the same part again replaces it."""
    part = f"{run_dir(root, checkpoint, model_id)}/origin={origin}/epoch={epoch}"
    rows = answers.select(*QUESTION_FIELDS, "result", "raw_output", bucket_of(F.col("index")).alias("bucket"))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(part)


def compact_answers(spark: SparkSession, root: str, checkpoint: str, model_id: str, remove: bool = True) -> None:
    """Merge all parts into one base, a file per bucket, and point the manifest to it.

    One answer per index stays, as :func:`read_answers` picks it, with the part it came
    from. The manifest is written last: until then readers see the old state, and a
    part that is stored again after it was merged is ignored. ``remove`` deletes merged
    parts and older bases; nobody else may read the run meanwhile.
    """
    run = run_dir(root, checkpoint, model_id)
    _, before = _manifest(spark, run)
    parts = read_answer_parts(spark, root, checkpoint, model_id)
    newest = {r["origin"]: r["epoch"] for r in parts.groupBy("origin").agg(F.max("epoch").alias("epoch")).collect()}
    included = {o: max(before.get(o, e), e) for o, e in {**before, **newest}.items()}
    if not included:
        return
    version = time.time_ns()
    base = f"_base/{version}"
    best = _best(parts).withColumn("bucket", bucket_of(F.col("index")))
    best.repartition("bucket").write.partitionBy("bucket").parquet(f"{run}/{base}")
    spark.createDataFrame([(version, base, o, e) for o, e in included.items()], "version long, base string, origin string, epoch long").write.mode(
        "append").json(f"{run}/_manifests")
    if remove:
        _remove_merged(spark, run, base, included)


def _remove_merged(spark: SparkSession, run: str, base: str, included: dict[str, int]) -> None:
    """Deletes the parts and bases that the manifest no longer names, on whatever file system holds them."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(run).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(folder: str) -> list[str]:
        return [f.getPath().getName() for f in store.listStatus(path(folder))] if store.exists(path(folder)) else []
    for origin, last in included.items():
        for name in names(f"{run}/origin={origin}"):
            if name.startswith("epoch=") and int(name[6:]) <= last:
                store.delete(path(f"{run}/origin={origin}/{name}"), True)
    for name in names(f"{run}/_base"):
        if f"_base/{name}" != base:
            store.delete(path(f"{run}/_base/{name}"), True)


def read_answer_array(spark: SparkSession, path: str) -> DataFrame:
    """Answers from a stored JSON array; unreadable or absent gives no rows."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as exc:
        if not _absent(exc):
            raise
        return spark.createDataFrame([], ANSWER_DDL)
    items = raw.select(F.explode(F.from_json("value", f"array<struct<{ANSWER_DDL}>>")).alias("a"))
    return items.select("a.*").withColumn("raw_output", F.coalesce("raw_output", F.lit("")))


def read_response_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested response files; the question index comes from the file name."""
    inner = PARTS_DDL[len("struct<"):-1].replace("\n", " ")
    docs = (spark.read.schema(", ".join(_split_fields(inner))).option("multiLine", True).json(path))
    return docs.select(F.regexp_extract(F.col("_metadata.file_path"), r"response_q(\d+)", 1)
                       .try_cast("bigint").alias("index"), "*")


def _split_fields(ddl: str) -> list[str]:
    """Top-level ``name: type`` pairs of a struct body as ``name type``."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = ddl[start:i].split(":", 1)
            out.append(f"{name.strip()} {kind.strip()}")
            start = i + 1
    return out


def split_order() -> Column:
    """Order of input splits over a folder: file age, file, place in the file."""
    meta = F.col("_metadata")
    return F.struct(meta["file_modification_time"], meta["file_path"], meta["file_block_start"])


def with_line_order(lines: DataFrame, split: Column) -> DataFrame:
    """Add ``_order``: the split's order, then the line's place in it."""
    return lines.withColumn("_order", F.struct(split, F.monotonically_increasing_id()))


def parse_batch_lines(lines: DataFrame, order: str) -> DataFrame:
    """(index, body) of batch-output lines in ``value``.

    Blank and unreadable lines are skipped, a record without a body or of
    another outcome than success has a null one, and of repeated ids the last
    by ``order`` counts.
    """
    doc = F.from_json("value", "custom_id string, response struct<body: variant>, "
                               "result struct<type: string, message: variant>")
    parsed = lines.where(F.trim("value") != "").select(
        F.col(order).alias("_v"), doc.alias("d")).where(F.col("d.custom_id").isNotNull())
    message = F.when(F.col("d.result.type") == "succeeded", F.col("d.result.message"))
    body = F.coalesce(F.to_json("d.response.body"), F.to_json(message))
    rows = parsed.select(F.col("d.custom_id").try_cast("bigint").alias("index"),
                         F.nullif(body, F.lit("null")).alias("body"), "_v")
    return latest_per_key(rows.where(F.col("index").isNotNull()), "index", "_v").drop("_v")


def read_batch_output(spark: SparkSession, path: str) -> DataFrame:
    """Batch-output JSON lines from files."""
    return parse_batch_lines(with_line_order(spark.read.text(path), split_order()), "_order")


def write_lines(lines: DataFrame, path: str) -> None:
    """A ``value`` column as text lines (batch requests)."""
    lines.select("value").write.mode("overwrite").text(path)


def write_profiles(documents: DataFrame, path: str) -> None:
    """Profile documents, one partition per dataset."""
    documents.write.mode("overwrite").partitionBy("db_id").json(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Stored profiles' groups and flags; absent gives an empty table."""
    ddl = ("db_id string, inferred_types struct<date_columns: array<string>, "
           "numeric_columns: array<string>, boolean_like_columns: array<string>, "
           "id_like_columns: array<string>, high_missing_columns: array<string>, "
           "numeric_as_text_columns: array<string>>, quality_flags struct<"
           "mixed_date_format_columns: array<string>, has_bom: boolean, non_comma_delimiter: boolean>")
    try:
        return spark.read.schema(ddl).json(path)
    except AnalysisException as exc:
        if not _absent(exc):
            raise
        return spark.createDataFrame([], ddl)


def write_report(report: DataFrame, path: str) -> None:
    """An evaluation or cleaning report as JSON lines."""
    report.write.mode("overwrite").json(path)


def read_sql_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A database table over JDBC, for datasets kept in a database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
