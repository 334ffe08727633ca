"""Source and sink queries: tables written in foreign shapes and read back.

Each run writes into a fresh folder under the session's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.operators.clean import normalize_table
from tallyframe.operators.compare import preview
from tallyframe.operators.evaluate import namespace
from tallyframe.operators.folder import normalize_folder
from tallyframe.operators.profile import profile_document
from tallyframe.operators.prompts import prefix_chunks, request_lines
from tallyframe.plans.messy import MESSY_ORDERS, messy_orders
from tallyframe.plans.cleaning import CLEANED
from tallyframe.plans.evaluation import DETAILS, scored
from tallyframe.plans.registry import query, table
from tallyframe.plans.selection import questions
from tallyframe.session import shared_dir
from tallyframe.sources import datasets, records


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def write_csv(df: DataFrame, folder: str, delimiter: str, bom: bool = False) -> None:
    """CSV parts with a header each; ``bom`` puts the mark before the first name."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "\ufeff" + first) if bom else df
    out.write.option("header", True).option("sep", delimiter).option("escape", '"').csv(folder)


@query("csv_roundtrip", oracle="""
SELECT item_id, replace(text, chr(10), '') AS text, 'short' AS tail FROM benchmark
UNION ALL SELECT doc_id, replace(text, chr(10), '') AS text, 'short' FROM documents""")
def csv_roundtrip(spark, sf_dir):
    """Semicolon CSV with quoted line breaks, which the reader removes."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    folder = fresh_dir(spark, "csv")
    write_csv(b.unionByName(d).withColumn("tail", F.lit("short")), folder, ";")
    rows = datasets.read_dataset(spark, folder, ["item_id", "text", "tail"], delimiter=";", row_order=None)
    return rows.select(F.col("item_id").cast("bigint").alias("item_id"), "text", "tail")


@query("csv_splittable", oracle="SELECT o_orderkey, o_orderpriority, '' AS missing FROM orders")
def csv_splittable(spark, sf_dir):
    """No quoted breaks: the file stays splittable; a missing last field reads ''."""
    folder = fresh_dir(spark, "csv")
    write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), folder, "\t")
    rows = datasets.read_dataset(spark, folder, ["o_orderkey", "o_orderpriority", "missing"],
                                 delimiter="\t", row_order="pos")
    return rows.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderpriority", "missing")


@query("csv_duplicate_headers", oracle="SELECT c_custkey, c_mktsegment AS a, c_mktsegment AS a_2 FROM customer")
def csv_duplicate_headers(spark, sf_dir):
    """Of two columns with one header the last value stands for both."""
    folder = fresh_dir(spark, "csv")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"))
    write_csv(c, folder, ",")
    rows = datasets.read_dataset(spark, folder, ["c_custkey", "a", "a"], row_order=None)
    return rows.toDF("c_custkey", "a", "a_2").withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


def _dialect_folder(spark, sf_dir) -> str:
    """One folder per kind: comma, semicolon, tab and pipe files, some with a mark."""
    root = fresh_dir(spark, "dialects")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    for name, sep, bom in (("comma", ",", False), ("semi", ";", True), ("tab", "\t", False), ("pipe", "|", True)):
        write_csv(s, f"{root}/{name}", sep, bom)
    return root


@query("dialect_detect", oracle="""
SELECT kind, encoding, delimiter, 's_suppkey,s_name,s_acctbal' AS columns FROM (VALUES ('comma', 'utf-8', ','),
  ('semi', 'utf-8-sig', ';'), ('tab', 'utf-8', chr(9)), ('pipe', 'utf-8-sig', '|')) t(kind, encoding, delimiter)
WHERE (SELECT count(*) FROM supplier) > 0""")
def dialect_detect(spark, sf_dir):
    """Encoding, delimiter and header of every file, from all its lines."""
    root = _dialect_folder(spark, sf_dir)
    found = datasets.dataset_catalog(spark, f"{root}/*")
    kind = F.element_at(F.split("path", "/"), -2)
    return found.select(kind.alias("kind"), "encoding", "delimiter", F.array_join("columns", ",").alias("columns")).distinct()


@query("dialect_of_all_lines", oracle="""
SELECT ';' AS delimiter, 'o_orderkey;note;o_orderpriority' AS columns, 'utf-8' AS encoding FROM orders LIMIT 1""")
def dialect_of_all_lines(spark, sf_dir):
    """Each file's head holds as many commas as semicolons, the rest of it none."""
    o = table(spark, sf_dir, "orders")
    share = F.percent_rank().over(Window.partitionBy("_file").orderBy("o_orderkey"))
    dealt = o.withColumn("_file", F.spark_partition_id()).withColumn("_share", share)
    note = F.when(F.col("_share") < 0.3, "first,second,third").otherwise("plain")
    folder = fresh_dir(spark, "late")
    write_csv(dealt.select("o_orderkey", note.alias("note"), "o_orderpriority"), folder, ";")
    found = datasets.dataset_catalog(spark, folder)
    return found.select("delimiter", F.array_join("columns", ";").alias("columns"), "encoding").distinct()


@query("csv_ranges", oracle="""
SELECT doc_id, md5(replace(text, chr(10), '')) AS text_md5, source, true AS several_ranges FROM documents""")
def csv_ranges(spark, sf_dir):
    """Quoted line breaks in files that are cut into many byte ranges, each with a state of its own."""
    folder = fresh_dir(spark, "ranges")
    write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), folder, ",")
    session = _small_ranges(spark, folder)
    rows = datasets.read_dataset(session, folder, ["doc_id", "text", "source"], multiline=True, row_order=None)
    starts = session.read.text(folder).select("_metadata.file_path", "_metadata.file_block_start").distinct()
    ranges, files = starts.agg(F.count(F.lit(1)), F.count_distinct("file_path")).first()
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), "source",
                       F.lit(ranges > files).alias("several_ranges"))


#: Ranges of so many bytes in all share a task.
_TASK_BYTES = 32 << 20


def _small_ranges(spark: SparkSession, folder: str) -> SparkSession:
    """A session that deals files out in ranges of 64 KiB.

    A task reads many ranges, so the number of tasks follows the folder's size and the
    cluster, not the size of a range; what is known of a range stays inside it.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    session.conf.set("spark.sql.files.openCostInBytes", "1")
    size = spark.read.format("binaryFile").load(folder).agg(F.sum("length")).first()[0] or 0
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-size // _TASK_BYTES))
    session.conf.set("spark.sql.files.maxPartitionNum", str(tasks))
    return session


@query("question_array_file", oracle="""
SELECT doc_id AS doc_id, source AS db_id, md5(text) AS question_md5, lang AS question_style, '' AS cot FROM documents""")
def question_array_file(spark, sf_dir):
    """A file without line breaks that holds one array of all questions, read by several tasks."""
    d = table(spark, sf_dir, "documents")
    item = F.to_json(F.struct(F.col("source").alias("db_id"), F.col("text").alias("question"), F.col("lang").alias("question_style"),
                              F.struct(F.col("doc_id").alias("n"), F.array(F.lit("]}"), F.lit('"')).alias("odd")).alias("extra"),
                              F.col("doc_id").cast("string").alias("sql")))
    folder = fresh_dir(spark, "array")
    # One document a file of the table: brackets ahead and behind, commas between.
    dealt = d.select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"), item.alias("item"))
    edge = Window.partitionBy("_p").orderBy("_i")
    line = F.concat(F.when(F.lag("_i").over(edge).isNull(), "[").otherwise(""), F.col("item"),
                    F.when(F.lead("_i").over(edge).isNull(), "]\n").otherwise(","))
    # One file per document array, its elements in order and without any line break between them.
    dealt.repartition("_p").sortWithinPartitions("_p", "_i").select(line.alias("value")).write.option("lineSep", " ").text(folder)
    back = records.read_question_array(_small_ranges(spark, folder), folder)
    return back.select(F.col("sql").cast("bigint").alias("doc_id"), "db_id", F.md5("question").alias("question_md5"), "question_style", "cot")


@query("normalize_folder", oracle=f"""
WITH {MESSY_ORDERS}
SELECT 'orders' AS kind, 'utf-8' AS encoding, ';' AS delimiter, count(*) :: BIGINT AS rows, 8 :: BIGINT AS cols, 1 :: BIGINT AS headers_changed,
  (count(*) FILTER (pos % 50 = 49) + count(*) FILTER (pos % 3 = 2) + count(*) FILTER (pos % 5 = 3)) :: BIGINT AS missing_normalized,
  count(*) FILTER (pos % 50 <> 49 AND pos % 4 IN (1, 3)) AS dates_normalized, true AS written
FROM messy_orders
UNION ALL SELECT 'suppliers', 'utf-8-sig', ',', count(*), 2, 1, 0, 0, true FROM supplier""")
def normalize_a_folder(spark, sf_dir):
    """Two folders of files cleaned, a report row per file; counts summed by kind."""
    root, target = fresh_dir(spark, "folder"), fresh_dir(spark, "cleaned")
    write_csv(messy_orders(spark, sf_dir).withColumnRenamed("pos", "Order No."), f"{root}/orders", ";")
    write_csv(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s_suppkey"), F.col("s_name").alias("S Name")),
              f"{root}/suppliers", ",", bom=True)
    report = normalize_folder(spark, f"{root}/orders", f"{target}/orders").withColumn("kind", F.lit("orders")).unionByName(
        normalize_folder(spark, f"{root}/suppliers", f"{target}/suppliers").withColumn("kind", F.lit("suppliers")))
    back = spark.read.option("header", True).option("recursiveFileLookup", True).csv(target)
    counted = back.groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3).alias("kind")).count()
    sums = report.groupBy("kind", "encoding", "delimiter").agg(
        F.sum("rows").alias("rows"), F.max("cols").alias("cols"), F.max("headers_changed").alias("headers_changed"),
        F.sum("missing_normalized").alias("missing_normalized"), F.sum("dates_normalized").alias("dates_normalized"))
    return sums.join(counted, "kind").select("*", (F.col("count") == F.col("rows")).alias("written")).drop("count")


@query("dataset_catalog", oracle="""
SELECT kind, true AS sized, true AS tokens_ok FROM (VALUES ('comma'), ('semi'), ('tab'), ('pipe')) t(kind)
WHERE (SELECT count(*) FROM supplier) > 0""")
def dataset_catalog(spark, sf_dir):
    """Sizes and token estimates against the listing; membership by semi join."""
    root = _dialect_folder(spark, sf_dir)
    found = datasets.dataset_catalog(spark, f"{root}/*")
    listed = datasets.list_datasets(spark, f"{root}/*").select("path", F.col("size_bytes").alias("listed"))
    asked = datasets.known_datasets(found.select("db_id", "path", "size_bytes", "approx_tokens"), found)
    return asked.join(listed, "path").select(
        F.element_at(F.split("path", "/"), -2).alias("kind"), (F.col("size_bytes") == F.col("listed")).alias("sized"),
        (F.col("approx_tokens") == F.expr("listed div 4")).alias("tokens_ok"))


@query("normalize_csv_files", oracle=CLEANED)
def normalize_csv_files(spark, sf_dir):
    """File to file: read messy CSV, clean it, write it, read the result."""
    source, target = fresh_dir(spark, "raw"), fresh_dir(spark, "normalized")
    raw = messy_orders(spark, sf_dir)
    write_csv(raw, source, ";")
    rows = datasets.read_dataset(spark, source, raw.columns, delimiter=";", row_order=None)
    numbered = rows.withColumn("pos", F.col("pos").cast("bigint"))
    datasets.write_normalized(normalize_table(numbered, "pos"), target)
    back = datasets.read_dataset(spark, target, raw.columns, row_order=None)
    return back.withColumn("pos", F.col("pos").cast("bigint"))


@query("question_roundtrip", oracle="""
SELECT doc_id AS "index", source AS db_id, md5(text) AS question_md5, lang AS question_style, '' AS cot FROM documents""")
def question_roundtrip(spark, sf_dir):
    """Questions exported as JSON lines and read back; optional fields filled."""
    folder = fresh_dir(spark, "questions")
    records.write_questions(questions(spark, sf_dir).drop("cot", "sql"), folder)
    return records.read_questions(spark, folder, "json").select(
        "index", "db_id", F.md5("question").alias("question_md5"), "question_style", "cot")


@query("question_array", oracle="""
SELECT doc_id, generate_subscripts(lines, 1) - 1 AS "index", source AS db_id, md5(unnest(lines)) AS question_md5, '' AS sql
FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents)""")
def question_array(spark, sf_dir):
    """JSON arrays of questions, one per document: a question per line."""
    arrays = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.transform(
        F.split("text", "\n"), lambda x: F.struct(F.col("source").alias("db_id"), x.alias("question")))).alias("value"))
    return records.question_arrays(arrays).select(
        "doc_id", "index", "db_id", F.md5("question").alias("question_md5"), "sql")


@query("checkpoint_roundtrip", oracle="""
SELECT doc_id AS "index", '[[' || (n_chars + 1) || ']]' AS result, 'second' AS raw_output FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, '[[' || n_chars || ']]', 'first' FROM documents WHERE lang <> 'en'""")
def checkpoint_roundtrip(spark, sf_dir):
    """Two parts of a run: a later answer replaces an error, not a valid answer."""
    root = fresh_dir(spark, "answers")
    q = questions(spark, sf_dir).join(table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("index"), "n_chars", "lang"), "index")

    def answer(n):
        return F.concat(F.lit("[["), n.cast("string"), F.lit("]]"))
    first = q.withColumns({"result": F.when(F.col("lang") == "en", "ERROR:no_output").otherwise(answer(F.col("n_chars"))),
                           "raw_output": F.lit("first")})
    second = q.where(F.col("lang") == "en").withColumns({"result": answer(F.col("n_chars") + 1), "raw_output": F.lit("second")})
    records.store_answers(first, root, "run", "m/1", "batch", 0)
    records.store_answers(second, root, "run", "m/1", "batch", 1)
    absent = records.read_answers(spark, root, "run", "other")
    return records.read_answers(spark, root, "run", "m/1").unionByName(absent).select("index", "result", "raw_output")


@query("response_documents", oracle="""
SELECT hour(ts) AS "index", 'm-' || hour(ts) AS model_version, count(*) AS prompt_tokens, 'STOP' AS finish_reason
FROM events GROUP BY hour(ts)""")
def response_documents(spark, sf_dir):
    """Nested response files, one per hour of day: the index is in the path."""
    root = fresh_dir(spark, "responses")
    per_hour = table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    docs = per_hour.select(
        F.concat(F.lit("response_q"), F.col("h").cast("string")).alias("name"),
        F.concat(F.lit("m-"), F.col("h").cast("string")).alias("model_version"),
        F.struct(F.col("n").alias("prompt_token_count")).alias("usage_metadata"),
        F.array(F.struct(F.lit("STOP").alias("finish_reason"))).alias("candidates"))
    docs.write.partitionBy("name").json(root)
    return records.read_response_documents(spark, f"{root}/*").select(
        "index", "model_version", F.col("usage_metadata.prompt_token_count").alias("prompt_tokens"),
        F.col("candidates")[0]["finish_reason"].alias("finish_reason"))


def batch_lines(spark, sf_dir) -> DataFrame:
    """Batch-output lines per event: success, missing body, failed record, junk."""
    e = table(spark, sf_dir, "events")
    cid = F.col("event_id").cast("string").alias("custom_id")
    body = F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct(
        F.lit("output_text").alias("type"), F.concat(F.lit('[["'), "event_type", F.lit('"]]')).alias("text")))
        .alias("content"))).alias("output"))
    good = F.to_json(F.struct(cid, F.struct(body.alias("body")).alias("response")))
    bare = F.to_json(F.struct(cid, F.struct(F.lit(400).alias("status")).alias("response")))
    failed = F.to_json(F.struct(cid, F.struct(F.lit("errored").alias("type")).alias("result")))
    done = F.to_json(F.struct(cid, F.struct(F.lit("succeeded").alias("type"), F.struct(
        F.col("event_type").alias("kind")).alias("message")).alias("result")))
    line = (F.when(F.col("event_type") == "click", bare).when(F.col("event_type") == "error", failed)
            .when(F.col("event_type") == "view", done).otherwise(good))
    junk = F.when(F.col("event_type") == "click", "").otherwise(F.lit('{"custom_id": "7", '))
    return e.select("event_id", F.explode(F.array(junk, line)).alias("value"))


@query("batch_jsonl_ingest", oracle="""
SELECT event_id AS "index", CASE WHEN event_type IN ('click', 'error') THEN '' WHEN event_type = 'view' THEN '{"kind":"view"}'
  ELSE '{"output":[{"content":[{"text":"[[\\"' || event_type || '\\"]]","type":"output_text"}],"type":"message"}]}' END AS body
FROM events""")
def batch_jsonl_ingest(spark, sf_dir):
    """Blank and broken lines skipped; records without a body kept as null."""
    folder = fresh_dir(spark, "batch")
    records.write_lines(batch_lines(spark, sf_dir), folder)
    return records.read_batch_output(spark, folder).select("index", F.coalesce("body", F.lit("")).alias("body"))


@query("batch_duplicates", oracle="""
SELECT user_id AS "index", '{"n":' || max(event_id) || '}' AS body FROM events GROUP BY user_id""")
def batch_duplicates(spark, sf_dir):
    """Of repeated ids the last line counts."""
    lines = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(
        F.col("user_id").cast("string").alias("custom_id"),
        F.struct(F.struct(F.col("event_id").alias("n")).alias("body")).alias("response"))).alias("value"))
    return records.parse_batch_lines(lines, "event_id")


@query("request_jsonl", oracle="""
SELECT doc_id AS "index", '/v1/responses' AS url, md5(text) AS content_md5 FROM documents""")
def request_jsonl(spark, sf_dir):
    """Request lines written and read back from text files."""
    folder = fresh_dir(spark, "requests")
    asked = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("index"), F.col("text").alias("prompt"), F.lit("f").alias("file_id"))
    records.write_lines(request_lines(asked, "model-x", "Answer."), folder)
    doc = F.from_json("value", "custom_id string, url string, body struct<input: array<struct<content: string>>>")
    back = spark.read.text(folder).select(doc.alias("d"))
    return back.select(F.col("d.custom_id").cast("bigint").alias("index"), "d.url",
                       F.md5(F.col("d.body.input")[0]["content"]).alias("content_md5"))


@query("profile_roundtrip", oracle=f"""
WITH {MESSY_ORDERS}
SELECT 'orders' AS db_id, 'order_date' AS dates, true AS non_comma FROM messy_orders LIMIT 1""")
def profile_roundtrip(spark, sf_dir):
    """A profile stored as JSON and read back; absent profiles give no rows."""
    folder = fresh_dir(spark, "profiles")
    records.write_profiles(profile_document(messy_orders(spark, sf_dir), "orders", "pos", delimiter=";"), folder)
    stored = records.read_profiles(spark, folder).unionByName(records.read_profiles(spark, folder + "-absent"))
    return stored.select("db_id", F.array_join("inferred_types.date_columns", ",").alias("dates"),
                         F.col("quality_flags.non_comma_delimiter").alias("non_comma"))


@query("report_roundtrip", oracle=f"""
WITH {DETAILS} SELECT "index", status, reason, true AS complete
FROM details WHERE status = 'wrong'""")
def report_roundtrip(spark, sf_dir):
    """The report of a run: every wrong answer with both sides, written and read back."""
    folder = fresh_dir(spark, "report")
    wrong = scored(spark, sf_dir).where("status = 'wrong'")
    records.write_report(wrong.select("index", "status", "reason", "detail", preview(F.col("gold")).alias("expected"),
                                      preview(F.col("predicted")).alias("predicted")), folder)
    back = spark.read.schema("index bigint, status string, reason string, detail string, expected array<array<string>>, "
                             "predicted array<array<string>>").json(folder)
    sides = F.col("expected").isNotNull() & (F.col("predicted").isNotNull() | F.col("detail").isNotNull())
    return back.select("index", "status", "reason", sides.alias("complete"))


@query("gold_tables", oracle="SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def gold_tables(spark, sf_dir):
    """Views of a dataset live in a session of their own."""
    session = namespace(spark, lambda s: s.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("t"))
    folder = fresh_dir(spark, "gold")
    session.sql("SELECT c_mktsegment, COUNT(*) AS n FROM t GROUP BY c_mktsegment").write.parquet(folder)
    return spark.read.parquet(folder)


@query("dataset_texts", oracle="""
SELECT 'part' AS kind, count(*) + 1 AS lines FROM part""")
def dataset_texts(spark, sf_dir):
    """File texts by dataset, line by line."""
    folder = fresh_dir(spark, "texts")
    write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name"), folder, ",")
    texts = datasets.dataset_texts(spark, folder)
    kind = F.substring("db_id", 1, 4).alias("kind")
    per_file = texts.groupBy(kind, "db_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line") == "p_partkey,p_name").alias("heads"))
    return per_file.groupBy("kind").agg((F.sum("lines") - F.sum("heads") + 1).alias("lines"))




@query("prefix_chunks", oracle="""
SELECT 'CSV DATA:' AS head_ends, true AS in_order, true AS addressed, count(*) AS rows, sum(hash) :: BIGINT AS lengths
FROM (SELECT length(p_partkey || ',' || p_name) AS hash FROM part)""")
def prefix_chunks_of_files(spark, sf_dir):
    """Static prefixes in chunks: header first, the file behind it in order, no row with a whole file."""
    folder = fresh_dir(spark, "prefix")
    write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name").sortWithinPartitions("p_partkey"), folder, ",")
    found = prefix_chunks(datasets.dataset_catalog(spark, folder), datasets.dataset_chunks(spark, folder, chunk_lines=50))
    lines = F.filter(F.split("text", "\n"), lambda x: (x != "") & (x != "p_partkey,p_name"))
    body = F.col("block") >= 0
    keys = F.transform(lines, lambda x: F.split(x, ",")[0].try_cast("bigint"))
    chunk = found.select("db_id", "block", "piece", body.alias("body"), (F.col("sha256") == F.sha2("text", 256)).alias("same"),
                         F.when(~body, F.element_at(F.split(F.rtrim("text", F.lit("\n")), "\n"), -1)).alias("head"),
                         (keys == F.array_sort(keys)).alias("sorted"), F.array_min(keys).alias("low"), F.array_max(keys).alias("high"),
                         F.size(lines).alias("n"), F.aggregate(lines, F.lit(0), lambda t, x: t + F.length(x)).alias("chars"))
    earlier = F.max("high").over(Window.partitionBy("db_id").orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, -1))
    placed = chunk.withColumn("_after", F.coalesce(F.col("low") > earlier, F.lit(True)) & F.col("sorted"))
    return placed.agg(F.max("head").alias("head_ends"), F.bool_and(F.col("_after") | ~F.col("body")).alias("in_order"),
                      F.bool_and("same").alias("addressed"), F.sum(F.when(F.col("body"), F.col("n"))).alias("rows"),
                      F.sum(F.when(F.col("body"), F.col("chars"))).alias("lengths"))
