"""CSV datasets: dialects, catalog, scan, normalized output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.text import strip
from tallyframe.operators.ordering import with_row_order
from tallyframe.sources.ranges import csv_records

DELIMITERS = ",;\t|"
#: A delimiter has to cut so large a share of a file's lines into one number of fields.
LEAST_SHARE = 0.5


def list_datasets(spark: SparkSession, folder: str, pattern: str = "*.csv", required: bool = False) -> DataFrame:
    """(path, filename, db_id, size_bytes) of a folder's files; contents unread.

    Hidden files are skipped. An empty folder gives no rows, or an error if files are
    ``required``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select("path", name.alias("filename"),
                          F.regexp_replace(name, r"\.[^.]*$", "").alias("db_id"),
                          F.col("length").alias("size_bytes"), F.col("_metadata.file_path").alias("_file"))
    if required and listed.isEmpty():
        raise FileNotFoundError(f"no file in {folder} fits {pattern}")
    return listed.drop("_file")


def _lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(folder)
    return text.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value")


def _occurrences(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def delimiter_histogram(lines: DataFrame) -> DataFrame:
    """(_file, counts, lines, bytes): how many lines hold each delimiter how often, outside quotes."""
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counts = F.array(*[_occurrences(F.col("_bare"), d) for d in DELIMITERS])
    return lines.withColumn("_bare", bare).groupBy("_file", counts.alias("counts")).agg(
        F.count_if(strip(F.col("value")) != "").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))


def file_dialects(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(_file, delimiter, bytes, header) of every file, from all of its lines.

    The delimiter is the one that cuts the largest share of lines into the same number
    of fields, more fields before fewer; a comma if none reaches ``LEAST_SHARE``. The
    histogram it is read from has a row per file and combination of counts and is
    combined before it is shuffled. ``bytes`` are those of the lines and their ends.
    """
    lines = _lines(spark, folder, pattern)
    histogram = delimiter_histogram(lines)
    sizes = histogram.groupBy("_file").agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
    by_count = histogram.select("_file", "lines", F.posexplode("counts").alias("rank", "n")).where("n > 0").groupBy(
        "_file", "rank", "n").agg(F.sum("lines").alias("same"))
    best = by_count.groupBy("_file").agg(F.max(F.struct("same", "n", (-F.col("rank")).alias("r"))).alias("best"))
    names = F.array(*[F.lit(d) for d in DELIMITERS])
    chosen = F.when(F.col("best.same") >= LEAST_SHARE * F.col("lines"), F.element_at(names, 1 - F.col("best.r")))
    return (sizes.join(best, "_file", "left").join(_headers(lines), "_file", "left")
            .select("_file", F.coalesce(chosen, F.lit(",")).alias("delimiter"), "bytes", "header"))


def _headers(lines: DataFrame) -> DataFrame:
    """(_file, header): the first record of every file, which may go on over several lines."""
    head = lines.where("_block = 0").withColumn("_line", F.monotonically_increasing_id())
    first = head.groupBy("_file").agg(F.min_by("value", "_line").alias("header"))
    odd = F.col("_quotes") % 2 == 1
    going_on = first.where(_occurrences(F.col("header"), '"') % 2 == 1).select("_file")
    upto = Window.partitionBy("_file").orderBy("_line")
    counted = head.join(going_on, "_file", "left_semi").withColumn("_quotes", F.sum(_occurrences(F.col("value"), '"')).over(upto))
    ended = counted.withColumn("_closed", F.sum(F.when(~odd, 1).otherwise(0)).over(upto.rowsBetween(Window.unboundedPreceding, -1)))
    record = (ended.where("coalesce(_closed, 0) = 0").groupBy("_file").agg(F.sort_array(F.collect_list(F.struct("_line", "value"))).alias("p"))
              .select("_file", F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("_whole")))
    return first.join(record, "_file", "left").select("_file", F.coalesce("_whole", "header").alias("header"))


def _header_names(header: Column, delimiter: Column) -> Column:
    """Trimmed names of a header record; quotes around a name are taken off."""
    def names(d: str) -> Column:
        plain = F.split(header, f"[{d}]", -1)
        return F.when(header.contains('"'), F.split(header, f'[{d}](?=(?:[^"]*"[^"]*")*[^"]*$)', -1)).otherwise(plain)

    def name(cell: Column) -> Column:
        quoted = cell.startswith('"') & cell.endswith('"') & (F.length(cell) > 1)
        return strip(F.when(quoted, F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell))
    split = F.when(delimiter == DELIMITERS[0], names(DELIMITERS[0]))
    for d in DELIMITERS[1:]:
        split = split.when(delimiter == d, names(d))
    return F.when(header.isNull() | (header == ""), F.array().cast("array<string>")).otherwise(F.transform(split, name))


def dataset_catalog(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """One row per CSV file: dialect, columns, size and token estimate.

    All lines of a file decide on its delimiter; Spark lists no file without a byte. Its
    reader drops a byte order mark, so a file that is longer than its lines and their ends has one.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(
        "path", F.col("length").alias("size_bytes"), F.col("_metadata.file_path").alias("_file"))
    filename = F.element_at(F.split("path", "/"), -1)
    known = listed.join(file_dialects(spark, folder, pattern), "_file", "left")
    header = F.regexp_replace("header", r"\r\z", "")
    delimiter = F.coalesce("delimiter", F.lit(","))
    marked = F.col("size_bytes") - F.coalesce("bytes", F.lit(0)) >= 2  # 3, less one if the last line has no end
    return known.select(F.regexp_replace(filename, r"\.[^.]*$", "").alias("db_id"), filename.alias("filename"), delimiter.alias("delimiter"),
                        F.when(marked, "utf-8-sig").otherwise("utf-8").alias("encoding"), _header_names(header, delimiter).alias("columns"),
                        "size_bytes", F.expr("size_bytes div 4").alias("approx_tokens"), "path")


def known_datasets(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Questions whose dataset exists."""
    return questions.join(catalog.select("db_id"), "db_id", "left_semi")


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes (a field goes on)."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())


def read_dataset(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",",
                 encoding: str = "utf-8", multiline: bool | None = None,
                 newline_compat: bool = True, row_order: str | None = "pos") -> DataFrame:
    """All-text rows of one CSV file, short rows filled with ``''``.

    Extra fields are ignored; of columns with the same header the last value
    stands for all. ``multiline=None`` looks for quoted line breaks first; a file with
    some is cut into records range by range (:mod:`tallyframe.sources.ranges`), one
    without is read by Spark's own CSV reader. ``newline_compat`` removes those breaks
    from the values. ``row_order`` names the position column.
    """
    if multiline is None:
        multiline = has_quoted_newlines(spark, path)
    positional = [f"_c{i}" for i in range(len(columns))]
    schema = T.StructType([T.StructField(p, T.StringType()) for p in positional])
    options = {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE"}
    if multiline:
        records = csv_records(spark, path, delimiter, "" if newline_compat else "\n")
        body = records.where(~F.col("head") & (F.col("record") != ""))
        df = body.select(F.col("number").alias(row_order or "_number"), F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("_r"))
        df = df.select(*([row_order] if row_order else []), "_r.*")
    else:
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8")
              .options(**options).csv(path))
        if row_order:
            df = with_row_order(df, row_order)
    last = {name: p for name, p in zip(columns, positional)}

    def value(p: str):
        c = F.coalesce(F.col(p), F.lit(""))
        return F.regexp_replace(c, r"\R", "") if newline_compat and multiline else c
    out = df.select(*([row_order] if row_order else []),
                    *[value(last[n]).alias(f"_v{i}") for i, n in enumerate(columns)])
    return out.toDF(*([row_order] if row_order else []), *columns)


def write_normalized(df: DataFrame, folder: str, order_col: str | None = None) -> None:
    """UTF-8 comma CSV with a header, one file per task, into a new folder.

    Never the folder being read: the caller swaps the two when all is written.
    """
    out = df.drop(order_col) if order_col else df
    out.write.mode("errorifexists").option("header", True).option("escape", '"').option(
        "emptyValue", "").option("nullValue", "").csv(folder)


def dataset_texts(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(db_id, block, number, line): file texts line by line, ordered by byte range and place in it."""
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(folder)
    return text.select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("db_id"),
                       F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number"),
                       F.col("value").alias("line"))


def dataset_chunks(spark: SparkSession, folder: str, pattern: str = "*.csv", chunk_lines: int = 1000) -> DataFrame:
    """(db_id, block, piece, text, sha256): file texts in chunks of neighbouring lines, addressed by their content.

    A chunk never crosses a byte range, so a file of any size is chunked by the tasks
    that read it; read in order of (block, piece) the chunks are the file.
    """
    lines = dataset_texts(spark, folder, pattern)
    placed = lines.withColumn("piece", F.expr(f"(number & ((1L << 33) - 1)) div {chunk_lines}"))
    chunks = placed.groupBy("db_id", "block", "piece").agg(F.sort_array(F.collect_list(F.struct("number", "line"))).alias("x"))
    text = F.concat(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n"))
    return chunks.select("db_id", "block", "piece", text.alias("text")).withColumn("sha256", F.sha2("text", 256))
