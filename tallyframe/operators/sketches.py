"""Column profiles of a growing folder: sketches of each batch of files, merged when asked.

A batch of files leaves one row per column: exact counters, a HyperLogLog sketch of
its distinct values and a sketch of its frequent ones. Rows of several batches add
up, so a profile of a grown folder reads the files that came in and the rows of
those before.

Errors: counters and ratios are exact. Distinct counts have a standard error of
0.8 percent (``DISTINCT_BITS``). The count of a top value is exact while a column has
at most ``TRACKED`` different values and off by at most ``TOP_ERROR`` of its cells
beyond that; a value above that share is always found. The first values of a column
are not kept, as they need all values.

Defined results: null cells count as empty, hence missing; a column that only some
batches have counts the rows of those; a folder without files, or files without
rows, gives no columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.cells import (DATE_LAYOUTS, date_layout, is_missing, looks_boolean,
                                        looks_date, looks_numeric)
from tallyframe.functions.text import col, strip
from tallyframe.operators.profile import match_rates

DISTINCT_BITS = 14
TRACKED = 8192
#: The frequency sketch has 4/3 as many places as it tracks values, up to a power of two.
TOP_ERROR = 3.5 / 16384
#: Groups in which the tasks' sketches of one column are merged before they meet.
FAN_IN = 256

_COUNTERS = ("row_count", "present_count", "date_hits", "num_hits", "bool_hits")
SKETCH_DDL = ("column string, " + ", ".join(f"{c} bigint" for c in _COUNTERS)
              + ", layout_hits array<bigint>, distinct binary, top struct<sketch: binary, "
              "maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>")
_LOG_DDL = "path string, length bigint, modified timestamp, batch string"


def _merged() -> list[Column]:
    """Aggregates that add sketch rows up."""
    layouts = [F.sum(F.col("layout_hits")[i]) for i in range(len(DATE_LAYOUTS))]
    return [*[F.sum(c).alias(c) for c in _COUNTERS], F.array(*layouts).alias("layout_hits"),
            F.hll_union_agg("distinct").alias("distinct"),
            F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top")]


def sketch_columns(df: DataFrame) -> DataFrame:
    """One sketch row per column of a table, from one scan.

    Every task sends one row per column; they are merged in ``FAN_IN`` groups first, so
    that no task receives those of all tasks.
    """
    if not df.columns:
        return df.sparkSession.createDataFrame([], SKETCH_DDL)
    trimmed = df.select(*[F.coalesce(strip(col(c).cast("string")), F.lit("")).alias(c) for c in df.columns])
    cells = trimmed.unpivot([], [col(c) for c in df.columns], "column", "value")
    value = F.col("value")
    flagged = cells.select(
        "column", "value", (F.spark_partition_id() % FAN_IN).alias("fan"), (~is_missing(value)).alias("present"),
        looks_date(value).alias("is_date"), looks_numeric(value).alias("is_num"),
        looks_boolean(value).alias("is_bool"), date_layout(value).alias("layout"))
    present = F.col("present")
    sketches = flagged.groupBy("column", "fan").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(present).alias("present_count"),
        F.count_if(present & F.col("is_date")).alias("date_hits"),
        F.count_if(present & F.col("is_num")).alias("num_hits"),
        F.count_if(present & F.col("is_bool")).alias("bool_hits"),
        F.array(*[F.count_if(present & (F.col("layout") == name)) for name in DATE_LAYOUTS]).alias("layout_hits"),
        F.hll_sketch_agg(F.when(present, value), F.lit(DISTINCT_BITS)).alias("distinct"),
        F.expr(f"approx_top_k_accumulate(value, {TRACKED}) FILTER (WHERE present)").alias("top"))
    return merge_sketches(sketches)


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch row per column out of those of several tables."""
    return sketches.groupBy("column").agg(*_merged())


def sketched_profile(sketches: DataFrame, k: int = 5) -> DataFrame:
    """One row per column: counts, ratios, distinct and top values, mixed date layouts.

    ``top_values`` are the k most frequent, those of one count by value.
    """
    counted = merge_sketches(sketches).withColumn("unique_count", F.hll_sketch_estimate("distinct"))
    found = F.expr(f"""transform(approx_top_k_estimate(top, {TRACKED}),
                       t -> struct(-t.count AS rank, t.item AS value, t.count AS count))""")
    top = F.transform(F.slice(F.array_sort(found), 1, k), lambda t: F.struct(t["value"], t["count"]))
    mixed = F.size(F.filter("layout_hits", lambda n: n > 0)) > 1
    return match_rates(counted, top.alias("top_values"), mixed.alias("mixed_layouts")).withColumn(
        "mixed_layouts", (F.col("date_match_ratio") >= 0.7) & F.col("mixed_layouts"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _versions(spark: SparkSession, store: str) -> list[int]:
    """Updates that were finished, by the marks they end with."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/done")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName()) for f in files.listStatus(at)) if files.exists(at) else []


def sketched_files(spark: SparkSession, store: str) -> DataFrame:
    """(path, length, modified, batch) of the files that the store's sketches cover."""
    done = _versions(spark, store)
    if not done:
        return spark.createDataFrame([], _LOG_DDL)
    log = spark.read.schema(f"{_LOG_DDL}, version int").option("basePath", f"{store}/log").parquet(
        *[f"{store}/log/version={v}" for v in done])
    last = log.groupBy("path").agg(F.max_by(F.struct("length", "modified", "batch"), "version").alias("last"))
    return last.select("path", "last.*").where("batch IS NOT NULL")


def read_sketches(spark: SparkSession, store: str) -> DataFrame:
    """The sketch rows of a store's valid batches."""
    batches = [r["batch"] for r in sketched_files(spark, store).select("batch").distinct().collect()]  # one per update
    if not batches:
        return spark.createDataFrame([], SKETCH_DDL)
    return spark.read.schema(SKETCH_DDL).parquet(*[f"{store}/batches/{b}" for b in batches])


def update_sketches(spark: SparkSession, folder: str, store: str, read: Callable[[list[str]], DataFrame],
                    pattern: str = "*") -> int:
    """Brings a store of sketches up to a folder's files; returns how many were read.

    ``read`` turns file paths into a table. Files that came in form a new batch. A file
    that changed or went away cannot be subtracted, so what is left of its batch is
    read again. The log and its mark are written last: an update that was cut off
    leaves the store as it was, and the next one repeats it. One update at a time.
    """
    if not _exists(spark, folder):
        raise FileNotFoundError(folder)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(
        "path", "length", F.col("modificationTime").alias("modified"))
    known = sketched_files(spark, store)
    both = listed.alias("l").join(known.alias("k"), "path", "full").select(
        "path", "l.length", "l.modified", "k.batch",
        ((F.col("l.length") == F.col("k.length")) & (F.col("l.modified") == F.col("k.modified"))).alias("same"))
    stale = both.where("batch IS NOT NULL AND same IS NOT TRUE").select("batch").distinct()
    touched = both.where("batch IS NULL").unionByName(both.join(stale, "batch", "left_semi").select(both.columns))
    # The paths go to the reader, which lists them on the driver as any file scan does.
    touched = touched.select("path", "length", "modified").collect()
    if not touched:
        return 0
    batch = uuid.uuid4().hex
    paths = sorted(r["path"] for r in touched if r["length"] is not None)
    if paths:
        sketch_columns(read(paths)).write.parquet(f"{store}/batches/{batch}")
    version = max(_versions(spark, store), default=0) + 1
    rows = [(r["path"], r["length"], r["modified"], batch if r["length"] is not None else None) for r in touched]
    spark.createDataFrame(rows, _LOG_DDL).write.mode("overwrite").parquet(f"{store}/log/version={version}")
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/done/{version}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, False).close()
    return len(paths)
