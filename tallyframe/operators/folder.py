"""Cleaning of a folder of CSV files, with a report row per file."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.clean import normalize_table
from tallyframe.sources import datasets

FILES_AT_ONCE = 4
REPORT_DDL = ("db_id string, filename string, encoding string, delimiter string, rows long, cols long, headers_changed long, "
              "missing_normalized long, dates_normalized long, numerics_normalized long, output string")


def normalize_folder(spark: SparkSession, source: str, target: str, pattern: str = "*.csv", float_compat: bool = False) -> DataFrame:
    """Writes every file of ``source`` cleaned to ``target``/db_id; returns the report, a row per file.

    A file is a table with columns of its own, so each is one read and one write of its
    own, ``FILES_AT_ONCE`` at a time; its rows are counted while they are written. Only
    the catalog and the report rows pass the driver. No file, or two of one db_id, is
    an error before anything is written.
    """
    datasets.list_datasets(spark, source, pattern, required=True)
    catalog = datasets.dataset_catalog(spark, source, pattern)
    files = catalog.orderBy("db_id").collect()
    names = [f["db_id"] for f in files]
    if len(set(names)) < len(names):
        raise ValueError("two files would be written to one folder")

    def run(f) -> tuple:
        rows = datasets.read_dataset(spark, f["path"], f["columns"] and list(_distinct(f["columns"])), delimiter=f["delimiter"],
                                     row_order="_pos")
        counters = Observation()
        cleaned = normalize_table(rows, "_pos", counters, float_compat)
        output = f"{target}/{f['db_id']}"
        datasets.write_normalized(cleaned, output, "_pos")
        seen = counters.get
        changed = sum(a != b for a, b in zip(f["columns"], [c for c in cleaned.columns if c != "_pos"]))
        return (f["db_id"], f["filename"], f["encoding"], f["delimiter"], seen["rows"], len(f["columns"]), changed,
                *(seen[c] for c in ("missing_normalized", "dates_normalized", "numerics_normalized")), output)
    with ThreadPoolExecutor(FILES_AT_ONCE) as pool:
        return spark.createDataFrame(list(pool.map(run, files)), REPORT_DDL)


def _distinct(names: list[str]):
    """Header names, later ones of the same text told apart so that no column is lost."""
    seen: dict[str, int] = {}
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        yield name if seen[name] == 1 else f"{name}​{seen[name]}"
