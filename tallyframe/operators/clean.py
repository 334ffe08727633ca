"""Whole-table cleaning: headers, missing markers, dates, numbers, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyframe.functions.cells import (NUMERIC_NAME_HINTS, RECEIPT_PATTERN, date_of_text,
                                        missing_text, normalize_date, number_of_text,
                                        number_shaped, split_annotated_date)
from tallyframe.functions.text import col, let, strip, unique_slugs


def slug_headers(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename every column to its unique slug (``keep`` stays as it is)."""
    names = [c for c in df.columns if c not in keep]
    renamed = dict(zip(names, unique_slugs(names)))
    return df.toDF(*[renamed.get(c, c) for c in df.columns])


def numeric_evidence(df: DataFrame, order_col: str, columns: list[str] | None = None) -> DataFrame:
    """(column, non_missing, numeric_like, is_numeric) over all rows.

    One aggregate of which each task sends one row; nothing is sorted.
    """
    columns = columns or [c for c in df.columns if c != order_col]

    def judged(c: str) -> Column:
        """0 missing, 1 text, 2 number: one look at each cell, by shape only."""
        return let(strip(F.coalesce(col(c), F.lit(""))), lambda t: F.when(missing_text(t), 0).when(number_shaped(t), 2).otherwise(1))
    looked = df.select(*[judged(c).alias(f"c{i}") for i, c in enumerate(columns)])
    counts = looked.agg(*[
        F.struct(F.count_if(F.col(f"c{i}") > 0).alias("non_missing"), F.count_if(F.col(f"c{i}") == 2).alias("numeric_like")).alias(f"c{i}")
        for i in range(len(columns))])
    listed = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}.non_missing").alias("non_missing"),
                 F.col(f"c{i}.numeric_like").alias("numeric_like"))
        for i, c in enumerate(columns)])).alias("s")).select("s.*")
    ratio = F.coalesce(F.try_divide("numeric_like", "non_missing"), F.lit(0.0))
    hinted = F.lower("column").rlike("|".join(NUMERIC_NAME_HINTS))
    return listed.withColumn(
        "is_numeric", (hinted & (ratio >= 0.6)) | ((ratio >= 0.95) & (F.col("non_missing") >= 20)))


def pick_numeric_columns(df: DataFrame, order_col: str, columns: list[str] | None = None) -> list[str]:
    """Names of the numeric columns; one row per column reaches the driver."""
    found = numeric_evidence(df, order_col, columns).where("is_numeric")
    return [r["column"] for r in found.select("column").collect()]


def clean_cell(c: Column, numeric: bool = False, float_compat: bool = False) -> Column:
    """struct(value, change): the cleaned text and what was done to the cell.

    Order matters: missing, then a date that changes the text, then (numeric
    columns only) the number, else the stripped text.
    """
    def made(value: Column, change: str) -> Column:
        return F.struct(value.alias("value"), F.lit(change).alias("change"))

    def kept(text: Column) -> Column:
        if not numeric:
            return made(text, "none")
        return let(F.coalesce(number_of_text(text, float_compat), text), lambda n: F.when(
            n == text, made(text, "none")).otherwise(made(n, "number")))

    def dated(text: Column) -> Column:
        return let(date_of_text(text), lambda d: F.when(
            d != text, made(d, "date")).otherwise(kept(text)))
    return let(strip(F.coalesce(c, F.lit(""))), lambda text: F.when(
        text == "", made(F.lit(""), "blank")).when(
        missing_text(text), made(F.lit(""), "missing")).otherwise(dated(text)))


def clean_cells(df: DataFrame, columns: list[str], numeric: list[str] = (),
                float_compat: bool = False) -> DataFrame:
    """Replace each of ``columns`` by its :func:`clean_cell` struct."""
    return df.withColumns({c: clean_cell(col(c), c in numeric, float_compat) for c in columns})


def change_counters(cleaned: DataFrame, columns: list[str]) -> list[Column]:
    """Aggregates over the structs of :func:`clean_cells`."""
    def count(kind: str) -> Column:
        hits = [(col(c)["change"] == kind).cast("bigint") for c in columns]
        return F.coalesce(F.sum(sum(hits[1:], hits[0])), F.lit(0))
    return [F.count(F.lit(1)).alias("rows"), F.lit(len(columns)).cast("bigint").alias("cols"),
            count("missing").alias("missing_normalized"),
            count("date").alias("dates_normalized"),
            count("number").alias("numerics_normalized")]


def clean_counters(df: DataFrame, columns: list[str], numeric: list[str] = ()) -> DataFrame:
    """One row of cleaning counters for a table."""
    return clean_cells(df.select(*map(col, columns)), columns, list(numeric)).agg(
        *change_counters(df, columns))


def normalize_table(df: DataFrame, order_col: str, observation: Observation | None = None,
                    float_compat: bool = False) -> DataFrame:
    """Clean a raw text table: slugged headers, cleaned cells, no shuffle.

    Only the count of numeric cells runs ahead of time. ``observation`` collects the
    cleaning counters while the result is being written, without a second scan.
    """
    before = [c for c in df.columns if c != order_col]
    df = slug_headers(df, keep=(order_col,))
    columns = [c for c in df.columns if c != order_col]
    numeric = pick_numeric_columns(df, order_col, columns)
    cleaned = clean_cells(df, columns, numeric, float_compat)
    if observation is not None:
        renamed = sum(a != b for a, b in zip(before, columns))
        cleaned = cleaned.observe(observation, *change_counters(cleaned, columns),
                                  F.max(F.lit(renamed)).alias("headers_trimmed"))
    return cleaned.withColumns({c: col(c)["value"] for c in columns})


def split_date_notes(df: DataFrame, source: str, receipt: str, note: str,
                     receipt_pattern: str = RECEIPT_PATTERN) -> DataFrame:
    """Split an annotated date column into date, receipt date and note.

    The two new columns follow the source column. A row that already has a
    receipt date or note keeps it when the text yields none, so running the
    step twice changes nothing.
    """
    empty = F.lit("")
    old_receipt = strip(F.coalesce(col(receipt), empty)) if receipt in df.columns else empty
    old_note = strip(F.coalesce(col(note), empty)) if note in df.columns else empty
    # Staged in projections: each stage is named several times in the next one.
    staged = df.withColumns({"_parts": split_annotated_date(col(source), receipt_pattern),
                             "_receipt": old_receipt, "_note": old_note})
    from_note = split_annotated_date(
        F.concat(F.lit("2000-01-01 ("), F.col("_note"), F.lit(")")), receipt_pattern)["receipt_date"]
    new_receipt = (F.when(F.col("_parts.receipt_date") != "", F.col("_parts.receipt_date"))
                   .when(F.col("_receipt") != "", F.coalesce(normalize_date(F.col("_receipt")), "_receipt"))
                   .when(F.col("_note") != "", from_note).otherwise(empty))
    new_note = F.when(F.col("_parts.note") != "", F.col("_parts.note")).otherwise(F.col("_note"))
    order = []
    for name in df.columns:
        if name == source:
            order += [source] + [x for x in (receipt, note) if x not in df.columns]
        else:
            order.append(name)
    return staged.withColumns({source: F.col("_parts.date"), receipt: new_receipt,
                               note: new_note}).select(*map(col, order))
