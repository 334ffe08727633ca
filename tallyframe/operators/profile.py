"""Column profiles: one melt, one (column, value) aggregation, tiny tails.

Values are counted before anything else, so a value or column that fills the
table is reduced map-side; every later step works per distinct value or per
column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.cells import (DATE_LAYOUTS, ID_NAME_HINTS, date_layout, is_missing,
                                        looks_boolean, looks_date, looks_numeric)
from tallyframe.functions.text import col, strip
from tallyframe.operators.ordering import with_row_order
from tallyframe.session import materialize


def _unused(df: DataFrame, name: str) -> str:
    """The name, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _ordered(df: DataFrame, order_col: str | None) -> tuple[DataFrame, str]:
    """The table with its order column, numbered by row where none is named."""
    if order_col is not None:
        return df, order_col
    name = _unused(df, "_pos")
    return with_row_order(df, name), name


def melt(df: DataFrame, order_col: str) -> DataFrame:
    """(pos, column, value): one trimmed, never-null cell per row and column."""
    names = [c for c in df.columns if c != order_col]
    place = _unused(df, "pos")
    cells = df.select(col(order_col).cast("bigint").alias(place), *[
        F.coalesce(strip(col(c).cast("string")), F.lit("")).alias(c) for c in names])
    return cells.unpivot(place, [col(c) for c in names], "column", "value").withColumnRenamed(place, "pos")


def value_counts(cells: DataFrame) -> DataFrame:
    """(column, value, n, first_pos) per distinct value."""
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"),
                                                F.min("pos").alias("first_pos"))


def _share(hits: Column, total: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(hits.cast("double"), total), F.lit(0.0)), 6)


def column_stats(values: DataFrame) -> DataFrame:
    """Counts and match ratios per column, weighted by value counts."""
    value = F.col("value")
    flagged = values.select(
        "column", "n", "first_pos", (~is_missing(value)).alias("present"),
        looks_date(value).alias("is_date"), looks_numeric(value).alias("is_num"),
        looks_boolean(value).alias("is_bool"), date_layout(value).alias("layout"))

    def rows(flag: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("present") & flag, F.col("n"))), F.lit(0))
    layouts = [F.min(F.when(F.col("present") & (F.col("layout") == name), F.col("first_pos")))
               for name in DATE_LAYOUTS]
    counted = flagged.groupBy("column").agg(
        F.sum("n").alias("row_count"), rows(F.lit(True)).alias("present_count"),
        F.count_if("present").alias("unique_count"), rows(F.col("is_date")).alias("date_hits"),
        rows(F.col("is_num")).alias("num_hits"), rows(F.col("is_bool")).alias("bool_hits"),
        F.array(*layouts).alias("layout_first"))
    present = F.col("present_count")
    missing = F.col("row_count") - present
    return counted.select(
        "column", "row_count", missing.alias("missing_count"),
        _share(missing, F.col("row_count")).alias("missing_ratio"), "unique_count",
        _share(F.col("unique_count"), present).alias("unique_ratio"),
        _share(F.col("date_hits"), present).alias("date_match_ratio"),
        _share(F.col("num_hits"), present).alias("numeric_match_ratio"),
        _share(F.col("bool_hits"), present).alias("bool_match_ratio"), "layout_first")


def ranked_values(values: DataFrame, k: int, by_count: bool) -> DataFrame:
    """The k most frequent (ties by first seen) or first-seen values per column.

    The rank filter is pushed below the shuffle (each task sends k rows per
    column), so a column of all-distinct values does not pile up in one task.
    """
    order = [F.desc("n"), "first_pos"] if by_count else ["first_pos", F.desc("n")]
    # Tied to the count so that it stays above the aggregation: statistics, top
    # values and samples then share one shuffled (column, value) table.
    shown = F.when(is_missing(F.col("value")), F.lit(0)).otherwise(F.col("n"))
    present = values.where(shown > 0)
    return present.withColumn("rank", F.row_number().over(
        Window.partitionBy("column").orderBy(*order))).where(F.col("rank") <= k)


def _listed(ranked: DataFrame, item: Column, name: str) -> DataFrame:
    """At most k items per column as one list in rank order."""
    return ranked.groupBy("column").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))),
        lambda s: s["item"]).alias(name))


def mixed_layout_columns(stats: DataFrame) -> DataFrame:
    """(column) of date columns whose present cells hold more than one layout."""
    seen = F.size(F.filter("layout_first", lambda p: p.isNotNull()))
    return stats.where((F.col("date_match_ratio") >= 0.7) & (seen > 1)).select("column")


def profile_columns(df: DataFrame, order_col: str | None = None, k: int = 5,
                    exact: bool = True) -> DataFrame:
    """One row per column: missing, distinct, ratios, top values, samples.

    ``exact=False`` leaves out top values and samples of columns and counts
    distinct values approximately: one scan, no (column, value) shuffle.
    """
    df, order_col = _ordered(df, order_col)
    cells = melt(df, order_col)
    if not exact:
        return _approximate_stats(cells)
    values = materialize(value_counts(cells), "values")  # counted once, read three times
    stats = column_stats(values)
    top = _listed(ranked_values(values, k, True),
                  F.struct("value", F.col("n").alias("count")), "top_values")
    sample = _listed(ranked_values(values, k, False), F.col("value"), "sample_values")
    return stats.join(top, "column", "left").join(sample, "column", "left")


def _approximate_stats(cells: DataFrame) -> DataFrame:
    value = F.col("value")
    present = ~is_missing(value)
    counted = cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(present).alias("present_count"),
        F.approx_count_distinct(F.when(present, value), 0.02).alias("unique_count"),
        F.count_if(present & looks_date(value)).alias("date_hits"),
        F.count_if(present & looks_numeric(value)).alias("num_hits"),
        F.count_if(present & looks_boolean(value)).alias("bool_hits"))
    return match_rates(counted)


def match_rates(counted: DataFrame, *more: Column) -> DataFrame:
    """Shares out of per-column counts whose distinct count may be an estimate."""
    shown = F.col("present_count")
    missing = F.col("row_count") - shown
    return counted.select(
        "column", "row_count", missing.alias("missing_count"),
        _share(missing, F.col("row_count")).alias("missing_ratio"), "unique_count",
        F.least(_share(F.col("unique_count"), shown), F.lit(1.0)).alias("unique_ratio"),
        _share(F.col("date_hits"), shown).alias("date_match_ratio"),
        _share(F.col("num_hits"), shown).alias("numeric_match_ratio"),
        _share(F.col("bool_hits"), shown).alias("bool_match_ratio"), *more)


SEMANTIC_GROUPS = ("date_columns", "numeric_columns", "boolean_like_columns", "id_like_columns",
                   "high_missing_columns", "numeric_as_text_columns")


def semantic_flags() -> list[Column]:
    """Boolean group memberships of a column (it may be in several)."""
    num, low = F.col("numeric_match_ratio"), F.lower("column")
    # The thresholds of the groups.
    tests = (F.col("date_match_ratio") >= 0.7,
             (num >= 0.85) & (F.col("unique_count") >= 5),
             F.col("bool_match_ratio") >= 0.95,
             (F.col("unique_ratio") > 0.95) & low.rlike("|".join(ID_NAME_HINTS)),
             F.col("missing_ratio") > 0.3,
             (num >= 0.6) & (num < 0.85))
    return [test.alias(name) for name, test in zip(SEMANTIC_GROUPS, tests)]


def _group_lists() -> list[Column]:
    return [F.sort_array(F.collect_list(F.when(F.col(g), F.col("column")))).alias(g)
            for g in SEMANTIC_GROUPS]


def semantic_groups(stats: DataFrame) -> DataFrame:
    """One row of sorted column-name lists per semantic group."""
    return stats.select("column", *semantic_flags()).agg(*_group_lists())


def profile_document(df: DataFrame, db_id: str, order_col: str | None = None,
                     encoding: str = "utf-8", delimiter: str = ",", file_path: str = "") -> DataFrame:
    """The nested one-row profile of a dataset.

    The per-column statistics are computed once and kept as a small table, from
    which the groups, the mixed-layout candidates and the document are built.
    """
    df, order_col = _ordered(df, order_col)
    names = [c for c in df.columns if c != order_col]
    stats = materialize(profile_columns(df, order_col), "profile")
    mixed = mixed_layout_columns(stats).agg(
        F.sort_array(F.collect_list("column")).alias("mixed_date_format_columns"))
    entry = F.struct("column", F.struct(
        "missing_count", "missing_ratio", "unique_count", "unique_ratio",
        F.coalesce("top_values", F.expr("array()")).alias("top_values"),
        F.coalesce("sample_values", F.expr("array()")).alias("sample_values"),
        "date_match_ratio", "numeric_match_ratio", "bool_match_ratio"))
    nested = stats.select("*", *semantic_flags()).agg(
        F.max("row_count").alias("row_count"), *_group_lists(),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("column_stats"))
    # Two one-row tables.
    return nested.crossJoin(mixed).select(
        F.lit(db_id).alias("db_id"), F.lit(file_path).alias("file_path"),
        F.lit(encoding).alias("encoding"), F.lit(delimiter).alias("delimiter"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.lit(len(names)).cast("bigint").alias("column_count"),
        F.array(*[F.lit(n) for n in names]).cast("array<string>").alias("columns"),
        F.struct(*SEMANTIC_GROUPS).alias("inferred_types"),
        F.struct("mixed_date_format_columns",
                 F.lit(encoding == "utf-8-sig").alias("has_bom"),
                 F.lit(delimiter != ",").alias("non_comma_delimiter")).alias("quality_flags"),
        "column_stats")
