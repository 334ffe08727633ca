"""Result-set comparison inside one row: ``array<array<cell>>`` against the same.

Gold and predicted rows meet in one record, so comparing is a projection: no
shuffle, no window, and a large answer costs only its own row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import let
from tallyframe.functions.values import ABS_TOLERANCE, cells_equal


def is_order_sensitive(sql: Column) -> Column:
    """The SQL text names ORDER BY anywhere (subqueries and comments count)."""
    return F.coalesce(sql.rlike(r"(?iU)\bORDER\s+BY\b"), F.lit(False))


def _width(rows: Column) -> Column:
    return F.size(F.try_element_at(rows, F.lit(1)))


def is_ragged(rows: Column) -> Column:
    """Some row is shorter than the first."""
    return F.exists(rows, lambda r: F.size(r) < _width(rows))


def column_vectors(rows: Column) -> Column:
    """Transpose: one array of cells per column of the first row."""
    return F.transform(F.sequence(F.lit(1), _width(rows)), lambda i: F.transform(
        rows, lambda r: F.try_element_at(r, i)))


def canonical(vector: Column, order: str = "text") -> Column:
    """Sort one column vector: nulls last, by printed text or by number."""
    if order == "text":
        return F.array_sort(vector)
    keyed = F.transform(vector, lambda x: F.struct(
        x["is_null"].alias("n"), ~x["is_num"], x["num"].alias("v"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def vectors_match(gold: Column, pred: Column, tolerance: float = ABS_TOLERANCE) -> Column:
    """Equal length and pairwise equal cells."""
    return (F.size(gold) == F.size(pred)) & F.forall(
        F.zip_with(gold, pred, lambda a, b: cells_equal(a, b, tolerance)), lambda ok: ok)


def compare_rows(pred: Column, gold: Column, ordered: Column, *, strict_columns: bool = False,
                 row_aligned: bool = False, order: str = "text",
                 tolerance: float = ABS_TOLERANCE) -> Column:
    """Whether a predicted result set answers the gold one.

    Two empty sets match. Otherwise every gold column must match some predicted
    column, cell by cell in row order (``ordered``) or in canonical order; extra
    predicted columns are accepted. Columns are matched one by one, so row
    pairing is not checked unless ``row_aligned``. ``strict_columns`` also asks
    for the same column count and positions. ``order='numeric'`` sorts numbers
    by value. Ragged rows are a mismatch.
    """
    def matched(p: Column, g: Column) -> Column:
        if row_aligned:
            return _rows_match(p, g, ordered, tolerance)

        def vectors(rows: Column) -> Column:
            cols = column_vectors(rows)
            return F.when(ordered, cols).otherwise(F.transform(cols, lambda v: canonical(v, order)))
        if strict_columns:
            return (_width(p) == _width(g)) & F.forall(
                F.zip_with(vectors(g), vectors(p), lambda x, y: vectors_match(x, y, tolerance)),
                lambda ok: ok)
        return let(vectors(p), lambda pred_cols: F.forall(vectors(g), lambda x: F.exists(
            pred_cols, lambda y: vectors_match(x, y, tolerance))))

    def compare(p: Column, g: Column) -> Column:
        empty_gold, empty_pred = F.size(g) == 0, F.size(p) == 0
        return (F.when(empty_gold | empty_pred, empty_gold & empty_pred)
                .when(F.size(g) != F.size(p), False)
                .when(is_ragged(g) | is_ragged(p), False)
                .when(_width(g) == 0, True)
                .when(_width(p) == 0, False)
                .otherwise(matched(p, g)))
    return F.when(pred.isNotNull() & gold.isNotNull(), _both(pred, gold, compare))


def _both(pred: Column, gold: Column, body) -> Column:
    """``body(pred, gold)`` with each side computed once."""
    return let(F.struct(pred.alias("p"), gold.alias("g")), lambda s: body(s["p"], s["g"]))


def _rows_match(pred: Column, gold: Column, ordered: Column, tolerance: float) -> Column:
    """Same rows, paired whole: in order, or after sorting the rows."""
    def arranged(rows: Column) -> Column:
        return F.when(ordered, rows).otherwise(F.array_sort(rows))
    return F.forall(F.zip_with(arranged(gold), arranged(pred),
                               lambda g, p: vectors_match(g, p, tolerance)), lambda ok: ok)


def column_order_mismatch(pred: Column, gold: Column, tolerance: float = ABS_TOLERANCE) -> Column:
    """Same rows once each row's cells are sorted, but not as they stand."""
    def sorted_cells(rows: Column) -> Column:
        return F.transform(rows, lambda r: F.array_sort(r))
    unordered = F.lit(False)

    def swapped(p: Column, g: Column) -> Column:
        return ((F.size(p) == F.size(g)) & (F.size(g) > 0) & ~_rows_match(p, g, unordered, tolerance)
                & _rows_match(sorted_cells(p), sorted_cells(g), unordered, tolerance))
    return _both(pred, gold, swapped)


def preview(rows: Column, n: int = 3) -> Column:
    """The first rows as text cells, for a mismatch report."""
    return F.transform(F.slice(rows, F.lit(1), F.lit(n)), lambda r: F.transform(
        r, lambda c: F.when(c["is_null"], F.lit(None)).otherwise(c["text"])))
