"""Result cells: JSON text <-> comparable cells, tolerant equality.

A result set is ``array<array<cell>>`` with ``cell = struct<is_null, text,
is_num, num>``. The field order is the sort order used when row order does not
matter: nulls last, then the printed text, then numbers after equal text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import let

# Absolute and relative tolerance of numeric comparison.
ABS_TOLERANCE = 1e-2
REL_TOLERANCE = 1e-9

_SENTINEL = "␅end␅"


#: A number whose exponent may pass that of any double.
_HUGE = r"\d[eE]\+?0*(?:30[89]|3[1-9]\d|[4-9]\d\d|\d{4,})"


def strict_json(c: Column, single_quotes: bool = False) -> Column:
    """VARIANT of a text that is one complete JSON document, else null.

    ``parse_json`` ignores what follows the first document, so the text is put
    inside an array before a sentinel that must come out as the second item. A
    text that may hold a number beyond the range of doubles is not taken.
    """
    wrapped = F.concat(F.lit("["), c, F.lit(f',"{_SENTINEL}"]'))
    if single_quotes:
        doc = F.from_json(wrapped, "variant", {"allowSingleQuotes": "true"})
    else:
        doc = F.try_parse_json(wrapped)
    read = let(doc, lambda d: F.when(F.try_variant_get(d, "$[1]", "string") == _SENTINEL,
                                     F.try_variant_get(d, "$[0]", "variant")))
    may_be_huge = (c.contains("e") | c.contains("E")) & c.rlike(_HUGE)
    return F.when(~may_be_huge, read)


def json_list(c: Column) -> Column:
    """VARIANT of a complete JSON list, else null.

    Bare NaN and Infinity become null, but only in a text that is no valid
    JSON as it stands, so the rewrite cannot touch a string cell.
    """
    def read(text: Column) -> Column:
        no_nan = F.regexp_replace(text, r"(?<=[\[,:\s])-?(?:NaN|Infinity)(?=\s*[,\]}])", "null")
        doc = F.coalesce(strict_json(text), F.when(
            text.contains("NaN") | text.contains("Infinity"), strict_json(no_nan)))
        # A complete document that opens with a bracket is a list.
        return F.when(text.startswith("[") & text.endswith("]"), doc)
    return let(c, read)


def number_text(num: Column) -> Column:
    """A double printed without exponent where it fits, integers without point."""
    plain = F.regexp_replace(num.cast("decimal(38,15)").cast("string"), r"\.?0+\z", "")
    return F.when((F.abs(num) < 1e16) & ((F.abs(num) >= 1e-4) | (num == 0)), plain
                  ).otherwise(num.cast("string"))


def variant_cell(v: Column) -> Column:
    """One comparable cell from a VARIANT scalar (or nested value, by its JSON)."""
    none = F.lit(None).cast("double")

    def made(is_null: bool, text: Column, is_num: bool, num: Column) -> Column:
        return F.struct(F.lit(is_null).alias("is_null"), text.alias("text"),
                        F.lit(is_num).alias("is_num"), num.alias("num"))

    num = F.try_variant_get(v, "$", "double")

    def fraction(printed: Column) -> Column:
        # Only here the stored type matters: decimals keep their digits, doubles are printed anew.
        return F.when(F.schema_of_variant(v).startswith("DECIMAL"), made(False, printed, True, num)).otherwise(
            made(False, number_text(num), True, num))

    def by_print(printed: Column) -> Column:
        first = F.left(printed, F.lit(1))
        return (F.when(printed.isNull() | (printed == "null"), made(True, F.lit(""), False, none))
                .when(first == '"', made(False, F.try_variant_get(v, "$", "string"), False, none))
                .when(first.isin("[", "{"), made(False, printed, False, none))
                .when(printed.isin("true", "false"), made(False, F.initcap(printed), True, num))
                .when(printed.rlike(r"^-?\d++\z"), made(False, printed, True, num))
                .otherwise(fraction(printed)))
    return let(F.to_json(v), by_print)


def typed_cell(c: Column, dtype: str) -> Column:
    """One comparable cell from a column of a known Spark type."""
    is_null = c.isNull()
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        text, num = c.cast("string"), c.cast("double")
    elif dtype in ("float", "double"):
        text, num = number_text(c.cast("double")), c.cast("double")
    elif dtype.startswith("decimal"):
        text, num = number_text(c.cast("double")), c.cast("double")
    elif dtype == "boolean":
        text, num = F.initcap(c.cast("string")), c.cast("int").cast("double")
    elif dtype.startswith(("array", "map", "struct")):
        text, num = F.to_json(c), F.lit(None).cast("double")
    else:
        text, num = c.cast("string"), F.lit(None).cast("double")
    numeric = dtype.startswith(("tinyint", "smallint", "int", "bigint", "float",
                                "double", "decimal", "boolean")) and not dtype.startswith("interval")
    return F.struct(is_null.alias("is_null"), F.coalesce(text, F.lit("")).alias("text"),
                    (~is_null & F.lit(numeric)).alias("is_num"), num.alias("num"))


def result_rows(v: Column) -> Column:
    """``array<array<cell>>`` of a VARIANT list; a bare item is a one-cell row."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.transform(items, lambda item: F.transform(
        F.coalesce(F.try_variant_get(item, "$", "array<variant>"), F.array(item)), variant_cell))


def decode_result(result: Column) -> Column:
    """Cells of a stored result text; null for errors and non-lists."""
    return F.when(~result.startswith("ERROR:"), result_rows(json_list(F.trim(result))))


def numbers_close(a: Column, b: Column, tolerance: float = ABS_TOLERANCE) -> Column:
    """Absolute or relative closeness; NaN is close to nothing."""
    limit = F.greatest(F.lit(float(tolerance)),
                       F.lit(REL_TOLERANCE) * F.greatest(F.abs(a), F.abs(b)))
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | (F.abs(a - b) <= limit))


def cells_equal(a: Column, b: Column, tolerance: float = ABS_TOLERANCE) -> Column:
    """Null equals null, numbers within tolerance, anything else by exact text."""
    both_num = a["is_num"] & b["is_num"]
    both_text = ~a["is_num"] & ~b["is_num"]
    value = F.when(both_num, numbers_close(a["num"], b["num"], tolerance)).otherwise(
        both_text & (a["text"] == b["text"]))
    return F.when(a["is_null"] | b["is_null"], a["is_null"] & b["is_null"]).otherwise(value)


def scalars_equal(a: Column, b: Column, tolerance: float = ABS_TOLERANCE) -> Column:
    """Null-safe tolerant equality of two numeric columns."""
    x, y = a.cast("double"), b.cast("double")
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(
        numbers_close(x, y, tolerance))
