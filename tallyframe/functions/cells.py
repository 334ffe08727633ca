r"""Cell-level cleaning: missing markers, dates, numbers, annotated dates.

Patterns end in ``\z`` (Java's ``$`` also matches before a last line break).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import fold_accents, let, strip

# The text markers that stand for a missing cell (blank counts too).
MISSING_MARKERS = ("na", "n/a", "null", "none", "nan", "-", "--")

# Lower-cased texts that read as a boolean.
BOOLEAN_MARKERS = ("0", "1", "true", "false", "yes", "no", "y", "n")

# A column whose name holds one of these is probably numeric.
NUMERIC_NAME_HINTS = (
    "year", "ratio", "amount", "value", "score", "price", "cost", "revenue",
    "income", "asset", "deposit", "loan", "profit", "loss", "percent",
    "percentage", "latitude", "longitude", "capacity", "stt",
)

# A column whose name holds one of these may be an identifier.
ID_NAME_HINTS = ("id", "code", "ma", "sbd", "stt")

# Fixed value: the receipt date inside a note, matched on ASCII lower-case text.
RECEIPT_PATTERN = (r"syt(?:\s+\w+){0,3}?\s*(?:nhan|tiep\s*nhan)"
                   r"\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})")

# Currency signs and words that stand around numbers.
_CURRENCY_SIGNS = "₫$€£"
_CURRENCY_WORDS = r"(?iU)\b(?:VND|USD|EUR|GBP)\b"
# Fixed value: a number with thousands groups.
_GROUPED = r"[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?"
#: A number that is written as cleaning writes it.
_PLAIN = r"^(?:0|-?[1-9]\d{0,14}|-?(?:0|[1-9]\d{0,14})\.\d{0,9}[1-9])\z"
_NUMBER = rf"^(?:[-+]?\d+(?:[.,]\d+)?|{_GROUPED})\z"

# Trailing dots are part of the accepted text.
_CLOCK = r"(?:(?:\s+|T)(?:2[0-3]|[01]?\d):[0-5]?\d(?::[0-5]?\d)?)?"
_YEAR_FIRST = rf"(?!0000)(\d{{4}})(?:-(\d{{1,2}})-(\d{{1,2}}){_CLOCK}|/(\d{{1,2}})/(\d{{1,2}}))\.*\z"
_DATE = rf"^(?:{_YEAR_FIRST}|\d{{1,2}}([/-])\d{{1,2}}\6(?:(?!0000)\d{{4}}|\d{{2}})\.*\z)"
_DAY_MONTH = r"^(\d{1,2})([/-])(\d{1,2})\2"


def missing_text(text: Column) -> Column:
    """Whether an already stripped text is blank or a marker."""
    return F.lower(text).isin("", *MISSING_MARKERS)


def is_missing(c: Column) -> Column:
    """Null, blank or one of the marker texts."""
    return missing_text(strip(F.coalesce(c, F.lit(""))))


def date_of_text(text: Column) -> Column:
    """:func:`normalize_date` of an already stripped text."""
    ymd = F.regexp_replace(text, "^" + _YEAR_FIRST, "$1-$2$4-$3$5")
    ymd = F.regexp_replace(ymd, _DAY_MONTH + r"(\d{4})\.*\z", "$4-$3-$1")
    ymd = F.regexp_replace(ymd, _DAY_MONTH + r"(69|[7-9]\d)\.*\z", "19$4-$3-$1")
    ymd = F.regexp_replace(ymd, _DAY_MONTH + r"(\d\d)\.*\z", "20$4-$3-$1")
    # Already ISO: only the calendar has to agree.
    return (F.when(text.rlike(r"^(?!0000)\d{4}-\d\d-\d\d\z"), text.try_cast("date").cast("string"))
            .when(text.rlike(_DATE), ymd.try_cast("date").cast("string")))


def normalize_date(c: Column) -> Column:
    """ISO text of a cell written in one of the ten accepted layouts, else null.

    Day comes before month; a two-digit year pivots at 69; the time of day is
    dropped. Cells that are no date leave after two anchored regexps.
    """
    return let(strip(c), date_of_text)


def _without_currency_words(c: Column) -> Column:
    return let(c, lambda text: F.when(
        text.rlike("[A-Za-z]"), F.regexp_replace(text, _CURRENCY_WORDS, "")).otherwise(text))


def _bare(text: Column) -> Column:
    """Currency signs and words, then percent signs, removed."""
    return strip(F.translate(_without_currency_words(F.translate(text, _CURRENCY_SIGNS, "")), "%", ""))


def number_of_text(text: Column, float_compat: bool = False) -> Column:
    """:func:`normalize_number` of an already stripped text."""
    def through_double(text: Column) -> Column:
        return let(text.try_cast("double"), lambda num: F.when(
            (num == F.floor(num)) & (F.abs(num) < 9.2e18), num.cast("bigint").cast("string")
        ).otherwise(num.try_cast("decimal(38,10)").cast("string")))

    def ten_decimals(text: Column) -> Column:
        return F.when(text.rlike(r"\.\d{11}"), F.coalesce(
            text.try_cast("decimal(38,10)").cast("string"), text)).otherwise(text)

    def plain(text: Column) -> Column:
        point = F.when(text.rlike(rf"^{_GROUPED}\z"), F.translate(text, ",", "")).otherwise(
            F.translate(text, ",", "."))
        digits = through_double(point) if float_compat else let(point, ten_decimals)
        digits = F.regexp_replace(digits, r"^(?:\+|(-))?0*(?=\d)", "$1")
        digits = F.regexp_replace(digits, r"(?:(\.\d*[1-9])|\.)0+\z", "$1")
        return F.when(text.rlike(_NUMBER), F.regexp_replace(digits, r"^-0\z", "0"))
    return F.when(text.rlike(_PLAIN), text).when(text.rlike(r"\d"), let(_bare(text), plain))


def number_shaped(text: Column) -> Column:
    """Whether an already stripped text is a number to :func:`number_of_text`, which is not written out."""
    return F.when(text.rlike(_PLAIN), True).when(text.rlike(r"\d"), _bare(text).rlike(_NUMBER)).otherwise(False)


def normalize_number(c: Column, float_compat: bool = False) -> Column:
    """Plain decimal text of a numeric-looking cell, else null.

    By default digits are kept exactly (no float round trip); more than ten
    decimals are rounded to ten. ``float_compat`` goes through DOUBLE, losing
    digits past 2^53 the way a float pipeline does.
    """
    return let(strip(c), lambda text: number_of_text(text, float_compat))


def looks_numeric(c: Column) -> Column:
    """Whether a profile counts the cell as a number.

    Unlike cleaning it drops percent signs before currency words.
    """
    text = F.translate(strip(c), _CURRENCY_SIGNS + "%", "")
    return strip(_without_currency_words(text)).rlike(_NUMBER)


def looks_boolean(c: Column) -> Column:
    return F.lower(c).isin(*BOOLEAN_MARKERS)


def looks_date(c: Column) -> Column:
    """Shape test only: ``2024-99-99`` has the shape of a date."""
    # Fixed value: the accepted shapes.
    return c.rlike(r"^(?:\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}(?::\d{2})?)?"
                   r"|\d{4}/\d{2}/\d{2}"
                   r"|\d{1,2}/\d{1,2}/\d{2,4}"
                   r"|\d{1,2}-\d{1,2}-\d{2,4})\z")


# The layout classes a mixed-format date column is judged by.
DATE_LAYOUTS = {
    "yyyy-mm-dd": r"^\d{4}-\d{2}-\d{2}\z",
    "d/m/y": r"^\d{1,2}/\d{1,2}/\d{2,4}\z",
    "d-m-y": r"^\d{1,2}-\d{1,2}-\d{2,4}\z",
    "iso-datetime": r"^\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}(?::\d{2})?\z",
}


def date_layout(c: Column) -> Column:
    """Which layout class a cell belongs to, null for none."""
    out = None
    for name, pattern in DATE_LAYOUTS.items():
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out


def split_annotated_date(c: Column, receipt_pattern: str = RECEIPT_PATTERN) -> Column:
    """``6/12/2024 (SYT nhận 9/1/2025)`` -> struct(date, receipt_date, note).

    The note is the trailing parenthesis. It is blanked when nothing but the
    receipt phrase stands in it.
    """
    annotation = r"\((.*)\)\s*\z"
    empty = F.lit("")

    def ascii_lower(note: Column) -> Column:
        return F.regexp_replace(F.lower(fold_accents(note, d_stroke=False)), r"[^\x00-\x7f]", "")

    def from_note(head: Column, note: Column) -> Column:
        def pieces(plain: Column) -> Column:
            receipt = F.regexp_extract(plain, receipt_pattern, 1)
            left = F.btrim(F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), receipt_pattern, ""),
                           F.lit(" -:,;"))
            return F.struct(
                F.coalesce(normalize_date(head), empty).alias("date"),
                F.coalesce(normalize_date(receipt), empty).alias("receipt_date"),
                F.when((left == "") & plain.rlike(receipt_pattern), "").otherwise(note).alias("note"))
        return let(ascii_lower(note), pieces)

    def split(text: Column) -> Column:
        alone = F.struct(F.coalesce(normalize_date(text), empty).alias("date"),
                         empty.alias("receipt_date"), empty.alias("note"))
        annotated = let(strip(F.regexp_extract(text, annotation, 1)), lambda note: from_note(
            F.regexp_replace(text, annotation, ""), note))
        return F.when(text.rlike(annotation), annotated).otherwise(alone)
    return let(strip(F.coalesce(c, empty)), split)
