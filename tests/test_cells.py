"""Golden cells and round trips of the cell builders."""

import datetime
import random

from pyspark.sql import functions as F

from tallyframe.functions import cells, text


DATES = [
    ("2024/10/05", "2024-10-05"), ("13/1/2025.", "2025-01-13"), ("1/2/69", "1969-02-01"),
    ("1/2/68", "2068-02-01"), ("2024-10-05T08:30", "2024-10-05"), ("12/31/2024", None), ("", None),
    ("2024-10-05  8:3:59", "2024-10-05"), ("2024-2-30", None), ("31-12-99", "1999-12-31"),
    ("2024-10-05 24:00", None), ("0000-01-01", None), ("1/1/0000", None), ("\u00a05/6/2024 ", "2024-06-05"),
    ("2024/1/2 08:00", None), ("69-1-2", None), ("2024-1/2", None), ("5/6/2024\n", "2024-06-05")]


def test_date(column):
    assert list(zip([r for r, _ in DATES], column(cells.normalize_date, [r for r, _ in DATES]))) == DATES


def test_date_layouts_round_trip(column):
    """Whatever accepted layout a date is written in, it comes back."""
    rng = random.Random(5)
    days = [datetime.date(1970, 1, 1) + datetime.timedelta(days=rng.randrange(25000)) for _ in range(400)]
    layouts = ["%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%-d/%-m/%Y", "%d-%m-%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M"]
    raw = [d.strftime(rng.choice(layouts)) for d in days]
    assert column(cells.normalize_date, raw) == [d.isoformat() for d in days]


NUMBERS = [
    ("1,234.50", "1234.5"), ("12,5", "12.5"), ("1,2345", "1.2345"), ("45%", "45"), ("$1,000", "1000"),
    ("1000 VND", "1000"), ("100VND", None), ("1.234.567", None), ("1e5", None), ("0912345678", "912345678"),
    ("+5", "5"), ("986808612.0", "986808612"), ("-0.0", "0"), ("000", "0"), ("0.123456789012", "0.123456789"),
    ("-00.10", "-0.1"), ("12.", None), ("", None), ("+-5", None), ("5 %", "5"), ("1,234,567", "1234567"),
    ("12345678901234567890", "12345678901234567890"), ("a1", None), ("-7", "-7")]


def test_number(column):
    assert list(zip([r for r, _ in NUMBERS], column(cells.normalize_number, [r for r, _ in NUMBERS]))) == NUMBERS


def test_number_float_mode_loses_digits(column):
    exact, lossy = "9007199254740993", "9007199254740992"
    assert column(cells.normalize_number, [exact]) == [exact]
    assert column(lambda c: cells.normalize_number(c, float_compat=True), [exact, "12,50", "x"]) == [lossy, "12.5", None]


def test_missing(column):
    raw = ["N/A", "--", " ", None, "\u00a0", "0", "nano"]
    assert column(cells.is_missing, raw) == [True] * 5 + [False] * 2


SLUGS = [
    ("Họ và tên", "ho_va_ten"), ("Điểm", "diem"), (" FATHER_AGE ", "father_age"), ("ﬁn½x™", "fin1_2x"),
    ("漢字 a", "a"), ("a--b", "a_b")]


def test_slug_value_equals_slug_name(column):
    assert column(text.slug, [r for r, _ in SLUGS]) == [w for _, w in SLUGS] == [text.slug_name(r) for r, _ in SLUGS]


def test_unique_slugs_never_collide():
    assert text.unique_slugs(["a", "a", "b"]) == ["a", "a_2", "b"]
    out = text.unique_slugs(["a", "a", "a_2", "A "])
    assert len(set(out)) == 4


def test_fold_matches_unicode_database(column):
    """Any text of foldable characters equals the decomposition itself."""
    rng = random.Random(3)
    pool = "aZ9 éèüßøđĐñÅĳŉǅﬁ½²™①ệửữ漢ガ\u0301"
    raw = ["".join(rng.choice(pool) for _ in range(30)) for _ in range(50)]
    want = [text._decompose(r).replace("đ", "d").replace("Đ", "D") for r in raw]
    assert column(text.fold_accents, raw) == want


def test_python_repr(column):
    raw = ["a", "it's", 'say "x"', "it's \"x\"", "l\nb\\t"]
    assert column(text.python_repr, raw) == [repr(r) for r in raw]


ANNOTATED = [
    ("6/12/2024 (SYT nhận 9/1/2025)", ("2024-12-06", "2025-01-09", "")),
    ("6/12/2024 (ghi chú khác)", ("2024-12-06", "", "ghi chú khác")),
    ("13/1/2025.", ("2025-01-13", "", "")), (None, ("", "", "")), ("x", ("", "", "")),
    ("1/2/2024 (SYT đã nhận 9/1/2025; thêm)", ("2024-02-01", "2025-01-09", "SYT đã nhận 9/1/2025; thêm"))]


def test_annotated_date(column):
    got = column(cells.split_annotated_date, [r for r, _ in ANNOTATED])
    assert [tuple(r) for r in got] == [w for _, w in ANNOTATED]


def test_split_date_notes_is_idempotent(spark):
    from tallyframe.operators.clean import split_date_notes
    df = spark.createDataFrame([("6/12/2024 (SYT nhận 9/1/2025)", 1), ("1/2/2024 (khác)", 2)], "d string, k int")
    once = split_date_notes(df, "d", "received", "note")
    twice = split_date_notes(once, "d", "received", "note")
    assert once.columns == ["d", "received", "note", "k"] == twice.columns
    assert sorted(once.collect()) == sorted(twice.collect())


def test_normalize_table_counts_while_writing(spark):
    from pyspark.sql import Observation
    from tallyframe.operators.clean import normalize_table
    rows = [(i, "n/a" if i % 4 == 0 else "1/2/2024", f"{i},5") for i in range(40)]
    raw = spark.createDataFrame(rows, "pos long, `Ngày` string, `Score (%)` string")
    seen = Observation("clean")
    # No sort: sampling its input would count the rows a second time.
    out = sorted(normalize_table(raw, "pos", seen).collect())
    assert out[1].asDict() == {"pos": 1, "ngay": "2024-02-01", "score": "1.5"}
    assert seen.get == {"rows": 40, "cols": 2, "missing_normalized": 10, "dates_normalized": 30,
                        "numerics_normalized": 40, "headers_trimmed": 2}


def test_date_layout_names(column):
    raw = ["2024-01-02", "1/2/24", "1-2-2024", "2024-01-02T03:04", "2024/01/02"]
    assert column(cells.date_layout, raw) == ["yyyy-mm-dd", "d/m/y", "d-m-y", "iso-datetime", None]
    assert all(column(lambda c: F.coalesce(cells.looks_date(c), F.lit(False)), raw))
