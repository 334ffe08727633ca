"""Profiles from mergeable sketches."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.profile import profile_columns
from tallyframe.operators.sketches import (SKETCH_DDL, TOP_ERROR, merge_sketches, read_sketches, sketch_columns,
                                           sketched_files, sketched_profile, update_sketches)

EXACT = ("missing_count", "missing_ratio", "date_match_ratio", "numeric_match_ratio", "bool_match_ratio")


def by_column(df):
    return {r["column"]: r.asDict(recursive=True) for r in df.collect()}


def test_merged_parts_equal_the_exact_profile(spark):
    df = spark.range(3000, numPartitions=7).select(
        F.when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit(" v"), F.col("id") % 40)).alias("value"),
        F.when(F.col("id") % 3 == 0, "2024-01-05").otherwise("5/1/2024").alias("column"),
        F.col("id").cast("string").alias("pos"), F.lit(None).cast("string").alias("nothing"))
    parts = sketch_columns(df.where("pos < 1000")).unionByName(sketch_columns(df.where("pos >= 1000")))
    got = by_column(sketched_profile(parts))
    want = by_column(profile_columns(df.withColumn("place", F.col("pos").cast("long")), "place"))
    assert set(got) == {"value", "column", "pos", "nothing"}
    for name in got:
        exact = want[name]
        assert [got[name][c] for c in EXACT] == [exact[c] for c in EXACT]
        assert abs(got[name]["unique_count"] - exact["unique_count"]) <= 0.04 * exact["unique_count"]
    counts = sorted(((-n["count"], n["value"]) for n in profile_columns(
        df.select("value", F.col("pos").cast("long").alias("place")), "place", 40).where("column = 'value'").first()["top_values"]))
    assert [(-t["count"], t["value"]) for t in got["value"]["top_values"]] == counts[:5]
    assert got["column"]["mixed_layouts"] and not got["value"]["mixed_layouts"]
    assert got["nothing"]["missing_count"] == 3000 and got["nothing"]["top_values"] == []


def test_frequent_values_of_a_column_beyond_the_sketch(spark):
    n = 300000
    df = spark.range(n, numPartitions=5).select(F.when(F.col("id") % 20 == 0, F.concat(F.lit("hot"), F.col("id") % 3))
                                                .otherwise(F.concat(F.lit("x"), F.col("id"))).alias("c"))
    row = by_column(sketched_profile(sketch_columns(df), 3))["c"]
    assert {t["value"] for t in row["top_values"]} == {"hot0", "hot1", "hot2"}
    assert all(abs(t["count"] - n / 60) <= 2 * TOP_ERROR * n for t in row["top_values"])
    exact = df.distinct().count()
    assert abs(row["unique_count"] - exact) <= 0.04 * exact


def test_profile_of_columns_named_like_its_own(spark):
    df = spark.createDataFrame([("1", "a", "x", "b"), ("2", "a", "y", None)], "pos string, _pos string, column string, value string")
    for got in (by_column(profile_columns(df)), by_column(profile_columns(df, "pos"))):
        assert got["_pos"]["top_values"] == [{"value": "a", "count": 2}]
        assert got["value"]["missing_count"] == 1 and got["column"]["unique_count"] == 2
    assert set(by_column(profile_columns(df))) == {"pos", "_pos", "column", "value"}


def test_no_columns_and_no_rows(spark):
    assert sketch_columns(spark.range(3).drop("id")).collect() == []
    assert sketched_profile(sketch_columns(spark.createDataFrame([], "a string"))).collect() == []
    assert sketched_profile(spark.createDataFrame([], SKETCH_DDL)).collect() == []


def test_grown_folder_reads_only_what_came_in(spark, tmp_path):
    folder, store, seen = tmp_path / "in", str(tmp_path / "store"), []

    def read(paths):
        seen.append(sorted(p.rsplit("/", 1)[-1] for p in paths))
        return spark.read.option("header", True).csv(paths)

    def update():
        seen.clear()
        n = update_sketches(spark, str(folder), store, read, "*.csv")
        return n, by_column(sketched_profile(read_sketches(spark, store)))
    with pytest.raises(FileNotFoundError):
        update()
    folder.mkdir()
    assert update() == (0, {}) and seen == []
    (folder / "a b é.csv").write_text("k,v\n1,x\n2,\n")
    (folder / "b.csv").write_text("k,v\n3,x\n")
    n, first = update()
    assert n == 2 and first["v"]["row_count"] == 3 and first["v"]["top_values"] == [{"value": "x", "count": 2}]
    assert update() == (0, first) and seen == []
    (folder / "c.csv").write_text("k,v\n4,y\n4,y\n4,y\n")
    n, grown = update()
    assert (n, seen) == (1, [["c.csv"]])
    assert grown["k"]["row_count"] == 6 and grown["k"]["unique_count"] == 4
    assert [t["value"] for t in grown["v"]["top_values"]] == ["y", "x"]
    # A file that changed or went away takes its batch along, and no other.
    (folder / "b.csv").write_text("k,v\n9,zz\n")
    n, changed = update()
    assert (n, seen) == (2, [["a b é.csv", "b.csv"]]) and changed["v"]["row_count"] == 6
    assert {t["value"] for t in changed["v"]["top_values"]} == {"x", "y", "zz"}
    (folder / "c.csv").unlink()
    n, less = update()
    assert (n, seen) == (0, []) and less["v"]["row_count"] == 3
    assert sketched_files(spark, store).count() == 2


def test_update_cut_off_before_its_mark_is_repeated(spark, tmp_path):
    folder, store = tmp_path / "in", tmp_path / "store"
    folder.mkdir()
    (folder / "a.csv").write_text("k\n1\n")

    def read(paths):
        return spark.read.option("header", True).csv(paths)
    update_sketches(spark, str(folder), str(store), read)
    (store / "done" / "1").unlink()
    assert read_sketches(spark, str(store)).collect() == []
    assert update_sketches(spark, str(folder), str(store), read) == 1
    assert by_column(merge_sketches(read_sketches(spark, str(store))))["k"]["row_count"] == 1
