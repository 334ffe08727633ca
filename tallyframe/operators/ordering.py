"""Ranks and running sums over huge groups, without one task per group.

``row_number() OVER (PARTITION BY key ORDER BY pos)`` puts a whole key into one
task. Here rows are range-partitioned by (keys, position) and kept with the
number of their range; one total per key and range gives every range its offset,
and windows run per (key, range). A key that holds a third of all rows spreads
over a third of the ranges, however its positions are spaced.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import materialize


def with_row_order(df: DataFrame, name: str = "pos") -> DataFrame:
    """Add an increasing BIGINT in scan order (gaps between input splits)."""
    return df.withColumn(name, F.monotonically_increasing_id())


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """Rows range-partitioned by ``order``, with their range's number ``_part``.

    Written to the shared folder: the bounds of the ranges come from a sample, so
    rows and offsets have to be taken from one and the same partitioning.
    """
    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def range_offsets(placed: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """(_part, keys, _offset): the total of a key in all earlier ranges.

    A key lies in neighbouring ranges, so there is about one row per key and one
    per range; without keys it is one row per range.
    """
    totals = placed.groupBy("_part", *keys).agg(total.alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", *keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))


def _with_offset(placed: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside the offset of their key and range; null keys are keys too."""
    names = ["_part", *keys]
    other = offsets.select(*[F.col(f"`{c}`").alias(f"_offset_{i}") for i, c in enumerate(names)], "_offset")
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"_offset_{i}")) for i, c in enumerate(names)])
    return placed.join(other, same).drop(*[f"_offset_{i}" for i in range(len(names))])


def rank_within(df: DataFrame, keys: list[str], pos: str, name: str = "rn") -> DataFrame:
    """Exact ``row_number`` per key by unique ``pos``."""
    placed = in_ranges(df, *keys, pos)
    offsets = range_offsets(placed, keys, F.count(F.lit(1)))
    local = Window.partitionBy("_part", *keys).orderBy(pos)
    return (_with_offset(placed, offsets, keys)
            .withColumn(name, F.col("_offset") + F.row_number().over(local)).drop("_part", "_offset"))


def first_within(df: DataFrame, keys: list[str], pos: str, n: int) -> DataFrame:
    """The first ``n`` rows of every key by ``pos``, whatever ``n`` is.

    Ranges beyond the quota are dropped before anything is ranked.
    """
    placed = in_ranges(df, *keys, pos)
    offsets = range_offsets(placed, keys, F.count(F.lit(1))).where(F.col("_offset") < n)
    local = Window.partitionBy("_part", *keys).orderBy(pos)
    return (_with_offset(placed, offsets, keys).withColumn("_rn", F.col("_offset") + F.row_number().over(local))
            .where(F.col("_rn") <= n).drop("_part", "_offset", "_rn"))


def running_sum(df: DataFrame, keys: list[str], pos: str, value: Column, name: str) -> DataFrame:
    """Cumulative ``value`` per key in ``pos`` order."""
    placed = in_ranges(df.withColumn("_value", value), *keys, pos)
    offsets = range_offsets(placed, keys, F.sum("_value"))
    local = (Window.partitionBy("_part", *keys).orderBy(pos)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (_with_offset(placed, offsets, keys)
            .withColumn(name, F.col("_offset") + F.sum("_value").over(local)).drop("_part", "_offset", "_value"))
