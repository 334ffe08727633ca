"""Messy text tables derived from the clean ones, in Spark and in SQL.

The SQL texts build the same cells with the other engine's functions, so a
query and its check share the input but no cleaning code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans.registry import table


def by_key(key: Column, n: int, *cases) -> Column:
    """The i-th case for rows whose key leaves remainder i."""
    out = F.when(key % n == 0, cases[0])
    for i, case in enumerate(cases[1:], 1):
        out = out.when(key % n == i, case)
    return out


def money(c: Column) -> Column:
    """Two-decimal text."""
    return c.cast("decimal(18,2)").cast("string")


def grouped_money(c: Column) -> Column:
    return F.format_number(c.cast("decimal(18,2)"), 2)


MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)"
GROUPED = "format('{{:,.2f}}', CAST({} AS DOUBLE))"


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    iso, dmy = F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "d/M/yyyy")
    price = money(F.col("o_totalprice"))
    return o.select(
        k.alias("pos"),
        F.when(k % 50 == 49, "n/a").otherwise(
            by_key(k, 4, iso, dmy, iso, F.date_format(d, "d-M-yyyy"))).alias("order_date"),
        by_key(k, 3, F.lit(" urgent "), F.lit(""), F.lit("-")).alias("ship_note"),
        by_key(k, 5, F.concat(F.lit("$"), grouped_money(F.col("o_totalprice"))), price,
               F.concat(F.lit(" "), price, F.lit(" ")), F.lit("N/A"),
               F.concat(price, F.lit(" USD"))).alias("total_price"),
        F.when(k % 10 < 7, price).otherwise("lot" ).alias("mixed_score"),
        by_key(k, 4, F.lit("yes"), F.lit("no"), F.lit("0"), F.lit("1")).alias("is_open"),
        F.concat(F.lit("A-"), k.cast("string")).alias("order_code"),
        F.col("o_orderpriority").alias("priority"))


MESSY_ORDERS = f"""
messy_orders AS (
  SELECT o_orderkey AS pos,
    CASE WHEN o_orderkey % 50 = 49 THEN 'n/a' WHEN o_orderkey % 4 IN (0, 2)
         THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%-d/%-m/%Y')
         ELSE strftime(o_orderdate, '%-d-%-m-%Y') END AS order_date,
    CASE o_orderkey % 3 WHEN 0 THEN ' urgent ' WHEN 1 THEN '' ELSE '-' END AS ship_note,
    CASE o_orderkey % 5 WHEN 0 THEN '$' || {GROUPED.format('o_totalprice')}
         WHEN 1 THEN {MONEY.format('o_totalprice')}
         WHEN 2 THEN ' ' || {MONEY.format('o_totalprice')} || ' '
         WHEN 3 THEN 'N/A' ELSE {MONEY.format('o_totalprice')} || ' USD' END AS total_price,
    CASE WHEN o_orderkey % 10 < 7 THEN {MONEY.format('o_totalprice')} ELSE 'lot' END AS mixed_score,
    CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN '0' ELSE '1' END AS is_open,
    'A-' || CAST(o_orderkey AS VARCHAR) AS order_code,
    o_orderpriority AS priority
  FROM orders)"""

MESSY_COLUMNS = ("order_date", "ship_note", "total_price", "mixed_score", "is_open", "order_code",
                 "priority")

MELTED = MESSY_ORDERS + """,
cells AS (
  SELECT pos, "column", trim(value) AS value FROM (
    UNPIVOT messy_orders ON order_date, ship_note, total_price, mixed_score, is_open, order_code,
                            priority INTO NAME "column" VALUE value)),
flagged AS (
  SELECT *, lower(value) NOT IN ('', 'na', 'n/a', 'null', 'none', 'nan', '-', '--') AS present,
    (regexp_full_match(value, '\\d{4}-\\d{2}-\\d{2}') OR regexp_full_match(value, '\\d{1,2}[/]\\d{1,2}[/]\\d{2,4}')
     OR regexp_full_match(value, '\\d{1,2}-\\d{1,2}-\\d{2,4}')) AS is_date,
    TRY_CAST(replace(replace(replace(value, '$', ''), ',', ''), ' USD', '') AS DOUBLE) IS NOT NULL
      AND lower(value) NOT IN ('nan') AS is_num,
    lower(value) IN ('0', '1', 'true', 'false', 'yes', 'no', 'y', 'n') AS is_bool
  FROM cells),
stats AS (
  SELECT "column", count(*) AS row_count, count(*) FILTER (NOT present) AS missing_count,
    round(count(*) FILTER (NOT present) / count(*), 6) AS missing_ratio,
    count(DISTINCT CASE WHEN present THEN value END) AS unique_count,
    round(count(DISTINCT CASE WHEN present THEN value END) / greatest(1, count(*) FILTER (present)), 6) AS unique_ratio,
    round(count(*) FILTER (present AND is_date) / greatest(1, count(*) FILTER (present)), 6) AS date_match_ratio,
    round(count(*) FILTER (present AND is_num) / greatest(1, count(*) FILTER (present)), 6) AS numeric_match_ratio,
    round(count(*) FILTER (present AND is_bool) / greatest(1, count(*) FILTER (present)), 6) AS bool_match_ratio
  FROM flagged GROUP BY "column")"""
