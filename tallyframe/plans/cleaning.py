"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.cells import is_missing, normalize_date, normalize_number
from tallyframe.functions.text import fold_accents, slug
from tallyframe.operators.clean import (clean_cells, clean_counters, normalize_table,
                                        numeric_evidence, split_date_notes)
from tallyframe.plans.messy import (MESSY_COLUMNS, MESSY_ORDERS, MONEY, by_key,
                                    grouped_money, messy_orders, money)
from tallyframe.plans.registry import query, table


@query("normalize_dates", oracle="""
SELECT o_orderkey,
  CASE o_orderkey % 8
    WHEN 6 THEN CASE WHEN day(o_orderdate) <= 12
                     THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') END
    WHEN 7 THEN NULL
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso
FROM orders""")
def normalize_dates(spark, sf_dir):
    """Eight layouts by key: five accepted, one with a trailing dot, month-first, no date."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = by_key(k, 8, F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy/MM/dd"),
                 F.date_format(d, "d/M/yyyy"), F.date_format(d, "dd-MM-yyyy"),
                 F.date_format(d, "yyyy-MM-dd HH:mm:ss"),
                 F.concat(F.lit(" "), F.date_format(d, "d/M/yyyy"), F.lit(".\u00a0")),
                 F.date_format(d, "M/d/yyyy"),
                 F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd")))
    return (table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
            .select("o_orderkey", normalize_date(F.col("raw")).alias("iso")))


@query("normalize_dates_two_digit", oracle="""
SELECT o_orderkey, strftime(try_strptime(
    strftime(o_orderdate, '%-d/%-m/') || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0'), '%d/%m/%y'), '%Y-%m-%d') AS iso
FROM orders""")
def normalize_dates_two_digit(spark, sf_dir):
    """Two-digit years over the whole century, pivoting at 69."""
    yy = F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")
    raw = F.concat(F.date_format("o_orderdate", "d/M/"), yy)
    return (table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
            .select("o_orderkey", normalize_date(F.col("raw")).alias("iso")))


@query("normalize_numbers", oracle=f"""
WITH raw AS (SELECT *, (l_orderkey + l_linenumber) % 9 AS k,
                    {MONEY.format('l_extendedprice')} AS price,
                    CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN k IN (0, 1, 4, 5, 8) THEN regexp_replace(price, '\\.?0+$', '')
       WHEN k IN (2, 6) THEN qty END AS number
FROM raw""")
def normalize_numbers(spark, sf_dir):
    """Nine spellings by key: grouped, comma decimal, percent, missing, currency, sign, zeros."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    price, qty = money(F.col("l_extendedprice")), F.col("l_quantity").cast("bigint").cast("string")
    raw = by_key(k, 9, F.concat(F.lit("$"), grouped_money(F.col("l_extendedprice"))),
                 F.replace(price, F.lit("."), F.lit(",")), F.concat(qty, F.lit("%")), F.lit("n/a"),
                 F.concat(price, F.lit(" usd")), F.concat(F.lit("+"), price),
                 F.concat(F.lit("00"), qty), F.concat(qty, F.lit("VND")),
                 F.concat(F.lit("\u20ab "), price))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return (table(spark, sf_dir, "lineitem").select(*keys, raw.alias("raw"))
            .select(*keys, normalize_number(F.col("raw")).alias("number")))


@query("missing_markers", oracle="""
SELECT c_custkey, c_custkey % 10 < 8 AS missing FROM customer""")
def missing_markers(spark, sf_dir):
    """Every marker spelling, blanks of two kinds, and two ordinary values."""
    raw = by_key(F.col("c_custkey"), 10, F.lit("N/A"), F.lit("null"), F.lit(" None "), F.lit("NaN"),
                 F.lit("-"), F.lit("--"), F.lit("\u00a0"), F.lit(None).cast("string"),
                 F.lit("0"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", is_missing(raw).alias("missing"))


@query("pick_numeric_columns", oracle=f"""
WITH {MESSY_ORDERS},
late AS (SELECT *, CASE WHEN pos > (SELECT max(o_orderkey) // 2 FROM orders) THEN '$' || (pos % 900) ELSE 'n/a' END AS late_fee
         FROM messy_orders),
cells AS (SELECT "column", trim(value) AS value FROM (
  UNPIVOT late ON late_fee, {', '.join(MESSY_COLUMNS)} INTO NAME "column" VALUE value)),
counted AS (
  SELECT "column", count(*) FILTER (lower(value) NOT IN ('', 'n/a', '-')) AS non_missing,
    count(*) FILTER (TRY_CAST(replace(replace(replace(value, '$', ''), ',', ''), ' USD', '') AS DOUBLE)
                     IS NOT NULL) AS numeric_like
  FROM cells GROUP BY "column")
SELECT "column", non_missing, numeric_like,
  (("column" IN ('total_price', 'mixed_score', 'late_fee') AND numeric_like / non_missing >= 0.6)
   OR (numeric_like / non_missing >= 0.95 AND non_missing >= 20)) AS is_numeric
FROM counted""")
def pick_numeric_columns(spark, sf_dir):
    """All rows decide: the fee column is missing in the first half of the table."""
    rows = messy_orders(spark, sf_dir)
    half = table(spark, sf_dir, "orders").agg(F.expr("max(o_orderkey) div 2").alias("half"))  # one row
    late = F.when(F.col("pos") > F.col("half"), F.concat(F.lit("$"), (F.col("pos") % 900).cast("string"))).otherwise("n/a")
    return numeric_evidence(rows.join(F.broadcast(half)).withColumn("late_fee", late).drop("half"), "pos")


CLEANED = f"""
WITH {MESSY_ORDERS}, src AS (SELECT * FROM messy_orders JOIN orders ON pos = o_orderkey)
SELECT pos,
  CASE WHEN pos % 50 = 49 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
  CASE WHEN pos % 3 = 0 THEN 'urgent' ELSE '' END AS ship_note,
  CASE WHEN pos % 5 = 3 THEN '' ELSE regexp_replace({MONEY.format('o_totalprice')}, '\\.?0+$', '') END AS total_price,
  CASE WHEN pos % 10 < 7 THEN regexp_replace({MONEY.format('o_totalprice')}, '\\.?0+$', '') ELSE 'lot' END AS mixed_score,
  is_open, order_code, priority
FROM src"""


@query("normalize_table", oracle=CLEANED)
def normalize_whole_table(spark, sf_dir):
    """Headers to slugs, then every cell: missing, date, number, strip."""
    raw = messy_orders(spark, sf_dir).toDF(
        "pos", " Order Date ", "Ship-Note", "TOTAL  PRICE", "Mix\u00e9d score", "Is open?",
        "\ufeffOrder code", "Pri\u00f3rity")
    return normalize_table(raw, "pos")


@query("clean_counters", oracle=f"""
WITH {MESSY_ORDERS}
SELECT count(*) AS rows, 7 :: BIGINT AS cols,
  (count(*) FILTER (pos % 50 = 49) + count(*) FILTER (pos % 3 = 2)
   + count(*) FILTER (pos % 5 = 3)) :: BIGINT AS missing_normalized,
  count(*) FILTER (pos % 50 <> 49 AND pos % 4 IN (1, 3)) AS dates_normalized,
  (count(*) FILTER (pos % 5 IN (0, 4) OR (pos % 5 IN (1, 2) AND trim(total_price) LIKE '%0'))
   + count(*) FILTER (pos % 10 < 7 AND mixed_score LIKE '%0')) :: BIGINT AS numerics_normalized
FROM messy_orders""")
def cleaning_counters(spark, sf_dir):
    return clean_counters(messy_orders(spark, sf_dir), list(MESSY_COLUMNS),
                          ["total_price", "mixed_score"])


@query("clean_changes_by_column", oracle=f"""
WITH {MESSY_ORDERS}
SELECT 'order_date' AS "column", CASE WHEN pos % 50 = 49 THEN 'missing'
         WHEN pos % 4 IN (1, 3) THEN 'date' ELSE 'none' END AS change, count(*) AS n
FROM messy_orders GROUP BY 2
UNION ALL
SELECT 'ship_note', CASE pos % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'blank' ELSE 'missing' END, count(*)
FROM messy_orders GROUP BY 2""")
def clean_changes_by_column(spark, sf_dir):
    """What was done to the cells of two columns."""
    names = ["order_date", "ship_note"]
    cleaned = clean_cells(messy_orders(spark, sf_dir).select(*names), names)
    changes = cleaned.select(*[F.col(n)["change"].alias(n) for n in names])
    long = changes.unpivot([], names, "column", "change")
    return long.groupBy("column", "change").agg(F.count(F.lit(1)).alias("n"))


@query("fold_accents", oracle="""
SELECT doc_id, md5(strip_accents(lower(text))) AS folded_md5 FROM documents""")
def fold_document_accents(spark, sf_dir):
    """Whole texts in four languages."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(fold_accents(F.lower("text"))).alias("folded_md5"))


@query("slug_values", oracle="""
SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '_', 'g'), '_')) AS slug_md5
FROM documents""")
def slug_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(slug(F.col("text"))).alias("slug_md5"))


@query("annotated_dates", oracle="""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
  CASE WHEN o_orderkey % 4 IN (1, 2) THEN strftime(o_orderdate + INTERVAL 5 DAY, '%Y-%m-%d') ELSE '' END AS received,
  CASE o_orderkey % 4 WHEN 2 THEN 'SYT nhận ' || strftime(o_orderdate + INTERVAL 5 DAY, '%-d/%-m/%Y') || ' bổ sung'
                      WHEN 3 THEN 'ghi chú ' || o_orderpriority ELSE '' END AS note
FROM orders""")
def annotated_dates(spark, sf_dir):
    """A date alone, with a receipt date, with both, with a note."""
    d = F.col("o_orderdate")
    day = F.date_format(d, "d/M/yyyy")
    received = F.concat(F.lit("SYT nhận "), F.date_format(d + F.expr("INTERVAL 5 DAYS"), "d/M/yyyy"))
    raw = by_key(F.col("o_orderkey"), 4, F.concat(day, F.lit(".")),
                 F.concat(day, F.lit(" ("), received, F.lit(")")),
                 F.concat(day, F.lit(" ("), received, F.lit(" bổ sung)")),
                 F.concat(day, F.lit(" (ghi chú "), F.col("o_orderpriority"), F.lit(") ")))
    source = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("order_date"))
    return split_date_notes(source, "order_date", "received", "note")


