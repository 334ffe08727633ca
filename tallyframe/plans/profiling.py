"""Profiling queries over a messy table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators.profile import (SEMANTIC_GROUPS, column_stats, melt, mixed_layout_columns, profile_columns,
                                          profile_document, ranked_values, semantic_flags,
                                          semantic_groups, value_counts)
from tallyframe.operators.sketches import read_sketches, sketched_profile, update_sketches
from tallyframe.plans.io import fresh_dir
from tallyframe.plans.messy import MELTED, messy_orders
from tallyframe.plans.registry import query, table

RANKED = f"""
WITH {MELTED},
valued AS (SELECT "column", value, count(*) AS n, min(pos) AS first_pos
           FROM flagged WHERE present GROUP BY "column", value)"""


def _values(spark, sf_dir):
    return value_counts(melt(messy_orders(spark, sf_dir), "pos"))


@query("profile_counts", oracle="""
SELECT 'orders' AS db_id, count(*) AS row_count, 6 :: BIGINT AS column_count FROM orders""")
def profile_counts(spark, sf_dir):
    """Rows and columns as the profile document reports them."""
    cells = table(spark, sf_dir, "orders").withColumn("pos", F.col("o_orderkey"))
    return profile_document(cells, "orders", "pos").select("db_id", "row_count", "column_count")


@query("profile_melt", oracle=f"""
WITH {MELTED} SELECT "column", count(*) AS n, count(DISTINCT pos) AS positions,
  sum(length(value)) :: BIGINT AS chars FROM cells GROUP BY "column" """)
def profile_melt(spark, sf_dir):
    """The long form itself, summed per column."""
    return melt(messy_orders(spark, sf_dir), "pos").groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("positions"),
        F.sum(F.length("value")).alias("chars"))


@query("profile_missing", oracle=f"""
WITH {MELTED} SELECT "column", missing_count, missing_ratio FROM stats""")
def profile_missing(spark, sf_dir):
    return column_stats(_values(spark, sf_dir)).select("column", "missing_count", "missing_ratio")


@query("profile_distinct", oracle=f"""
WITH {MELTED} SELECT "column", unique_count, unique_ratio FROM stats""")
def profile_distinct(spark, sf_dir):
    return column_stats(_values(spark, sf_dir)).select("column", "unique_count", "unique_ratio")


@query("profile_ratios", oracle=f"""
WITH {MELTED} SELECT "column", date_match_ratio, numeric_match_ratio, bool_match_ratio FROM stats""")
def profile_ratios(spark, sf_dir):
    return column_stats(_values(spark, sf_dir)).select(
        "column", "date_match_ratio", "numeric_match_ratio", "bool_match_ratio")


@query("profile_top5", oracle=RANKED + """
SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, first_pos) AS rank
FROM valued QUALIFY rank <= 5""")
def profile_top5(spark, sf_dir):
    return ranked_values(_values(spark, sf_dir), 5, True).select(
        "column", "value", "n", F.col("rank").cast("bigint").alias("rank"))


@query("profile_sample5", oracle=RANKED + """
SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY first_pos) AS rank
FROM valued QUALIFY rank <= 5""")
def profile_sample5(spark, sf_dir):
    return ranked_values(_values(spark, sf_dir), 5, False).select(
        "column", "value", F.col("rank").cast("bigint").alias("rank"))


@query("profile_columns", oracle=RANKED + """,
top AS (SELECT "column", string_agg(value || '=' || n, ';' ORDER BY n DESC, first_pos) AS top_values FROM (
  SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, first_pos) <= 5) GROUP BY 1),
sample AS (SELECT "column", string_agg(value, ';' ORDER BY first_pos) AS sample_values FROM (
  SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY first_pos) <= 5) GROUP BY 1)
SELECT stats.*  EXCLUDE (row_count), top_values, sample_values
FROM stats JOIN top USING ("column") JOIN sample USING ("column")""")
def profile_all_columns(spark, sf_dir):
    """The whole bundle in one plan."""
    return profile_columns(messy_orders(spark, sf_dir), "pos").select(
        "column", "missing_count", "missing_ratio", "unique_count", "unique_ratio",
        "date_match_ratio", "numeric_match_ratio", "bool_match_ratio",
        F.array_join(F.transform("top_values", lambda t: F.concat(
            t["value"], F.lit("="), t["count"].cast("string"))), ";").alias("top_values"),
        F.array_join("sample_values", ";").alias("sample_values"))


FLAGS = """
flags AS (
  SELECT "column", date_match_ratio >= 0.7 AS date_columns,
    numeric_match_ratio >= 0.85 AND unique_count >= 5 AS numeric_columns,
    bool_match_ratio >= 0.95 AS boolean_like_columns,
    unique_ratio > 0.95 AND regexp_matches("column", 'id|code|ma|sbd|stt') AS id_like_columns,
    missing_ratio > 0.3 AS high_missing_columns,
    numeric_match_ratio >= 0.6 AND numeric_match_ratio < 0.85 AS numeric_as_text_columns
  FROM stats)"""


@query("profile_flags", oracle=f"WITH {MELTED}, {FLAGS} SELECT * FROM flags")
def profile_flags(spark, sf_dir):
    return column_stats(_values(spark, sf_dir)).select("column", *semantic_flags())




@query("profile_groups", oracle=f"WITH {MELTED}, {FLAGS} SELECT " + ", ".join(
    f"""coalesce(string_agg("column", ',' ORDER BY "column") FILTER ({g}), '') AS {g}""" for g in SEMANTIC_GROUPS)
    + " FROM flags")
def profile_groups(spark, sf_dir):
    groups = semantic_groups(column_stats(_values(spark, sf_dir)))
    return groups.select(*[F.array_join(g, ",").alias(g) for g in SEMANTIC_GROUPS])


@query("profile_mixed_dates", oracle=f"""
WITH {MELTED},
date_cells AS (
  SELECT "column", value FROM flagged JOIN stats USING ("column") WHERE present AND date_match_ratio >= 0.7)
SELECT "column" FROM date_cells GROUP BY "column"
HAVING count(DISTINCT CASE WHEN regexp_full_match(value, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'iso'
  WHEN value LIKE '%/%' THEN 'dmy' ELSE 'd-m-y' END) > 1""")
def profile_mixed_dates(spark, sf_dir):
    return mixed_layout_columns(column_stats(_values(spark, sf_dir)))


@query("profile_document", oracle=f"""
WITH {MELTED}, {FLAGS}
SELECT 'orders' AS db_id, (SELECT count(*) FROM orders) AS row_count, 7 :: BIGINT AS column_count,
  (SELECT string_agg("column", ',' ORDER BY "column") FROM flags WHERE date_columns) AS date_columns,
  'order_date' AS mixed, (SELECT unique_count FROM stats WHERE "column" = 'priority') AS priorities,
  (SELECT missing_ratio FROM stats WHERE "column" = 'ship_note') AS note_missing,
  false AS has_bom, true AS non_comma_delimiter""")
def profile_documents(spark, sf_dir):
    """The nested document, read back by path."""
    doc = profile_document(messy_orders(spark, sf_dir), "orders", "pos", delimiter=";")
    stat = F.col("column_stats")
    return doc.select(
        "db_id", "row_count", "column_count",
        F.array_join("inferred_types.date_columns", ",").alias("date_columns"),
        F.array_join("quality_flags.mixed_date_format_columns", ",").alias("mixed"),
        stat["priority"]["unique_count"].alias("priorities"),
        stat["ship_note"]["missing_ratio"].alias("note_missing"),
        "quality_flags.has_bom", "quality_flags.non_comma_delimiter")


@query("profile_approximate", oracle=f"""
WITH {MELTED} SELECT "column", missing_count, date_match_ratio, numeric_match_ratio, bool_match_ratio FROM stats""")
def profile_approximate(spark, sf_dir):
    """The one-scan mode: everything but the distinct count is exact."""
    return profile_columns(messy_orders(spark, sf_dir), "pos", exact=False).select(
        "column", "missing_count", "date_match_ratio", "numeric_match_ratio", "bool_match_ratio")


@query("profile_grown_folder", oracle=RANKED + """,
few AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place,
               count(*) OVER (PARTITION BY "column") AS d FROM valued),
tops AS (SELECT "column", list(value || '=' || n ORDER BY place) AS top_values
         FROM few WHERE d <= 100 AND place <= 5 GROUP BY "column")
SELECT "column", row_count, missing_count, missing_ratio, date_match_ratio, numeric_match_ratio, bool_match_ratio,
       top_values, TRUE AS distinct_in_bound
FROM stats LEFT JOIN tops USING ("column")""")
def profile_grown_folder(spark, sf_dir):
    """A folder profiled, grown and profiled again from old sketches and new files.

    The distinct estimates are held against exact counts: five standard errors.
    """
    folder, store = fresh_dir(spark, "grown"), fresh_dir(spark, "sketches")
    orders = messy_orders(spark, sf_dir)
    late = F.coalesce(F.col("priority") >= "3", F.lit(False))
    for drop in (orders.where(~late), orders.where(late)):
        drop.drop("pos").write.mode("append").parquet(folder)
        update_sketches(spark, folder, store, lambda paths: spark.read.parquet(*paths), "*.parquet")
    shown = sketched_profile(read_sketches(spark, store))
    exact = column_stats(_values(spark, sf_dir)).select("column", F.col("unique_count").alias("exact"))
    near = F.abs(F.col("unique_count") - F.col("exact")) <= 5 * 0.0082 * F.col("exact")
    listed = F.transform("top_values", lambda t: F.concat(t["value"], F.lit("="), t["count"].cast("string")))
    return shown.join(exact, "column").select(
        "column", "row_count", "missing_count", "missing_ratio", "date_match_ratio", "numeric_match_ratio",
        "bool_match_ratio", F.when(F.col("exact").between(1, 100), listed).alias("top_values"),
        near.alias("distinct_in_bound"))
