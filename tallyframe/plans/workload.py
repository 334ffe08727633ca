"""The analytic queries users ask of the tables, over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.functions.cells import normalize_date, normalize_number
from tallyframe.operators.ordering import running_sum
from tallyframe.plans.messy import (GROUPED, MESSY_ORDERS, MONEY, by_key, grouped_money, messy_orders,
                                    money)
from tallyframe.plans.registry import query, table

CENTS = "CAST({} AS DECIMAL(18,2))"


def cents(name: str):
    """Exact money: sums do not depend on the order rows arrive in."""
    return F.col(name).cast("decimal(18,2)")


def average(name: str):
    """Exact sum over the count, left unrounded: ties round differently elsewhere."""
    return F.sum(cents(name)).cast("double") / F.count(name)


AVG = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) / count({0})"


@query("wk_filter", oracle="SELECT p_partkey, p_name FROM part WHERE p_size >= 20")
def wk_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_size") >= 20).select("p_partkey", "p_name")


@query("wk_range", oracle=f"""
SELECT CAST(sum({CENTS.format('l_extendedprice')}) AS DOUBLE) AS total FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 20 AND l_shipdate >= TIMESTAMP '1995-01-01'""")
def wk_range(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(
        (F.col("l_returnflag") == "R") & F.col("l_quantity").between(10, 20)
        & (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")))
    return rows.agg(F.sum(cents("l_extendedprice")).cast("double").alias("total"))


@query("wk_in_list", oracle=f"""
SELECT c_mktsegment, {AVG.format('c_acctbal')} AS avg_balance, count(*) AS n FROM customer
WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') AND c_acctbal IS NOT NULL
GROUP BY c_mktsegment HAVING count(*) > 1""")
def wk_in_list(spark, sf_dir):
    return (table(spark, sf_dir, "customer")
            .where(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD", "MACHINERY") & F.col("c_acctbal").isNotNull())
            .groupBy("c_mktsegment").agg(average("c_acctbal").alias("avg_balance"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


@query("wk_null_tests", oracle=f"""
WITH {MESSY_ORDERS}
SELECT count(*) FILTER (ship_note IS NOT NULL AND trim(ship_note) <> '') AS filled,
  count(*) FILTER (nullif(trim(ship_note), '') IS NULL) AS blank FROM messy_orders""")
def wk_null_tests(spark, sf_dir):
    note = F.nullif(F.trim("ship_note"), F.lit(""))
    return messy_orders(spark, sf_dir).agg(F.count_if(note.isNotNull()).alias("filled"),
                                           F.count_if(note.isNull()).alias("blank"))


@query("wk_global_aggregate", oracle=f"""
SELECT {AVG.format('o_totalprice')} AS avg_price, CAST(sum({CENTS.format('o_totalprice')}) AS DOUBLE) AS total,
  min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM orders""")
def wk_global_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        average("o_totalprice").alias("avg_price"), F.sum(cents("o_totalprice")).cast("double").alias("total"),
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count(F.lit(1)).alias("n"))


@query("wk_group_by", oracle="""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def wk_group_by(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.count(F.lit(1)).alias("n"))


@query("wk_having", oracle=f"""
SELECT p_brand, {AVG.format('p_retailprice')} AS avg_price FROM part GROUP BY p_brand
HAVING {AVG.format('p_retailprice')} > 950 AND count(*) >= 3""")
def wk_having(spark, sf_dir):
    return (table(spark, sf_dir, "part").groupBy("p_brand")
            .agg(average("p_retailprice").alias("avg_price"), F.count(F.lit(1)).alias("n"))
            .where((F.col("avg_price") > 950) & (F.col("n") >= 3)).select("p_brand", "avg_price"))


@query("wk_named_aggregates", oracle=f"""
SELECT o_orderstatus, {AVG.format('o_totalprice')} AS avg_price, min(o_totalprice) AS low, max(o_totalprice) AS high,
  count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus""")
def wk_named_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        average("o_totalprice").alias("avg_price"), F.min("o_totalprice").alias("low"),
        F.max("o_totalprice").alias("high"), F.count(F.lit(1)).alias("orders"),
        F.count_distinct("o_custkey").alias("customers"))


@query("wk_derived_key", oracle="""
SELECT CAST(year(l_shipdate) // 10 * 10 AS BIGINT) AS decade, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def wk_derived_key(spark, sf_dir):
    decade = (F.floor(F.year("l_shipdate") / 10) * 10).cast("bigint")
    return table(spark, sf_dir, "lineitem").groupBy(decade.alias("decade"), "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"))


@query("wk_order_by", oracle="SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC")
def wk_order_by(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").orderBy(
        "s_nationkey", F.desc("s_acctbal"))


@query("wk_top_k", oracle="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def wk_top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("wk_top_k_per_group", oracle="""
SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def wk_top_k_per_group(spark, sf_dir):
    """The rank filter runs before the shuffle: each task sends three rows per group."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return (table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
            .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 3).drop("rn"))


@query("wk_above_average", oracle=f"""
SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT {AVG.format('c_acctbal')} FROM customer)""")
def wk_above_average(spark, sf_dir):
    """Rows against a scalar subquery: one number is broadcast."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    overall = c.agg(average("c_acctbal").alias("overall"))
    return c.join(F.broadcast(overall), F.col("c_acctbal") > F.col("overall")).select("c_custkey", "c_acctbal")


@query("wk_group_above_overall", oracle=f"""
SELECT n_name, {AVG.format('c_acctbal')} AS avg_balance FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name HAVING {AVG.format('c_acctbal')} > (SELECT {AVG.format('c_acctbal')} FROM customer)""")
def wk_group_above_overall(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    # Grouped before the join: nation names are looked up once per nation.
    groups = c.groupBy("c_nationkey").agg(average("c_acctbal").alias("avg_balance"))
    overall = c.agg(average("c_acctbal").alias("overall"))
    above = groups.join(F.broadcast(overall), F.col("avg_balance") > F.col("overall"))
    nation = table(spark, sf_dir, "nation")
    return above.join(nation, above.c_nationkey == nation.n_nationkey).select("n_name", "avg_balance")


@query("wk_arg_max", oracle="""
SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part WHERE p_type = 'ECONOMY') AND p_type = 'ECONOMY'""")
def wk_arg_max(spark, sf_dir):
    """All ties of the maximum: a one-row aggregate joined back, no rank window."""
    p = table(spark, sf_dir, "part").where(F.col("p_type") == "ECONOMY").select("p_partkey", "p_size")
    best = p.agg(F.max("p_size").alias("best"))
    return p.join(F.broadcast(best), F.col("p_size") == F.col("best")).select("p_partkey", "p_size")


@query("wk_semi_join", oracle=f"""
SELECT o_custkey, {AVG.format('o_totalprice')} AS avg_price FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY o_custkey
HAVING {AVG.format('o_totalprice')} >= 200000""")
def wk_semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderpriority")
    urgent = o.where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    return (o.join(urgent, "o_custkey", "left_semi").groupBy("o_custkey")
            .agg(average("o_totalprice").alias("avg_price")).where(F.col("avg_price") >= 200000))


@query("wk_cumulative_share", oracle=f"""
SELECT o_orderkey, round(CAST(sum({CENTS.format('o_totalprice')}) OVER (ORDER BY o_orderkey) AS DOUBLE)
  / (SELECT CAST(sum({CENTS.format('o_totalprice')}) AS DOUBLE) FROM orders), 6) AS share FROM orders""")
def wk_cumulative_share(spark, sf_dir):
    """A running total over the whole table, in key buckets instead of one task."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    total = o.agg(F.sum(cents("o_totalprice")).cast("double").alias("total"))
    summed = running_sum(o, [], "o_orderkey", cents("o_totalprice"), "so_far")
    return summed.join(F.broadcast(total)).select(
        "o_orderkey", F.round(F.col("so_far").cast("double") / F.col("total"), 6).alias("share"))


@query("wk_cumulative_per_group", oracle=f"""
SELECT l_suppkey, l_orderkey, sum(n) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) :: BIGINT AS so_far
FROM (SELECT l_suppkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def wk_cumulative_per_group(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return running_sum(items, ["l_suppkey"], "l_orderkey", F.col("n"), "so_far").select(
        "l_suppkey", "l_orderkey", "so_far")


@query("wk_last_in_group", oracle="""
SELECT event_type, user_id, arg_max(value, event_id) AS last_value, count(*) AS n FROM events GROUP BY event_type, user_id""")
def wk_last_in_group(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(
        F.max_by("value", "event_id").alias("last_value"), F.count(F.lit(1)).alias("n"))


@query("wk_distinct", oracle="SELECT DISTINCT p_brand, p_type FROM part")
def wk_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query("wk_count_distinct", oracle="""
SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""")
def wk_count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("wk_grouped_list", oracle="""
SELECT o_custkey, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years
FROM orders GROUP BY o_custkey""")
def wk_grouped_list(spark, sf_dir):
    """Years per customer: a set, so a busy customer's list holds years, not orders."""
    years = F.sort_array(F.collect_set(F.year("o_orderdate").cast("string")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(years, ",").alias("years"))


@query("wk_stack_columns", oracle="""
WITH both_parties AS (SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer
  UNION ALL SELECT s_nationkey, s_acctbal FROM supplier)
SELECT nation, count(*) AS parties, round(CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE), 2) AS balance
FROM both_parties GROUP BY nation""")
def wk_stack_columns(spark, sf_dir):
    """Two role columns stacked into one."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s).groupBy("nation").agg(
        F.count(F.lit(1)).alias("parties"), F.round(F.sum(cents("balance")).cast("double"), 2).alias("balance"))


@query("wk_either_column", oracle="""
SELECT flag, count(*) AS orders, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM (
  SELECT l_returnflag AS flag, l_quantity FROM lineitem
  UNION ALL SELECT l_linestatus, l_quantity FROM lineitem WHERE l_linestatus <> l_returnflag) GROUP BY flag""")
def wk_either_column(spark, sf_dir):
    """A row counts once per distinct value it holds in either of two columns."""
    flags = F.explode(F.array_distinct(F.array("l_returnflag", "l_linestatus")))
    rows = table(spark, sf_dir, "lineitem").select(flags.alias("flag"), "l_quantity")
    return rows.groupBy("flag").agg(F.count(F.lit(1)).alias("orders"),
                                    F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query("wk_safe_cast", oracle=f"""
WITH raw AS (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 4 WHEN 0 THEN {GROUPED.format('o_totalprice')}
    WHEN 1 THEN replace({MONEY.format('o_totalprice')}, '.', ',') WHEN 2 THEN {MONEY.format('o_totalprice')} ELSE 'none' END AS t FROM orders)
SELECT o_orderkey % 4 AS k, count(TRY_CAST(t AS DOUBLE)) AS castable,
  CAST(sum(CASE WHEN o_orderkey % 4 <> 3 THEN {CENTS.format('o_totalprice')} END) AS DOUBLE) AS cleaned FROM raw GROUP BY 1""")
def wk_safe_cast(spark, sf_dir):
    """A plain cast gives null where locale cleaning finds the number."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    raw = by_key(k, 4, grouped_money(price), F.replace(money(price), F.lit("."), F.lit(",")), money(price), F.lit("none"))
    rows = table(spark, sf_dir, "orders").select((k % 4).alias("k"), raw.alias("t"))
    return rows.groupBy("k").agg(
        F.count(F.col("t").try_cast("double")).alias("castable"),
        F.sum(normalize_number(F.col("t")).try_cast("decimal(18,2)")).cast("double").alias("cleaned"))


@query("wk_date_parse", oracle="""
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, min(strftime(o_orderdate, '%d/%m/%Y')) AS first_shown
FROM orders WHERE strftime(o_orderdate, '%d/%m/%Y') LIKE '%1997%' GROUP BY 1""")
def wk_date_parse(spark, sf_dir):
    """Text dates: filtered by year text, parsed, formatted."""
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("shown"))
    parsed = o.where(F.col("shown").contains("1997")).withColumn("d", normalize_date(F.col("shown")).try_cast("date"))
    return parsed.groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.min("shown").alias("first_shown"))


@query("wk_strings", oracle="""
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, replace(p_brand, '#', '-') AS replaced,
  string_split(p_name, ' ')[1] AS first_word, contains(p_name, 'ring') AS has_ring, trim('  ' || p_type || ' ') AS trimmed FROM part""")
def wk_strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"),
        F.replace("p_brand", F.lit("#"), F.lit("-")).alias("replaced"),
        F.split("p_name", " ")[0].alias("first_word"), F.col("p_name").contains("ring").alias("has_ring"),
        F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"))


@query("wk_string_assembly", oracle="""
SELECT p_brand || ' - ' || p_type || ' - ' || printf('%.2f', max(p_retailprice)) AS line
FROM part GROUP BY p_brand, p_type HAVING max(p_retailprice) > 900""")
def wk_string_assembly(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("top"))
    return g.where(F.col("top") > 900).select(F.format_string("%s - %s - %.2f", "p_brand", "p_type", "top").alias("line"))


@query("wk_math", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_tax, 1) AS rounded, abs(l_discount - l_tax) < 0.02 AS near,
  CAST(ceil(l_quantity / 7) AS BIGINT) AS ceiled, round(sqrt(l_quantity), 6) AS root, round(asinh(l_quantity), 6) AS ash,
  round(tanh(l_discount), 6) AS th, round(pi() * l_quantity, 6) AS circle FROM lineitem""")
def wk_math(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_tax", 1).alias("rounded"),
        (F.abs(F.col("l_discount") - F.col("l_tax")) < 0.02).alias("near"),
        F.ceil(F.col("l_quantity") / 7).alias("ceiled"), F.round(F.sqrt("l_quantity"), 6).alias("root"),
        F.round(F.asinh("l_quantity"), 6).alias("ash"), F.round(F.tanh("l_discount"), 6).alias("th"),
        F.round(F.pi() * F.col("l_quantity"), 6).alias("circle"))


@query("wk_row_arithmetic", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice / l_quantity AS unit_price
FROM lineitem""")
def wk_row_arithmetic(spark, sf_dir):
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"),
        (price / F.col("l_quantity")).alias("unit_price"))


@query("wk_fill_nulls", oracle="""
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(CAST(l.toxic AS VARCHAR), 'unknown') AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def wk_fill_nulls(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"),
                         F.coalesce(F.col("toxic").cast("string"), F.lit("unknown")).alias("toxic"))


@query("wk_regex_search", oracle="""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  regexp_matches(url, 'page=[0-9]+') AS paged, len(regexp_extract_all(html, '<li>')) AS items FROM pages""")
def wk_regex_search(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("url").rlike("page=[0-9]+").alias("paged"),
        F.regexp_count("html", F.lit("<li>")).cast("bigint").alias("items"))
