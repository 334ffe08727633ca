"""Question selection and cost queries: documents as questions, sources as datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.cost import (active_cost, cost_scenarios, dataset_volumes, price_table,
                                       prices_for, total_volumes)
from tallyframe.operators.ordering import first_within, rank_within
from tallyframe.operators.select import (quota_totals, sample_exact, select_balanced,
                                         select_smallest, smallest_datasets)
from tallyframe.plans.registry import query, table


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    empty = F.lit("")
    return d.select(
        F.col("doc_id").alias("index"), F.col("source").alias("db_id"),
        F.when(F.col("n_chars") > 500, "Moderate").otherwise("Simple").alias("sql_complexity"),
        F.col("lang").alias("question_style"), F.col("text").alias("question"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  about "), "lang", F.lit(" \n")))
        .otherwise("  ").alias("external_knowledge"), empty.alias("cot"), empty.alias("sql"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_source = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("db_id")).agg(
        F.sum("n_chars").alias("size_bytes"))
    return per_source.select("db_id", "size_bytes", F.expr("size_bytes div 4").alias("approx_tokens"))


BASE = """
catalog AS (SELECT source AS db_id, sum(n_chars) :: BIGINT AS size_bytes,
                   (sum(n_chars) // 4) :: BIGINT AS approx_tokens FROM documents GROUP BY source),
questions AS (SELECT doc_id AS "index", source AS db_id FROM documents),
sized AS (SELECT "index", db_id, size_bytes FROM questions JOIN catalog USING (db_id))"""


def _brief(df: DataFrame) -> DataFrame:
    return df.select("index", "db_id")


@query("select_by_size", oracle=f'WITH {BASE} SELECT "index", db_id, size_bytes FROM sized')
def select_by_size(spark, sf_dir):
    """The full sort; text columns are pruned before the shuffle."""
    return select_smallest(_brief(questions(spark, sf_dir)), catalog(spark, sf_dir))


@query("select_limit", oracle=f"""
WITH {BASE} SELECT "index", db_id, size_bytes FROM sized ORDER BY size_bytes, "index" LIMIT 120""")
def select_limit(spark, sf_dir):
    return select_smallest(_brief(questions(spark, sf_dir)), catalog(spark, sf_dir), 120)


BALANCED = f"""
WITH {BASE},
chosen AS (SELECT db_id, size_bytes, min("index") AS first_index FROM sized GROUP BY 1, 2
           ORDER BY size_bytes, first_index LIMIT {{n}}),
ranked AS (SELECT db_rank, s.db_id, s."index",
                  row_number() OVER (PARTITION BY s.db_id ORDER BY s."index") AS rn
           FROM sized s JOIN (SELECT db_id, row_number() OVER (ORDER BY size_bytes, first_index) AS db_rank
                              FROM chosen) c ON s.db_id = c.db_id)
SELECT db_id, "index" FROM ranked WHERE {{quota}} ORDER BY db_rank, "index" LIMIT {{limit}}"""


@query("select_balanced", oracle=BALANCED.format(n=7, quota="rn <= 14", limit=100))
def select_balanced_quota(spark, sf_dir):
    return _brief(select_balanced(_brief(questions(spark, sf_dir)), catalog(spark, sf_dir), 7, 100))


@query("select_balanced_zero_quota", oracle=BALANCED.format(n=12, quota="true", limit=10))
def select_balanced_zero(spark, sf_dir):
    """Fewer rows than datasets: the quota is zero, whole datasets are taken, then cut."""
    return _brief(select_balanced(_brief(questions(spark, sf_dir)), catalog(spark, sf_dir), 12, 10))


@query("smallest_datasets", oracle=f"""
WITH {BASE} SELECT db_id, size_bytes, row_number() OVER (ORDER BY size_bytes, min("index")) AS db_rank
FROM sized GROUP BY db_id, size_bytes QUALIFY db_rank <= 5""")
def smallest(spark, sf_dir):
    top = smallest_datasets(_brief(questions(spark, sf_dir)), catalog(spark, sf_dir), 5)
    return top.withColumn("db_rank", F.col("db_rank").cast("bigint"))


@query("sample_exact", oracle="""
SELECT doc_id AS "index", source AS db_id FROM documents
ORDER BY md5(concat('7', ':', CAST(doc_id AS VARCHAR))), doc_id LIMIT 50""")
def sample(spark, sf_dir):
    return sample_exact(_brief(questions(spark, sf_dir)), 50, "7")


@query("rank_within_dataset", oracle=f"""
WITH {BASE} SELECT "index", db_id, row_number() OVER (PARTITION BY db_id ORDER BY "index") AS rn FROM questions""")
def rank_within_dataset(spark, sf_dir):
    """Positions inside each dataset, range by range."""
    return rank_within(_brief(questions(spark, sf_dir)), ["db_id"], "index")


@query("first_within_dataset", oracle=f"""
WITH {BASE} SELECT "index", db_id FROM questions
QUALIFY row_number() OVER (PARTITION BY db_id ORDER BY "index") <= 30""")
def first_within_dataset(spark, sf_dir):
    return first_within(_brief(questions(spark, sf_dir)), ["db_id"], "index", 30)


@query("questions_per_dataset", oracle=f"""
WITH {BASE} SELECT db_id, count(*) AS questions FROM questions GROUP BY db_id""")
def questions_per_dataset(spark, sf_dir):
    return quota_totals(_brief(questions(spark, sf_dir)), ["db_id"])


VOLUMES = f"""
{BASE},
volumes AS (SELECT db_id, count(*) AS questions, any_value(approx_tokens) AS approx_tokens,
    any_value(approx_tokens) * count(*) AS no_cache_tokens, any_value(approx_tokens) AS write_tokens,
    any_value(approx_tokens) * (count(*) - 1) AS read_tokens
  FROM questions JOIN catalog USING (db_id) GROUP BY db_id),
total AS (SELECT sum(questions) :: BIGINT AS questions, sum(no_cache_tokens) :: BIGINT AS no_cache_tokens,
    sum(write_tokens) :: BIGINT AS write_tokens, sum(read_tokens) :: BIGINT AS read_tokens FROM volumes),
prices(model_id, input, output, mult, cached, discount) AS (VALUES
  ('claude-sonnet-4-6', 3.00 :: DOUBLE, 15.00 :: DOUBLE, 1.25 :: DOUBLE, 0.30 :: DOUBLE, 0.5 :: DOUBLE),
  ('gemini-3.1-pro-preview', 2.0, 12.0, 1.0, 0.2, 0.5), ('gemini-3-flash-preview', 0.5, 3.0, 1.0, 0.05, 0.5),
  ('gemini-3.1-flash-lite-preview', 0.25, 1.5, 1.0, 0.025, 0.5), ('gpt-5.4', 2.5, 15.0, 1.0, 0.25, 0.5),
  ('unlisted-model', 3.0, 15.0, 1.25, 0.3, 0.5)),
costs AS (
  SELECT model_id, scenario, batch, cache, round((
      CASE WHEN cache THEN write_tokens * input * mult + read_tokens * cached ELSE no_cache_tokens * input END
      + questions * (600 * input + 800 * output)) * CASE WHEN batch THEN discount ELSE 1 END / 1e6, 4) AS cost_usd
  FROM prices, total, (VALUES ('no_optimization', false, false), ('batch_only', true, false),
                              ('cache_only', false, true), ('batch_and_cache', true, true)) s(scenario, batch, cache))"""


def _volumes(spark, sf_dir):
    return dataset_volumes(_brief(questions(spark, sf_dir)), catalog(spark, sf_dir))


def _models(spark):
    prices = price_table(spark)
    return prices.select("model_id").union(
        prices.select(F.lit("unlisted-model").alias("model_id")).limit(1)), prices


@query("cost_volumes", oracle=f"WITH {VOLUMES} SELECT * FROM volumes")
def cost_volumes(spark, sf_dir):
    return _volumes(spark, sf_dir).drop("long_context")


@query("cost_totals", oracle=f"WITH {VOLUMES} SELECT * FROM total")
def cost_totals(spark, sf_dir):
    return total_volumes(_volumes(spark, sf_dir))


@query("cost_scenarios", oracle=f"WITH {VOLUMES} SELECT * FROM costs")
def scenarios(spark, sf_dir):
    """Every listed model and one without prices, in four scenarios."""
    models, prices = _models(spark)
    return cost_scenarios(_volumes(spark, sf_dir), models, prices).select(
        "model_id", "scenario", "batch", "cache", F.round("cost_usd", 4).alias("cost_usd"))


@query("cost_active", oracle=f"WITH {VOLUMES} SELECT model_id, cost_usd FROM costs WHERE batch AND NOT cache")
def active(spark, sf_dir):
    models, prices = _models(spark)
    rows = cost_scenarios(_volumes(spark, sf_dir), models, prices)
    return active_cost(rows, use_batch=True, use_cache=False).select(
        "model_id", F.round("cost_usd", 4).alias("cost_usd"))


@query("price_fallback", oracle=f"""
WITH {BASE}, seen AS (SELECT DISTINCT CASE lang WHEN 'en' THEN 'gpt-5.4' ELSE 'model-' || lang END AS model_id FROM documents)
SELECT model_id, model_id <> 'gpt-5.4' AS is_proxy, CASE model_id WHEN 'gpt-5.4' THEN 2.5 :: DOUBLE ELSE 3.0 :: DOUBLE END AS input FROM seen""")
def price_fallback(spark, sf_dir):
    """Models named by the data; those without a price row get the proxy's."""
    d = table(spark, sf_dir, "documents")
    models = d.select(F.when(F.col("lang") == "en", "gpt-5.4").otherwise(
        F.concat(F.lit("model-"), "lang")).alias("model_id")).distinct()
    return prices_for(models, price_table(spark)).select("model_id", "is_proxy", "input")


@query("long_context_flag", oracle="""
SELECT 'p' || CAST(l_partkey AS VARCHAR) AS db_id, sum(CAST(l_extendedprice AS BIGINT)) // 4 > 200000 AS long_context
FROM lineitem GROUP BY l_partkey""")
def long_context_flag(spark, sf_dir):
    """Datasets large enough to cross the boundary: parts by sales volume."""
    items = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    sizes = items.groupBy(name.alias("db_id")).agg(
        F.sum(F.round("l_extendedprice").cast("bigint")).alias("size_bytes"))
    asked = items.select(name.alias("db_id"))
    return dataset_volumes(asked, sizes.withColumn("approx_tokens", F.expr("size_bytes div 4"))).select(
        "db_id", "long_context")
