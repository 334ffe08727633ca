"""Token volumes and cost scenarios: one group-by, then column arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Assumed tokens per question and the long-context boundary.
OUTPUT_TOKENS = 800
PROMPT_TOKENS = 600
LONG_CONTEXT = 200_000
PROXY_MODEL = "claude-sonnet-4-6"

PRICE_DDL = ("model_id string, input double, output double, cache_write_mult double, "
             "cache_read double, batch_discount double, input_long double, cache_read_long double")

# US dollars per million tokens.
PRICES = (
    ("claude-sonnet-4-6", 3.00, 15.00, 1.25, 0.30, 0.50, None, None),
    ("gemini-3.1-pro-preview", 2.00, 12.00, 1.00, 0.20, 0.50, 4.00, 0.40),
    ("gemini-3-flash-preview", 0.50, 3.00, 1.00, 0.05, 0.50, None, None),
    ("gemini-3.1-flash-lite-preview", 0.25, 1.50, 1.00, 0.025, 0.50, None, None),
    ("gpt-5.4", 2.50, 15.00, 1.00, 0.25, 0.50, None, None),
)

# The four scenarios as (name, batch, cache).
SCENARIOS = (("no_optimization", False, False), ("batch_only", True, False),
             ("cache_only", False, True), ("batch_and_cache", True, True))


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, PRICE_DDL)


def prices_for(models: DataFrame, prices: DataFrame, proxy: str = PROXY_MODEL) -> DataFrame:
    """A price row per model; a model without one gets the proxy's prices.

    The proxy is one row.
    """
    fields = [c for c in prices.columns if c != "model_id"]
    fallback = prices.where(F.col("model_id") == proxy).select(F.struct(*fields).alias("_proxy"))
    own = prices.select("model_id", F.struct(*fields).alias("_own"))
    return (models.join(own, "model_id", "left").join(F.broadcast(fallback))
            .select("model_id", F.col("_own").isNull().alias("is_proxy"),
                    F.coalesce("_own", "_proxy").alias("p")).select("model_id", "is_proxy", "p.*"))


def dataset_volumes(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per dataset: questions and dataset tokens with and without a cache.

    A dataset that the catalog lacks keeps its row, with null token counts.
    """
    counts = questions.groupBy("db_id").agg(F.count(F.lit(1)).alias("questions"))
    tokens, n = F.col("approx_tokens"), F.col("questions")
    return counts.join(catalog.select("db_id", "approx_tokens"), "db_id", "left").select(
        "db_id", "questions", "approx_tokens", (tokens * n).alias("no_cache_tokens"),
        tokens.alias("write_tokens"), (tokens * (n - 1)).alias("read_tokens"),
        (tokens > LONG_CONTEXT).alias("long_context"))


def total_volumes(volumes: DataFrame) -> DataFrame:
    return volumes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
        "questions", "no_cache_tokens", "write_tokens", "read_tokens")])


def cost_scenarios(volumes: DataFrame, models: DataFrame, prices: DataFrame,
                   output_tokens: int = OUTPUT_TOKENS, prompt_tokens: int = PROMPT_TOKENS) -> DataFrame:
    """(model_id, scenario, batch, cache, cost_usd) for every model and scenario.

    The cross joins pair the one-row total with the price rows and the four
    scenarios.
    """
    flags = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(b).alias("batch"),
                                         F.lit(c).alias("cache")) for s, b, c in SCENARIOS]))
    total = total_volumes(volumes)
    rows = prices_for(models, prices).crossJoin(F.broadcast(total)).select("*", flags.alias("s"))
    rows = rows.select("*", "s.*")
    discount = F.when(F.col("batch"), F.col("batch_discount")).otherwise(1.0)
    cached = (F.col("write_tokens") * F.col("input") * F.col("cache_write_mult")
              + F.col("read_tokens") * F.col("cache_read"))
    data = F.when(F.col("cache"), cached).otherwise(F.col("no_cache_tokens") * F.col("input"))
    asked = F.col("questions") * (F.lit(float(prompt_tokens)) * F.col("input")
                                  + F.lit(float(output_tokens)) * F.col("output"))
    return rows.select("model_id", "is_proxy", "scenario", "batch", "cache",
                       ((data + asked) * discount / 1e6).alias("cost_usd"))


def active_cost(scenarios: DataFrame, use_batch: bool = True, use_cache: bool = True) -> DataFrame:
    """The scenario rows that fit the configured flags."""
    return scenarios.where((F.col("batch") == use_batch) & (F.col("cache") == use_cache))
