"""Choosing questions: by dataset size, first n, balanced, random."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.ordering import first_within


def with_dataset_size(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach ``size_bytes`` of each question's dataset; null for an unknown one."""
    return questions.join(catalog.select("db_id", "size_bytes"), "db_id", "left")


def unknown_datasets(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """(db_id, questions) of datasets that questions name and the catalog lacks."""
    asked = questions.groupBy("db_id").agg(F.count(F.lit(1)).alias("questions"))
    return asked.join(catalog.select("db_id"), "db_id", "left_anti")


def require_datasets(questions: DataFrame, catalog: DataFrame) -> None:
    """Raise when a question names an unknown dataset."""
    missing = unknown_datasets(questions, catalog).orderBy("db_id").first()
    if missing is not None:
        raise ValueError(f"no dataset {missing['db_id']!r} in the catalog")


def select_smallest(questions: DataFrame, catalog: DataFrame, limit: int | None = None) -> DataFrame:
    """Questions by ascending dataset size, ties in index order.

    With ``limit`` this is a top-n: every task keeps its own first ``limit``
    rows. Without one it is a range-partitioned sort. Questions of an unknown
    dataset come last, without a size.
    """
    ordered = with_dataset_size(questions, catalog).orderBy(F.col("size_bytes").asc_nulls_last(), "index")
    return ordered if limit is None else ordered.limit(limit)


def smallest_datasets(questions: DataFrame, catalog: DataFrame, n_db: int) -> DataFrame:
    """(db_id, db_rank) of the n smallest datasets that have questions.

    Datasets of equal size rank by their first question.
    """
    firsts = questions.groupBy("db_id").agg(F.min("index").alias("first_index"))
    order = [F.col("size_bytes").asc_nulls_last(), F.col("first_index")]
    top = firsts.join(catalog.select("db_id", "size_bytes"), "db_id", "left").orderBy(*order).limit(n_db)
    return top.withColumn("db_rank", F.row_number().over(Window.orderBy(*order))).select("db_id", "size_bytes", "db_rank")


def select_balanced(questions: DataFrame, catalog: DataFrame, n_db: int,
                    limit: int | None = None) -> DataFrame:
    """``limit // n_db`` questions from each of the n smallest datasets.

    Cut to ``limit`` in dataset order. A quota of zero takes whole datasets
    before the cut.
    """
    chosen = smallest_datasets(questions, catalog, n_db)
    rows = questions.join(chosen, "db_id")
    quota = limit // n_db if limit else 0
    if quota:
        rows = first_within(rows, ["db_id"], "index", quota)
    ordered = rows.orderBy("db_rank", "index")
    return ordered.limit(limit) if limit else ordered


def sample_exact(questions: DataFrame, n: int, seed: str, key: str = "index") -> DataFrame:
    """Exactly ``n`` rows without replacement, the same for the same seed.

    Rows are ordered by a seeded hash of their key, so the choice does not
    depend on partitioning; each task keeps its own n smallest hashes.
    """
    if n <= 0:
        raise ValueError("sample size must be positive")
    require_sample_size(questions, n)
    drawn = questions.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))))
    return drawn.orderBy("_h", key).limit(n).drop("_h")


def require_sample_size(questions: DataFrame, n: int) -> None:
    """Raise when the pool is smaller than the sample; counts at most n rows."""
    if questions.limit(n).count() < n:
        raise ValueError(f"sample of {n} rows is larger than the source")


def quota_totals(questions: DataFrame, keys: list[str]) -> DataFrame:
    """Questions per key."""
    return questions.groupBy(*keys).agg(F.count(F.lit(1)).alias("questions"))
