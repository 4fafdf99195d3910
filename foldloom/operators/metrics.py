"""Fold metrics: how close a predicted change is to the true one, by key columns, over features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_SPREAD, TOP = 1e-8, 20


def pearson(a: str, b: str) -> Column:
    """An aggregate: Pearson's r; 0 where either side hardly varies."""
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when((F.stddev_pop(a) > LEAST_SPREAD) & (F.stddev_pop(b) > LEAST_SPREAD), F.coalesce(r, F.lit(0.0))).otherwise(F.lit(0.0))


def average_rank(value: Column | str, *by: str) -> Column:
    """Ranks from 1, equal values sharing the mean of theirs."""
    value = F.col(value) if isinstance(value, str) else value
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def top(df: DataFrame, value: str, k: int, *by: str) -> DataFrame:
    """Rows with the ``k`` greatest magnitudes for each ``by``; of equal ones the greater gene_idx, NaN before all. Spark keeps k
    rows of each group before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.abs(value)), F.desc("gene_idx"))
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def fold_metrics(pairs: DataFrame, *by: str, k: int = TOP) -> DataFrame:
    """``pairs``: by, gene_idx, delta_true, delta_pred. By, pearson_r, spearman_rho, mse, jaccard: one shuffle by ``by``."""
    keyed = pairs.withColumns({"rank_true": average_rank("delta_true", *by), "rank_pred": average_rank("delta_pred", *by)})
    place = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs(c)), F.desc("gene_idx")))
    keyed = keyed.withColumns({"top_true": place("delta_true") <= k, "top_pred": place("delta_pred") <= k})
    both = F.count_if(F.col("top_true") & F.col("top_pred"))
    either = F.count_if(F.col("top_true") | F.col("top_pred"))
    flat = lambda a, b: (F.stddev_pop(a) > LEAST_SPREAD) & (F.stddev_pop(b) > LEAST_SPREAD)
    rho = F.try_divide(F.covar_pop("rank_true", "rank_pred"), F.stddev_pop("rank_true") * F.stddev_pop("rank_pred"))
    return keyed.groupBy(*by).agg(
        pearson("delta_true", "delta_pred").alias("pearson_r"),
        F.when(flat("delta_true", "delta_pred"), F.coalesce(rho, F.lit(0.0))).otherwise(F.lit(0.0)).alias("spearman_rho"),
        F.avg(F.pow(F.col("delta_true") - F.col("delta_pred"), F.lit(2.0))).alias("mse"),
        F.coalesce(F.try_divide(both, either), F.lit(0.0)).alias("jaccard"),
    )
