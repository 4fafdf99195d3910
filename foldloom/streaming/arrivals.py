"""Chunks of fold results that arrive late, repeated or out of order, summed up as a stream.

State is a row for each fold seen in the last LATEST, by its file's time, and sums for each group; both are Spark's, and
survive a lost executor by its checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import KEY, METRICS

LATEST = "7 days"
FOLD = "dataset string, graph_type string, hvg int, seed int, condition string, " + ", ".join(f"{m} double" for m in METRICS)


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Fold records of the JSON-lines files that come into ``folder``."""
    return spark.readStream.schema(FOLD).json(folder).select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def running_summary(folds: DataFrame) -> DataFrame:
    """Means and counts a (dataset, graph_type, hvg), each fold counted once: of a key that repeats within LATEST the
    first to arrive."""
    once = folds.withWatermark("arrived", LATEST).dropDuplicatesWithinWatermark(list(KEY))
    return once.groupBy("dataset", "graph_type", "hvg").agg(*[F.avg(m).alias(f"{m.split('_')[0]}_mean") for m in METRICS], F.count("*").alias("n_folds"))
