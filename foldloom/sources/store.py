"""Folds at rest, one folder a key, and merging into them what arrives.

The store is Parquet by (hvg, dataset, graph_type, seed), a row a fold. Writing a key replaces that key's folder alone, and its line of
the manifest. Merged batches lie below a folder of their number and hold only folds that no other batch has: a batch that is
replayed, or was cut off before its commit, replaces its own folder and changes nothing else, so merging twice is merging once.
Result documents are made a key at a time, so no row holds more than the folds of one key.

Keys with an empty text are read back as null, as folders have no empty names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rollup import KEY, METRICS, deduplicated

STORE_KEY = ("hvg", "dataset", "graph_type", "seed")
FOLD = "condition string, " + ", ".join(f"{m} double" for m in METRICS) + ", hvg int, dataset string, graph_type string, seed int"
_COLUMNS = (*KEY, *METRICS)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _keyed(rows: DataFrame):
    """A writer by key: rows of a key go to a few files, a large key's to more."""
    return rows.hint("rebalance", *STORE_KEY).write.partitionBy(*STORE_KEY).mode("overwrite").option("partitionOverwriteMode", "dynamic")


def write(folds: DataFrame, folder: str) -> None:
    """The keys of ``folds``, each replaced as a whole; others stay as they are. The manifest, (key, n_folds, n_conditions, pearson_mean), is
    read from what was written."""
    spark, keys = folds.sparkSession, folds.select(*STORE_KEY).distinct()
    keys = spark.createDataFrame(keys.collect(), keys.schema)  # one line a run; `folds` may come from the store
    _keyed(folds.select(*_COLUMNS)).parquet(folder)
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in STORE_KEY]
    new = read(spark, folder).alias("s").join(F.broadcast(keys).alias("k"), same, "left_semi")
    lines = new.groupBy(*STORE_KEY).agg(F.count("*").alias("n_folds"), F.countDistinct("condition").alias("n_conditions"), F.avg("pearson_r").alias("pearson_mean"))
    _keyed(lines).parquet(f"{folder}/_manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Folds of a store; a filter on key columns reads those folders alone."""
    return spark.read.schema(FOLD).parquet(folder).select(*_COLUMNS)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    kinds = "n_folds long, n_conditions long, pearson_mean double, hvg int, dataset string, graph_type string, seed int"
    return spark.read.schema(kinds).parquet(f"{folder}/_manifest").select(*STORE_KEY, "n_folds", "n_conditions", "pearson_mean")


def key_documents(folds: DataFrame) -> DataFrame:
    """(key, pearson_mean, pearson_std, spearman_mean, jaccard_mean, mse_mean, n_folds, folds), a document a key, folds in order."""
    means = [F.avg(f"{c}").alias(f"{c.split('_')[0]}_mean") for c in ("pearson_r", "spearman_rho", "jaccard", "mse")]
    each = F.array_sort(F.collect_list(F.struct("condition", *METRICS)))
    return folds.groupBy(*STORE_KEY).agg(*means, F.stddev_pop("pearson_r").alias("pearson_std"), F.count("*").cast("int").alias("n_folds"), each.alias("folds"))


def write_documents(folds: DataFrame, folder: str) -> None:
    """A JSON document a key, in the key's folder; running a key again replaces its own alone."""
    _keyed(key_documents(folds)).option("ignoreNullFields", "false").json(folder)


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """All folds that batches have brought, each once, with the number of the batch that did."""
    if not _there(spark, folder):
        return spark.createDataFrame([], f"batch long, {FOLD}").select("batch", *_COLUMNS)
    return spark.read.schema(f"{FOLD}, batch long").option("basePath", folder).parquet(folder).select("batch", *_COLUMNS)


def merge_batch(batch: DataFrame, number: int, folder: str) -> None:
    """Folds of ``batch`` whose key and condition no other batch brought; of those that repeat within it, the first by value. Only folders
    of the batch's keys are read."""
    spark, rows = batch.sparkSession, batch.select(*_COLUMNS)
    others = merged(spark, folder).where(F.col("batch") != number)
    near = others.join(rows.select(*STORE_KEY).distinct(), list(STORE_KEY), "left_semi")
    # what is known comes first and is dropped, so that one shuffle finds both what repeats and what others brought
    known = near.select(*KEY, *[F.lit(None).cast("double").alias(m) for m in METRICS], F.lit(0).alias("_new"))
    new = deduplicated(rows.withColumn("_new", F.lit(1)).unionByName(known), "_new").where("_new = 1").select(*_COLUMNS)
    new.hint("rebalance", *STORE_KEY).write.partitionBy(*STORE_KEY).mode("overwrite").parquet(f"{folder}/batch={number}")


def merging(stream: DataFrame, folder: str, checkpoint: str, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Merges what has arrived on ``stream`` into ``folder``, batch by batch, and ends. ``then`` is called after a batch is written and before
    Spark commits it."""

    def step(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, folder)
        if then:
            then(number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
