"""One step of message passing over a graph, as joins and aggregates; features are (node, k, x) rows.

For graphs of any number of nodes; :mod:`models` trains on graphs of a fold's few hundred features inside a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def masked(features: DataFrame, masks: DataFrame) -> DataFrame:
    """Hard or graded masks: ``masks`` (node, dose), dose 0 for a knocked out node; nodes that aren't listed stay."""
    return features.join(masks, "node", "left").withColumn("x", F.col("x") * F.coalesce("dose", F.lit(1.0))).drop("dose")


def projected(features: DataFrame, weights: DataFrame) -> DataFrame:
    """``weights`` (k, j, w): a linear map. The table of weights is as large as the model's width squared."""
    return features.join(F.broadcast(weights), "k").groupBy("node", "j").agg(F.sum(F.col("x") * F.col("w")).alias("x")).withColumnRenamed("j", "k")


def attention(edges: DataFrame, scores: DataFrame, slope: float = 0.2) -> DataFrame:
    """(src, dst, alpha): the softmax over each dst's incoming edges of leaky(s_src + s_dst). ``scores``: (node, s_src, s_dst).
    The maximum and the sum are aggregates by dst, which combine before the shuffle; no group is held."""
    raw = edges.join(scores.select(F.col("node").alias("src"), "s_src"), "src").join(scores.select(F.col("node").alias("dst"), "s_dst"), "dst")
    e = F.col("s_src") + F.col("s_dst")
    raw = raw.select("src", "dst", F.when(e > 0, e).otherwise(slope * e).alias("e"))
    most = raw.groupBy("dst").agg(F.max("e").alias("m"))
    weight = raw.join(most, "dst").select("src", "dst", F.exp(F.col("e") - F.col("m")).alias("w"))
    return weight.join(weight.groupBy("dst").agg(F.sum("w").alias("s")), "dst").select("src", "dst", (F.col("w") / F.col("s")).alias("alpha"))


def gathered(features: DataFrame, weighted: DataFrame, weight: str = "alpha") -> DataFrame:
    """(node, k, x): each node's weighted sum of what its incoming edges bring."""
    sent = weighted.join(features.select(F.col("node").alias("src"), "k", "x"), "src")
    return sent.groupBy(F.col("dst").alias("node"), "k").agg(F.sum(F.col(weight) * F.col("x")).alias("x"))


def degree_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, alpha): 1 / sqrt(in-degree of src * in-degree of dst), loops being part of ``edges``."""
    degree = edges.groupBy("dst").agg(F.count("*").alias("d"))
    both = edges.join(degree, "dst").join(degree.select(F.col("dst").alias("src"), F.col("d").alias("d_src")), "src", "left")
    return both.select("src", "dst", (1 / F.sqrt(F.col("d") * F.coalesce("d_src", F.lit(1)).cast("double"))).alias("alpha"))


def normalised(features: DataFrame, epsilon: float = 1e-5) -> DataFrame:
    """Each k to mean 0 and variance 1 over the nodes."""
    own = features.groupBy("k").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    return features.join(F.broadcast(own), "k").select("node", "k", ((F.col("x") - F.col("m")) / F.sqrt(F.col("v") + epsilon)).alias("x"))


def elu(features: DataFrame) -> DataFrame:
    return features.withColumn("x", F.when(F.col("x") > 0, F.col("x")).otherwise(F.expm1("x")))
