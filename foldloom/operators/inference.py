"""Predictions of a graph convolution with given weights, all layers as one plan.

A node is a row with its hidden values as an array; linear maps, normalisation and activation stay inside the row, as trained
statistics are given. Edges are written once, in buckets by their source. In a layer, features meet the edges that lie in their own
partition, and sums by target go through the layer's one exchange, combined before it; they come out dealt by node, as the next layer
needs them. So edges are never moved again, and what a layer moves is at most a row of sums a target and task.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_folder
from .propagation import degree_weights

EPSILON = 1e-5


class Linear(NamedTuple):
    """x @ w + b; ``w`` has a row for each value that comes in."""

    w: np.ndarray
    b: np.ndarray


class Norm(NamedTuple):
    """(x - mean) / sqrt(var + EPSILON) * scale + shift, with what training has left."""

    mean: np.ndarray
    var: np.ndarray
    scale: np.ndarray
    shift: np.ndarray


class Model(NamedTuple):
    """``first`` maps a node's one value to hidden ones, which ``layer_scale`` and ``layer_shift`` follow; ``residual`` maps these past the
    layers; each of ``layers`` is a map and a norm; ``head`` maps to one value."""

    first: Linear
    layer_scale: np.ndarray
    layer_shift: np.ndarray
    residual: Linear
    layers: list[tuple[Linear, Norm]]
    head: Linear


def _elu(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, np.expm1(np.minimum(x, 0)))


def bucketed(edges: DataFrame) -> DataFrame:
    """(src, dst, alpha) with weights by degree, in as many buckets by ``src`` as exchanges have partitions, each sorted."""
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"edges_{uuid.uuid4().hex}"
    weighted = degree_weights(edges).repartition(n, "src")  # one file a bucket
    weighted.write.option("path", new_folder(spark, "edges")).bucketBy(n, "src").sortBy("src").saveAsTable(name)
    return spark.table(name)


def embedded(values: DataFrame, model: Model, doses: DataFrame | None = None) -> DataFrame:
    """(node, v) from (node, x): the first map, normalised over a node's own hidden values, activated, and times the node's dose from
    ``doses`` (node, dose): 0 for one that is knocked out; nodes that aren't listed keep their values."""

    def first(x: np.ndarray) -> np.ndarray:
        h = x @ model.first.w + model.first.b
        h = (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + EPSILON)
        return _elu(h * model.layer_scale + model.layer_shift)

    own = values.select("node", F.col("x").cast("double").alias("x"))
    own = own.withColumn("dose", F.lit(1.0)) if doses is None else own.join(doses.select("node", F.col("dose").cast("double").alias("dose")), "node", "left").na.fill(1.0, ["dose"])

    @F.pandas_udf("array<double>")
    def hidden(x: pd.Series, dose: pd.Series) -> pd.Series:
        return pd.Series(list(first(x.to_numpy()[:, None]) * dose.to_numpy()[:, None]))

    return own.select("node", hidden("x", "dose").alias("v"))


def summed(features: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """(node, v): for each target the weighted sum of its sources' arrays, of ``width`` values."""
    sent = edges.join(features.select(F.col("node").alias("src"), "v").hint("merge"), "src")
    sums = sent.groupBy("dst").agg(*[F.sum(F.col("alpha") * F.get("v", F.lit(i))).alias(f"_{i}") for i in range(width)])
    return sums.select(F.col("dst").alias("node"), F.array(*[f"_{i}" for i in range(width)]).alias("v"))


def _folded(linear: Linear, norm: Norm) -> Linear:
    """A map and the norm after it as one map."""
    scale = norm.scale / np.sqrt(norm.var + EPSILON)
    return Linear(linear.w * scale, (linear.b - norm.mean) * scale + norm.shift)


def _mapped(v: Column, linear: Linear) -> Column:
    """The map of an array, as functions of arrays: a Python function between two layers would hide from Spark how rows are dealt."""
    w, b = F.lit(linear.w.T.tolist()), F.lit(linear.b.tolist())
    one = lambda own: F.zip_with(w, b, lambda row, add: F.aggregate(F.zip_with(own, row, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) + add)
    return F.element_at(F.transform(F.array(v), one), 1)  # v once


def predicted(features: DataFrame, edges: DataFrame, model: Model) -> DataFrame:
    """(node, y) from (node, v) and edges of :func:`bucketed`, loops among them: for each layer the sum over incoming edges, its map and
    norm, and the activation, which the residual joins in the last layer; then the head. Nodes that no edge comes to have no row."""
    n = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    elu = lambda v: F.transform(v, lambda x: F.when(x > 0, x).otherwise(F.expm1(x)))
    start = features.repartition(n, "node")
    width, x = len(model.first.b), start
    for linear, norm in model.layers[:-1]:
        x = summed(x, edges, width).select("node", elu(_mapped(F.col("v"), _folded(linear, norm))).alias("v"))
        width = len(linear.b)
    both = summed(x, edges, width).hint("merge").join(start.select("node", F.col("v").alias("own")), "node")
    last = elu(F.zip_with(_mapped(F.col("v"), _folded(*model.layers[-1])), _mapped(F.col("own"), model.residual), lambda x, y: x + y))
    return both.select("node", F.get(_mapped(last, model.head), F.lit(0)).alias("y"))
