"""A configured run: datasets x scales x graphs x seeds, one stored result a key.

A dataset is prepared once a scale and its graphs are built on the features chosen there; a graph that can't be used is skipped. All folds of
(dataset, scale) are one plan: a fold's prediction comes from sums over the other conditions, so no fold is a task's own. Keys that the
store has in full are left alone, so a run that was cut off goes on where it stopped; the loops are over the configuration alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, graphs, metrics, prepare, propagation
from ..session import new_folder
from ..sources import store
from .grid import FOLDS, needed

#: The key of a run without a graph, which is never skipped.
NO_GRAPH = "no_graph"
#: Edges (src, dst) over positions from 0, of the matrix of chosen features and of their numbers in the whole one.
Builder = Callable[[DataFrame, Sequence[int]], DataFrame]
#: (condition, gene_idx, delta_true, delta_pred) of (condition, gene_idx, delta), edges or None, and a seed.
Predictor = Callable[[DataFrame, DataFrame | None, int], DataFrame]


@dataclass(frozen=True)
class Dataset:
    """A matrix at rest, one row a cell, and builders of its graphs by name."""

    wide: DataFrame
    cell: str
    values: str
    label: str
    graphs: Mapping[str, Builder] = field(default_factory=dict)


def smoothed_mean(deltas: DataFrame, edges: DataFrame | None, seed: int) -> DataFrame:
    """The mean of the other conditions' changes; with a graph, its sum over incoming edges by degree weights. The seed changes nothing."""
    own = folds.mean_of_others(deltas)
    if edges is None:
        return own
    sent = own.select("condition", F.col("gene_idx").alias("src"), "delta_pred").join(propagation.degree_weights(edges), "src")
    got = sent.groupBy("condition", F.col("dst").alias("gene_idx")).agg(F.sum(F.col("alpha") * F.col("delta_pred")).alias("delta_pred"))
    return own.drop("delta_pred").join(got, ["condition", "gene_idx"], "left").na.fill(0.0, ["delta_pred"])


def positions(spark: SparkSession, chosen: Sequence[int]) -> DataFrame:
    """(node, position) of chosen features."""
    return spark.createDataFrame([(int(g), i) for i, g in enumerate(chosen)], "node int, position int")


def narrowed(dataset: Dataset, scale: int, choose) -> tuple[DataFrame, list[int]]:
    """The matrix with the ``scale`` most variable features alone, counts scaled and logged first, and their numbers in order."""
    view = lambda own: prepare.long_view(own, dataset.cell, dataset.values)
    first = dataset.wide.orderBy(dataset.cell).limit(prepare.RAW_CELLS)
    raw = prepare.raw_maximum(view(first)).first()["is_raw"]
    own = prepare.log_normalised(dataset.wide, dataset.values) if raw else dataset.wide
    chosen = sorted(r["gene_idx"] for r in choose(view(own), scale).select("gene_idx").collect())  # ``scale`` numbers at most
    at = F.lit(chosen) if chosen else F.array().cast("array<int>")
    return own.withColumn(dataset.values, F.transform(at, lambda i: F.get(F.col(dataset.values), i))), chosen


def changes(small: DataFrame, dataset: Dataset, most: int) -> DataFrame:
    """(condition, gene_idx, delta, held) of conditions of two cells or more; the first ``most`` by appearance are held out."""
    label = small.select(F.col(dataset.label).alias("condition"), F.col(dataset.cell).alias("row_ord"))
    control = prepare.control_label(label).first()
    if control is None:
        return small.sparkSession.createDataFrame([], "condition string, gene_idx int, delta double, held boolean")
    cells = prepare.long_view(small, dataset.cell, dataset.values, F.col(dataset.label).alias("condition"))
    own = prepare.deltas(prepare.profiles(prepare.z_scored(cells)), control["control"])
    valid = label.join(own.select("condition").distinct(), "condition", "left_semi")
    held = folds.slices(prepare.conditions(valid, control["control"]), most).select("condition", F.lit(True).alias("held"))
    return own.join(F.broadcast(held), "condition", "left").na.fill(False, ["held"])  # ``most`` rows


def complete(spark: SparkSession, folder: str, dataset: str, scale: int, n_folds: int) -> set[tuple[str, int]]:
    """(graph, seed) of a (dataset, scale) whose folds the store has in full."""
    if not store._there(spark, f"{folder}/_manifest"):
        return set()
    own = store.manifest(spark, folder).where((F.col("dataset") == dataset) & (F.col("hvg") == scale) & (F.col("n_conditions") >= n_folds))
    return {(r["graph_type"], r["seed"]) for r in own.select("graph_type", "seed").collect()}


def run(datasets: Mapping[str, Dataset], scales: Sequence[int], graph_types: Sequence[str], seeds: Sequence[int], folder: str, predict: Predictor = smoothed_mean, most: int = FOLDS, choose=prepare.most_variable_standardised) -> dict[tuple[str, int], list[str]]:
    """Runs what the store at ``folder`` lacks and returns, by (dataset, scale), the graphs that were skipped: named in ``graph_types`` but not
    built by the dataset, or without an edge that isn't a loop. Up to ``most`` conditions are held out, the first by appearance. A (dataset,
    scale) without conditions stores nothing."""
    skipped: dict[tuple[str, int], list[str]] = {}
    for name, dataset in datasets.items():
        spark = dataset.wide.sparkSession
        for scale in scales:
            small, chosen = narrowed(dataset, scale, choose)
            at = new_folder(spark, "changes")
            changes(small, dataset, most).write.parquet(at)
            deltas = spark.read.schema("condition string, gene_idx int, delta double, held boolean").parquet(at)
            there = deltas.agg(F.countDistinct("condition").alias("n")).select(needed(F.col("n"), most).alias("n")).first()["n"]
            done, parts, out = complete(spark, folder, name, scale, there), [], skipped.setdefault((name, scale), [])
            for graph in graph_types:
                todo = [s for s in seeds if (graph, s) not in done]
                edges = None
                if graph != NO_GRAPH and todo:
                    if graph not in dataset.graphs:
                        out.append(graph)
                        continue
                    kept = new_folder(spark, "edges")
                    dataset.graphs[graph](small, chosen).select(F.col("src").cast("int"), F.col("dst").cast("int")).write.parquet(kept)
                    edges = spark.read.schema("src int, dst int").parquet(kept)
                    if not graphs.available(edges).first()["available"]:
                        out.append(graph)
                        continue
                for seed in todo:
                    pairs = predict(deltas.drop("held"), edges, seed).join(F.broadcast(deltas.where("held").select("condition").distinct()), "condition", "left_semi")
                    parts.append(pairs.select(F.lit(graph).alias("graph_type"), F.lit(seed).alias("seed"), "condition", "gene_idx", "delta_true", "delta_pred"))
            if parts and there:
                whole = parts[0]
                for p in parts[1:]:
                    whole = whole.union(p)
                found = metrics.fold_metrics(whole, "graph_type", "seed", "condition")
                store.write(found.select(F.lit(name).alias("dataset"), F.lit(scale).alias("hvg"), "*"), folder)
    return skipped
