"""Leave one condition out: masks, folds, and predictions by a pluggable model."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Estimator(Protocol):
    """What trains on known conditions and predicts one that is held out."""

    def predict(self, control: np.ndarray, masks: np.ndarray, profiles: np.ndarray, mask: np.ndarray, edges: np.ndarray, seed: int) -> np.ndarray: ...


def masks(conditions: DataFrame, genes: DataFrame) -> DataFrame:
    """(condition, genes): the sorted gene_idx that a condition's name lists, parted by plus signs, blanks around them
    dropped; null where none is known. ``genes``: (gene, gene_idx)."""
    token = F.explode(F.split("condition", r"\+")).alias("gene")
    listed = conditions.select("condition").distinct().select("condition", token).withColumn("gene", F.trim("gene"))
    found = listed.join(genes, "gene", "left").groupBy("condition").agg(F.array_sort(F.collect_set("gene_idx")).alias("genes"))
    return found.withColumn("genes", F.when(F.size("genes") > 0, F.col("genes")))


def slices(conditions: DataFrame, most: int, start: int = 0, end: int | None = None) -> DataFrame:
    """Held-out conditions: those at cond_ord in [start, end), cut at the first ``most``."""
    return conditions.where((F.col("cond_ord") >= start) & (F.col("cond_ord") < (most if end is None else min(end, most))))


def training_sets(held: DataFrame, conditions: DataFrame) -> DataFrame:
    """(fold, condition): each fold's training conditions, all but its own. The fold list is at most as long as that of conditions."""
    return F.broadcast(held.select(F.col("condition").alias("fold"))).join(conditions.select("condition"), F.col("fold") != F.col("condition"))


def mean_of_others(deltas: DataFrame) -> DataFrame:
    """(condition, gene_idx, delta_true, delta_pred): the mean of the other conditions' changes, from sums a gene, so that no
    pair of conditions is formed."""
    w = Window.partitionBy("gene_idx")
    others = F.try_divide(F.sum("delta").over(w) - F.col("delta"), F.count("*").over(w) - 1)
    return deltas.select("condition", "gene_idx", F.col("delta").alias("delta_true"), others.alias("delta_pred"))


def fold_seed(seed: int, condition: str) -> int:
    """The same for a fold whatever slice it runs in."""
    import zlib

    return zlib.crc32(f"{seed}:{condition}".encode())


def run_lopo(tasks: DataFrame, bundle: DataFrame, estimator: Estimator) -> DataFrame:
    """(graph_type, seed, condition, gene_idx, delta_true, delta_pred). ``tasks``: (graph_type, seed, condition), one fold a row;
    ``bundle``: (graph_type, kind, a, b, x): ``edge`` rows (src, dst), ``profile`` rows (condition's number, gene, mean), with
    -1 as the control's number, and ``mask`` rows (condition's number, gene), a list of features' size, read by each fold's group.

    A fold is one group: folds train beside each other, and a lost one is trained again by itself, with its own seed.
    """

    def train(task: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = {k: own[own["kind"] == k] for k in ("edge", "profile", "mask")}
        n = int(rows["profile"]["b"].max()) + 1 if len(rows["profile"]) else 0
        out = []
        numbers = sorted(int(x) for x in rows["profile"]["a"].unique() if x >= 0)
        matrix = np.zeros((len(numbers) + 1, n))
        row_of = {c: i for i, c in enumerate([*numbers, -1])}
        matrix[rows["profile"]["a"].map(row_of), rows["profile"]["b"]] = rows["profile"]["x"]
        hit = np.zeros((len(numbers) + 1, n), dtype=bool)
        if len(rows["mask"]):
            hit[rows["mask"]["a"].map(row_of), rows["mask"]["b"]] = True
        edges = rows["edge"][["a", "b"]].to_numpy(dtype=int)
        for t in task.itertuples():
            me = row_of[int(t.number)]
            others = [i for i in range(len(numbers)) if i != me]
            predicted = estimator.predict(matrix[-1], hit[others], matrix[others], hit[me], edges, fold_seed(int(t.seed), str(t.condition)))
            out.append(pd.DataFrame({"graph_type": t.graph_type, "seed": t.seed, "condition": t.condition, "gene_idx": np.arange(n, dtype=np.int32), "delta_true": matrix[me] - matrix[-1], "delta_pred": predicted - matrix[-1]}))
        return pd.concat(out) if out else pd.DataFrame({"graph_type": [], "seed": [], "condition": [], "gene_idx": [], "delta_true": [], "delta_pred": []})

    each = bundle.join(F.broadcast(tasks.select(F.col("graph_type").alias("g"), F.col("seed").alias("s"), F.col("condition").alias("c"))), F.col("graph_type") == F.col("g"))
    each = each.select("g", "s", "c", "kind", "a", "b", "x")
    return tasks.groupBy("graph_type", "seed", "condition").cogroup(each.groupBy("g", "s", "c")).applyInPandas(train, "graph_type string, seed int, condition string, gene_idx int, delta_true double, delta_pred double")
