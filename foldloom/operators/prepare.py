"""From a matrix of observations to profiles per condition.

The matrix is at rest one row a cell with an array of values; the long view, (cell_id, gene_idx, x), is made by a generator
in the scan's own stage, so no shuffle comes before the first aggregate, which combines per partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .smooth import SPAN, local_quadratic

#: Names tried for the label column, and labels tried for the control.
LABEL_COLUMNS = ("gene", "condition", "perturbation", "guide_ids", "perturbations")
CONTROL_LABELS = ("ctrl", "control", "non-targeting", "NT", "")
TARGET_SUM, RAW_ABOVE, RAW_CELLS, STD_EPSILON, LEAST_CELLS = 1e4, 50.0, 10, 1e-8, 2


def long_view(wide: DataFrame, cell: str, values: str, *keep: str) -> DataFrame:
    """(cell_id, *keep, gene_idx, x); values become doubles before any arithmetic."""
    return wide.select(F.col(cell).alias("cell_id"), *keep, F.posexplode(values).alias("gene_idx", "x")).withColumn("x", F.col("x").cast("double"))


def extent(wide: DataFrame, values: str) -> DataFrame:
    """n_obs and n_vars."""
    return wide.agg(F.count("*").alias("n_obs"), F.coalesce(F.max(F.size(values)), F.lit(0)).cast("long").alias("n_vars"))


def label_column(columns: list[str], candidates: tuple[str, ...] = LABEL_COLUMNS) -> str:
    found = next((c for c in candidates if c in columns), None)
    if found is None:
        raise ValueError(f"none of {candidates} is a column")
    return found


def control_label(labels: DataFrame, label: str = "condition", order: str = "row_ord") -> DataFrame:
    """One row, ``control``: the first of CONTROL_LABELS that occurs, else the most frequent label, the first seen of equals."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in CONTROL_LABELS]), F.col(label)), F.lit(0))
    named = F.when(rank > 0, rank).otherwise(len(CONTROL_LABELS) + 1)
    seen = labels.groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return seen.orderBy(named, F.desc("n"), "first").limit(1).select(F.col(label).alias("control"))


def conditions(labels: DataFrame, control: str, label: str = "condition", order: str = "row_ord") -> DataFrame:
    """(condition, first_ord, cond_ord): labels other than the control, in order of first appearance."""
    seen = labels.where(F.col(label) != control).groupBy(F.col(label).alias("condition")).agg(F.min(order).alias("first_ord"))
    return seen.withColumn("cond_ord", F.row_number().over(Window.orderBy("first_ord", "condition")) - 1)


def raw_maximum(cells: DataFrame, n: int = RAW_CELLS, order: str = "cell_id") -> DataFrame:
    """The largest value of the first ``n`` cells by ``order``, and whether it shows raw counts."""
    first = cells.select(order).distinct().orderBy(order).limit(n)
    return cells.join(F.broadcast(first), order, "left_semi").agg(F.max("x").alias("max_x")).withColumn("is_raw", F.coalesce(F.col("max_x") > RAW_ABOVE, F.lit(False)))


def log_normalised(wide: DataFrame, values: str, target: float = TARGET_SUM) -> DataFrame:
    """``values`` scaled to a sum of ``target`` a cell, then log1p, inside the row: no shuffle. A zero sum stays as it is."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    scaled = lambda s: F.transform(values, lambda x: F.log1p(x.cast("double") / F.when(s == 0, 1.0).otherwise(s) * target))
    return wide.withColumn(values, F.element_at(F.transform(F.array(total), scaled), 1))


def gene_moments(cells: DataFrame) -> DataFrame:
    """(gene_idx, mean_x, std_x): the population's deviation plus a small constant."""
    return cells.groupBy("gene_idx").agg(F.avg("x").alias("mean_x"), (F.stddev_pop("x") + STD_EPSILON).alias("std_x"))


def z_scored(cells: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """``x`` over all cells' moments, held-out ones included. The moments are one row a gene: as many as a cell is wide."""
    moments = gene_moments(cells) if moments is None else moments
    return cells.join(F.broadcast(moments), "gene_idx").withColumn("x", (F.col("x") - F.col("mean_x")) / F.col("std_x")).drop("mean_x", "std_x")


def profiles(cells: DataFrame, least: int = LEAST_CELLS) -> DataFrame:
    """(condition, gene_idx, mean_x, n_cells) of conditions with ``least`` cells or more."""
    means = cells.groupBy("condition", "gene_idx").agg(F.avg("x").alias("mean_x"), F.count("*").alias("n_cells"))
    return means.where(F.col("n_cells") >= least)


def deltas(means: DataFrame, control: str) -> DataFrame:
    """(condition, gene_idx, delta) against the control's profile, one row a gene."""
    base = means.where(F.col("condition") == control).select("gene_idx", F.col("mean_x").alias("ctrl_x"))
    return means.where(F.col("condition") != control).join(F.broadcast(base), "gene_idx").select("condition", "gene_idx", (F.col("mean_x") - F.col("ctrl_x")).alias("delta"))


def most_variable(cells: DataFrame, n: int) -> DataFrame:
    """(gene_idx, score, rank) of the ``n`` genes with the greatest variance, the lower index first of equals."""
    scores = cells.groupBy("gene_idx").agg(F.var_samp("x").alias("score"))
    return ranked(scores, n)


def ranked(scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` greatest scores and their ranks: each task keeps its own ``n``, so the window sees no more than ``n`` rows."""
    best = scores.orderBy(F.desc("score"), "gene_idx").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "gene_idx")))


def expected_spread(moments: DataFrame, span: float = SPAN) -> DataFrame:
    """(gene_idx, mean_x, n, spread, most) from ``moments`` (gene_idx, mean_x, var_x, n): the deviation that a smooth of log variance on log
    mean expects, and the value beyond which counts are clipped. Genes that don't vary, or of a mean of zero or less, have none."""
    usable = moments.where("var_x > 0 and mean_x > 0").select("gene_idx", "mean_x", F.col("n").cast("double").alias("n"), F.log10("mean_x").alias("log_mean"), F.log10("var_x").alias("log_var"))
    fitted = local_quadratic(usable, "log_mean", "log_var", "gene_idx", span)
    spread = F.pow(F.lit(10.0), F.col("fitted") / 2)
    return fitted.select("gene_idx", "mean_x", "n", spread.alias("spread"), (F.col("mean_x") + F.sqrt("n") * spread).alias("most"))


def most_variable_standardised(cells: DataFrame, n: int, span: float = SPAN) -> DataFrame:
    """(gene_idx, score, rank): variance of values standardised by the spread that a smooth of log variance on log mean
    expects, and clipped at sqrt(cells); genes without such a spread score 0. Two aggregates over cells; see :func:`expected_spread`."""
    moments = cells.groupBy("gene_idx").agg(F.avg("x").alias("mean_x"), F.var_samp("x").alias("var_x"), F.count("*").alias("n"))
    c = F.least("x", "most") - F.col("mean_x")
    clipped = cells.join(F.broadcast(expected_spread(moments, span)), "gene_idx", "left")  # a row a gene
    squares = F.try_divide(F.sum(c * c), (F.max("n") - 1) * F.max("spread") * F.max("spread"))
    return ranked(clipped.groupBy("gene_idx").agg(F.coalesce(squares, F.lit(0.0)).alias("score")), n)


def selected(cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Cells' values of ``genes`` alone."""
    return cells.join(F.broadcast(genes.select("gene_idx")), "gene_idx", "left_semi")


def prepared(wide: DataFrame, cell: str, values: str, label: str, n_genes: int, choose: Callable[[DataFrame, int], DataFrame] = most_variable_standardised) -> DataFrame:
    """Profiles (condition, gene_idx, mean_x, n_cells) of a matrix at rest, one row a cell: the first cells tell whether it holds raw
    counts, which are then scaled and logged; the ``n_genes`` most variable genes are kept and standardised, and conditions
    of two cells or more averaged."""
    view = lambda own: long_view(own, cell, values, F.col(label).alias("condition"))
    first = wide.orderBy(cell).limit(RAW_CELLS)
    own = view(log_normalised(wide, values) if raw_maximum(view(first)).first()["is_raw"] else wide)
    return profiles(z_scored(selected(own, choose(own, n_genes))))
