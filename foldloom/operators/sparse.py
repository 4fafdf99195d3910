"""The preparation over sparse cells: a cell is a row with the positions and the values of what isn't zero, and its zeros never become
rows. What they add to a mean, a deviation or a score follows from how many there are.

``indices`` and ``values`` are arrays of one length; positions not named are zero, and a cell names none twice. A value that is stored as
zero, or null, counts as not named; rows whose arrays are null or differ in length aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prepare import LEAST_CELLS, RAW_ABOVE, RAW_CELLS, STD_EPSILON, expected_spread, log_normalised, ranked
from .smooth import SPAN


def sparse(wide: DataFrame, values: str) -> DataFrame:
    """``values`` dense becomes ``indices`` (from 0) and ``values``, inside the row."""
    at = F.filter(F.transform(values, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != 0)
    return wide.withColumn("_e", at).withColumns({"indices": F.transform("_e", lambda e: e["i"]), values: F.transform("_e", lambda e: e["x"])}).drop("_e")


def whole(wide: DataFrame, indices: str, values: str) -> DataFrame:
    return wide.where(F.size(indices) == F.size(values))


def nonzeros(wide: DataFrame, cell: str, indices: str, values: str, *keep: str | Column) -> DataFrame:
    """(cell_id, *keep, gene_idx, x): a row for each value that isn't zero, made in the scan's stage."""
    both = F.explode(F.arrays_zip(F.col(indices).alias("i"), F.col(values).alias("x"))).alias("e")
    own = whole(wide, indices, values).select(F.col(cell).alias("cell_id"), *keep, both)
    names = [c for c in own.columns if c != "e"]
    return own.select(*names, F.col("e.i").cast("int").alias("gene_idx"), F.col("e.x").cast("double").alias("x")).where("x <> 0")


def extent(wide: DataFrame, indices: str, values: str) -> tuple[int, int]:
    """How many cells there are, and one more than the greatest position that any names."""
    n, last = whole(wide, indices, values).agg(F.count("*"), F.max(F.array_max(indices))).first()
    return n, 0 if last is None else last + 1


def raw_maximum(wide: DataFrame, cell: str, indices: str, values: str, n_genes: int, n: int = RAW_CELLS) -> DataFrame:
    """The largest value of the first ``n`` cells, zeros among them, and whether it shows raw counts."""
    first = whole(wide, indices, values).orderBy(cell).limit(n)
    zero = F.when(F.size(indices) < n_genes, 0.0)
    most = F.max(F.greatest(F.array_max(F.transform(values, lambda x: x.cast("double"))), zero)).alias("max_x")
    return first.agg(most).withColumn("is_raw", F.coalesce(F.col("max_x") > RAW_ABOVE, F.lit(False)))


def gene_sums(rows: DataFrame) -> DataFrame:
    """(gene_idx, k, m, v): how many values aren't zero, their mean and population variance."""
    return rows.groupBy("gene_idx").agg(F.count("*").alias("k"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))


def moments(rows: DataFrame, n_cells: int, n_genes: int) -> DataFrame:
    """(gene_idx, mean_x, std_x, var_x) of every gene over all cells: k values with mean m and variance v meet n - k zeros. The deviation is
    the population's plus a small constant, the variance the sample's."""
    k, n = F.col("k"), F.lit(float(n_cells))
    squares = k * F.col("v") + k * (n - k) / n * F.col("m") * F.col("m")
    own = gene_sums(rows).select("gene_idx", (k * F.col("m") / n).alias("mean_x"), squares.alias("s"))
    all_ = rows.sparkSession.range(n_genes).select(F.col("id").cast("int").alias("gene_idx")).join(own, "gene_idx", "left").na.fill(0.0, ["mean_x", "s"])
    return all_.select("gene_idx", "mean_x", (F.sqrt(F.col("s") / n) + STD_EPSILON).alias("std_x"), F.try_divide(F.col("s"), n - 1).alias("var_x"))


def most_variable(rows: DataFrame, n_cells: int, n_genes: int, n: int) -> DataFrame:
    """(gene_idx, score, rank) of the ``n`` genes with the greatest variance, the lower index first of equals."""
    return ranked(moments(rows, n_cells, n_genes).select("gene_idx", F.col("var_x").alias("score")), n)


def most_variable_standardised(rows: DataFrame, n_cells: int, n_genes: int, n: int, span: float = SPAN) -> DataFrame:
    """(gene_idx, score, rank), as :func:`~foldloom.operators.prepare.most_variable_standardised` has them from dense cells. A zero is never
    clipped, so zeros add their number times the squared mean."""
    own = moments(rows, n_cells, n_genes)
    fitted = F.broadcast(expected_spread(own.select("gene_idx", "mean_x", "var_x", F.lit(n_cells).alias("n")), span))  # a row a gene
    c = F.least("x", "most") - F.col("mean_x")
    sums = rows.join(fitted, "gene_idx").groupBy("gene_idx").agg(F.sum(c * c).alias("s"), F.count("*").alias("k"))
    squares = F.col("s") + (n_cells - F.col("k")) * F.col("mean_x") * F.col("mean_x")
    scored = sums.join(fitted, "gene_idx").select("gene_idx", F.try_divide(squares, (F.col("n") - 1) * F.col("spread") * F.col("spread")).alias("score"))
    return ranked(own.select("gene_idx").join(scored, "gene_idx", "left").na.fill(0.0, ["score"]), n)


def profiles(rows: DataFrame, sizes: DataFrame, of_genes: DataFrame, least: int = LEAST_CELLS) -> DataFrame:
    """(condition, gene_idx, mean_x, n_cells): mean z-scores of conditions with ``least`` cells or more. ``sizes``: (condition, n_cells), cells
    without a value among them; ``of_genes``: (gene_idx, mean_x, std_x). The mean of z-scores is the z-score of the mean, so sums of
    values are all that is taken from cells; the grid is as long as the result."""
    sums = rows.join(F.broadcast(of_genes.select("gene_idx")), "gene_idx", "left_semi").groupBy("condition", "gene_idx").agg(F.sum("x").alias("s"))
    grid = sizes.where(F.col("n_cells") >= least).crossJoin(F.broadcast(of_genes))  # a row a gene
    z = (F.coalesce("s", F.lit(0.0)) / F.col("n_cells") - F.col("mean_x")) / F.col("std_x")
    return grid.join(sums, ["condition", "gene_idx"], "left").select("condition", "gene_idx", z.alias("mean_x"), "n_cells")


def prepared(wide: DataFrame, cell: str, indices: str, values: str, label: str, n_top: int, n_genes: int | None = None, choose=most_variable) -> DataFrame:
    """Profiles (condition, gene_idx, mean_x, n_cells) from sparse cells, as :func:`~foldloom.operators.prepare.prepared` has them from dense
    ones; ``choose`` is :func:`most_variable` or :func:`most_variable_standardised`. ``n_genes``: positions of a cell; by default as many as any cell names."""
    n_cells, seen = extent(wide, indices, values)
    n_genes = seen if n_genes is None else n_genes
    own = whole(wide, indices, values)
    raw = raw_maximum(own, cell, indices, values, n_genes).first()["is_raw"]
    rows = nonzeros(log_normalised(own, values) if raw else own, cell, indices, values, F.col(label).alias("condition"))
    best = choose(rows, n_cells, n_genes, n_top).select("gene_idx")
    top = moments(rows, n_cells, n_genes).join(F.broadcast(best), "gene_idx", "left_semi").select("gene_idx", "mean_x", "std_x")
    return profiles(rows, own.groupBy(F.col(label).alias("condition")).agg(F.count("*").alias("n_cells")), top)
