"""The experiment's grid as data. Its dimensions are short lists, so the products are small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOLDS, STEP = 50, 10


def dimension(spark: SparkSession, name: str, values: Sequence) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def grid(*dimensions: DataFrame) -> DataFrame:
    out = dimensions[0]
    for d in dimensions[1:]:
        out = out.crossJoin(F.broadcast(d))
    return out


def chunked(tasks: DataFrame, folds: int = FOLDS, step: int = STEP) -> DataFrame:
    """A row for each stretch [fold_start, fold_end) of ``step`` folds."""
    start = F.explode(F.sequence(F.lit(0), F.lit(folds - 1), F.lit(step)))
    return tasks.withColumn("fold_start", start).withColumn("fold_end", F.least(F.col("fold_start") + step, F.lit(folds)))


def missing(tasks: DataFrame, done: DataFrame, by: list[str], least: Column | int = FOLDS) -> DataFrame:
    """Tasks without ``least`` folds; ``done``: by, n_folds. A key's greatest count decides."""
    enough = done.groupBy(*by).agg(F.max("n_folds").alias("n_folds")).where(F.col("n_folds") >= least).select(*by)
    return tasks.join(enough, by, "left_anti")


def needed(n_conditions: Column, folds: int = FOLDS) -> Column:
    """Folds that a dataset can have: it may hold fewer conditions than a full run asks for."""
    return F.least(n_conditions, F.lit(folds))


def numbered(tasks: DataFrame, order: list[str]) -> DataFrame:
    """``idx`` from 0, and the machine and device that take it, four to a machine."""
    idx = F.row_number().over(Window.orderBy(*order)) - 1
    return tasks.withColumn("idx", idx).withColumns({"array_id": F.floor(F.col("idx") / 4).cast("long"), "gpu": F.pmod("idx", F.lit(4))})


def halves(tasks: DataFrame, order: list[str]) -> DataFrame:
    """``site`` 0 for the first floor(n / 2) tasks, else 1."""
    n = F.count("*").over(Window.partitionBy())
    return numbered(tasks, order).withColumn("site", F.when(F.col("idx") < F.floor(n / 2), 0).otherwise(1)).drop("array_id", "gpu")


def fold_tag(seed: str, start: str, end: str) -> Column:
    """The part of a file's name for a slice of folds, an open one ending where a whole run does; empty for a whole run."""
    c = F.col
    part = F.concat(F.lit("f"), c(start).cast("string"), F.lit("-"), F.coalesce(c(end), F.lit(FOLDS)).cast("string"))
    named = F.when(c(seed).isNotNull(), F.concat(F.lit("__s"), c(seed).cast("string"), part)).otherwise(F.concat(F.lit("__"), part))
    return F.when((c(start) > 0) | c(end).isNotNull(), named).otherwise(F.lit(""))


def lines(tasks: DataFrame, columns: list[str]) -> DataFrame:
    """Tasks as lines of text, parted by blanks."""
    return tasks.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value"))


def parsed(text: DataFrame) -> DataFrame:
    """(dataset, graph, hvg, seed, fold_start, fold_end) of task lines; folds are null where a line has none; short lines go."""
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).cast("int")
    return text.where(F.size(parts) >= 4).select(F.get(parts, F.lit(0)).alias("dataset"), F.get(parts, F.lit(1)).alias("graph"), number(2).alias("hvg"), number(3).alias("seed"), number(4).alias("fold_start"), number(5).alias("fold_end"))
