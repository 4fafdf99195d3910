"""Posting lists: which nodes a term annotates, in blocks (term, block, total, nodes) of at most ``size`` sorted nodes, so that a term of
any breadth is many rows and no row, task or group holds a whole broad term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def blocks(annotations: DataFrame, size: int = BLOCK) -> DataFrame:
    """(term, block, total, nodes) of (node, term) rows, repeats counted once and nulls left out. A term of ``size`` nodes or fewer is block 0;
    a broader one has a block for each stretch of ``size`` node numbers that it occurs in, in the order of nodes. Rows meet by term and
    stretch, so a broad term is dealt over tasks; what is then joined by term is a row a stretch."""
    own = annotations.where("node is not null and term is not null").select("term", "node", F.floor(F.col("node") / size).alias("block"))
    fine = own.groupBy("term", "block").agg(F.collect_set("node").alias("nodes"))
    totals = fine.groupBy("term").agg(F.sum(F.size("nodes")).alias("total"))
    placed = fine.join(totals, "term").withColumn("block", F.when(F.col("total") <= size, F.lit(0).cast("long")).otherwise(F.col("block")))
    return placed.groupBy("term", "block", "total").agg(F.array_sort(F.flatten(F.collect_list("nodes"))).alias("nodes"))


def pairs(lists: DataFrame, broadest: int, size: int = BLOCK) -> DataFrame:
    """(src, dst), src < dst, once each: nodes that a term of ``broadest`` nodes or fewer annotates both. ``lists`` has blocks of ``size``. A list
    of one block meets itself inside its row; blocks of broader terms meet by term, each two once."""
    kept = lists.where(F.col("total") <= broadest)
    inside = kept.select("nodes", F.explode("nodes").alias("src")).select("src", F.explode(F.filter("nodes", lambda n: n > F.col("src"))).alias("dst"))
    if broadest <= size:
        return inside.distinct()
    split = kept.where(F.col("total") > size)
    later = split.select("term", F.col("block").alias("_block"), F.col("nodes").alias("_nodes"))
    across = split.join(later, "term").where(F.col("block") < F.col("_block")).select("_nodes", F.explode("nodes").alias("src")).select("src", F.explode("_nodes").alias("dst"))
    return inside.union(across).distinct()


def breadth(lists: DataFrame) -> DataFrame:
    """(term, n_genes, n_blocks)."""
    return lists.groupBy("term").agg(F.max("total").alias("n_genes"), F.count("*").alias("n_blocks"))
