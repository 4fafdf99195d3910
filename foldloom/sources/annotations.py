"""Annotation text (GAF), lookup tables and the matrix's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """Text lines, compressed or not."""
    return parse_gaf(spark.read.text(path))


def parse_gaf(text: DataFrame) -> DataFrame:
    """(gene, go_id, aspect) of lines that aren't comments and have 15 fields or more."""
    fields = F.split(F.trim("value"), "\t")
    rows = text.where(~F.col("value").startswith("!")).where(F.size(fields) >= 15)
    return rows.select(F.get(fields, F.lit(2)).alias("gene"), F.get(fields, F.lit(4)).alias("go_id"), F.get(fields, F.lit(8)).alias("aspect"))


def annotations(gaf: DataFrame, genes: DataFrame, aspect: str = "P") -> DataFrame:
    """(node, term): distinct pairs of one aspect whose gene is asked for. ``genes``: (gene, gene_idx)."""
    return gaf.where(F.col("aspect") == aspect).join(genes, "gene").select(F.col("gene_idx").alias("node"), F.col("go_id").alias("term")).distinct()


def id_map(entries: DataFrame) -> DataFrame:
    """(gene, string_id) of lookup entries that have both; batches that failed are simply not there."""
    return entries.where("queryItem is not null and stringId is not null").select(F.col("queryItem").alias("gene"), F.col("stringId").alias("string_id"))


def network(links: DataFrame, least: int = 400) -> DataFrame:
    """(id_a, id_b, score) of links that score ``least`` or more, once each."""
    return links.where(F.col("score") >= least).select("id_a", "id_b", "score").distinct()
