"""A corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foldloom.llm import decontaminate, ngram_join, packing, quality_rules, secret_scan
from foldloom.llm.shared import dropped, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior, or the base rule, rejects go: null and empty texts among them. Rows that repeat are judged
    alike; columns named like measures stay as they are; an empty table stays empty."""
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of Jaccard 0.85 over word 4-grams connect, the document with the least doc_id stays, with all rows
    that repeat it. Texts without words and rows without a doc_id are linked with nothing and stay."""
    groups = ngram_join.ngram_join(docs)
    others = groups.where("component_id <> doc_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 of a benchmark item's word 5-grams go. Null and short texts, and all where no item has five
    words, stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are taken out of the texts; n_chars follows, where a text changes. Null texts and counts stay null."""
    return secret_scan.redacted(docs, length="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text is its end id alone, rows without a doc_id are packed too."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("pack", pack)]

#: Posterior, tokenizer and randomness tests have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(before)
    return docs
