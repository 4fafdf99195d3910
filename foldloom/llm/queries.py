"""The numbered queries, each applied with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_trees, decontaminate, language_id, ngram_join, packing, posting_lists, quality_rules, secret_scan, source_audit, token_store, toxicity, vector_codes, warc
from .oracles import ORACLES
from .shared import new_path, table


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), ["doc_id"])


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), language_id.held_out(F.col("doc_id"))
    found = language_id.predicted(docs, language_id.fit(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    chats = chat_trees.formatted(chat_trees.chain(rows)).withColumn("turns", chat_trees.turns_of(F.col("formatted")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = chat_trees.under_mask(F.col("formatted"), F.col("loss_spans"))
    size = lambda c: F.length(c).cast("long")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), size(masked).alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), size("formatted").alias("formatted_chars"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    whole = F.col("record_type") == "response"
    return warc.read(spark, folder).select(
        page("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), language_id.held_out(F.col("doc_id"))
    found = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~out))
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.withColumn("secrets", secret_scan.spans_text(F.col("secrets"))).withColumnRenamed("secrets", "spans")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "ids")
    token_store.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read(spark, folder)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audited(table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return posting_lists.nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_chat_format, op3_decontamination, op4_warc, op5_toxicity, op6_packing, op7_secret_scan, op8_ngram_join, op9_token_store, op10_quality_rules, op11_source_audit, op12_nearest_neighbours, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
