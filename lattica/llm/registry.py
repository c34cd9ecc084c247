"""Queries of the training-data operators: each applies one operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, html_extract, neardup, ppm, quality, token_counts, toxicity, warc
from .common import materialize, table
from .sql import ORACLE_SQL  # noqa: F401


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose two turns are full of control strings."""
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))).alias("x"))
    probe = probe.select(F.lit(-7).cast("long").alias("conv_id"), "x.turn", "x.role", F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    windows = materialize(chat.format_windows(turns), "chat-windows")
    return chat.conversation_digests(windows).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"), min_bytes=0)
    records = warc.parse_records(warc.read_records(archive))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.SketchConfig(shingle=2, threshold=80))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    outside = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", eligible=~outside)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", outside.alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and again after three edits of each: a deletion, an insertion and a replacement."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda start, length, insert: F.struct(F.floor(start).cast("int").alias("start"), F.lit(length).alias("length"), F.lit(insert).alias("insert"))
    edits = F.array(edit(size / 4, 9, ""), edit(size / 2, 0, " edited text 42"), edit(size * 3 / 4, 5, "l'\u00e9t\u00e9"))
    edited = token_counts.count_edits(docs.withColumn("edits", edits), RANKS, public_tokenizers.PATTERN, keep_state=False)
    return edited.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.size("edits").cast("bigint").alias("n_edits"), "n_encoded")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_html_extraction, op3_warc_archive, op4_quality_rules, op5_minhash_near_dedup, op6_byte_level_bpe, op7_toxicity,
        op8_token_counts, op9_lm_scoring, op10_benchmark_decontamination,
    )
}

