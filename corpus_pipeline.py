"""Corpus pipeline: toxicity, quality rules, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All stages but the last return the columns of ``documents``; other columns are left out.

Defined results of the stages
  null text         not toxic unless the model's bias says so; rejected by the quality rules, which ask for ten words
  empty text        the same
  very long text    every stage takes it whole
  null doc_id       kept by the near-duplicate stage, judged by its text in the others
  repeated rows     judged alike, so all of them stay or all go; of rows with one id and other texts each by its own text
  ties              of near-duplicates the least doc_id stays
  empty table       no rows; without labels nothing is toxic
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, decontam, neardup, quality, toxicity
from lattica.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learned from the labels of two thirds of the ids doesn't call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", eligible=~toxicity.held_out(F.col("doc_id"), 3, 1))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    judged = quality.apply_quality_rules(docs.select(*COLUMNS)).where("kept")
    return judged.withColumn("text", F.col("cleaned_text")).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates by five-word shingles, the document of least id."""
    found = neardup.near_duplicates(docs, neardup.SketchConfig(shingle=5, threshold=80))
    # Of rows with one id and different texts, each is judged by its own text.
    dropped = found.where(~F.col("kept")).select("doc_id", "mark").distinct()
    marked = docs.select(*COLUMNS).withColumn("mark", F.xxhash64("text"))
    return marked.join(dropped, ["doc_id", "mark"], "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    found = decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes that they decode to."""
    coded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality rules", apply_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode_tokens),
]

#: The toxicity model and the tokenizer can't be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the result is the last stage's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
