"""Corpus pipeline: five stages from raw documents to tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result to the shared folder and reads it again, so a
lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.bpe import digest_table
from ruleloom.llm.common import staged
from ruleloom.llm.decontamination import contaminated
from ruleloom.llm.near_dup import near_duplicates
from ruleloom.llm.quality import passing
from ruleloom.llm.toxicity import score_toxicity, train_toxicity

#: SQL can't express the toxicity and byte-pair stages; the tests compare them with brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts; the model learns from every label."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, carry=True).where("predicted = 0").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return passing(docs)


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows with a number each, written so that it stays the same, and the number's column."""
    row = "row_number"
    while row in docs.columns:
        row += "_"
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each near-duplicate group (five words, 0.8).

    Rows are told apart by number, not by doc_id: one row stays of a group whatever its keys, also of rows with
    equal doc_ids; a null doc_id comes after all others.  Texts without a word are in no group and all stay.
    """
    rows, row = _numbered(docs, "near_dedup_rows")
    groups = near_duplicates(rows, key=row).select(row, "component_id")
    first = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("first"))
    return rows.join(first.select(F.col(f"first.{row}").alias(row)), row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (80 % of its five-word shingles).

    Each row is judged by its own text: a null doc_id hides nothing, and rows of equal doc_id don't share a verdict.
    """
    rows, row = _numbered(docs, "decontamination_rows")
    found = staged(contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=row).select(row).distinct(), "contaminated")
    return rows.join(found, row, "left_anti").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's tokens and of what they decode to."""
    return digest_table(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
