"""Queries of this subpackage: thin wrappers that bind the operators to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import decontamination, licences, near_dup, warc
from . import quality as rules
from .bpe import digest_table
from .decontamination import contaminated
from .html_text import extract
from .langid import predict_language, train_language
from .licences import scan_licences, scan_windows
from .near_dup import near_duplicates
from .quality import quality
from .token_files import read_tokens, write_tokens
from .toxicity import score_toxicity, train_toxicity
from .warc import read_archive, write_archive


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; rows with crc32(doc_id) mod 5 = 0 are never learnt from."""
    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").where(_remainder("doc_id", 5) != 0)
    model = train_toxicity(docs, labels)
    return score_toxicity(docs, model).select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 4 = 2 are never learnt from."""
    docs = _read(spark, sf_dir, "documents")
    model = train_language(docs.where(_remainder("doc_id", 4) != 2))
    return predict_language(docs, model).select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, by 80 % of its five-word shingles."""
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are 85 % alike."""
    return near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the block labeller."""
    return extract(_read(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids in Arrow stream files, read back."""
    index = write_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return read_tokens(spark, index)


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that a line, a paragraph or the whole of each document names or quotes."""
    return scan_licences(_read(spark, sf_dir, "documents"))


def op7_licence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document names or quotes, wherever the words stand."""
    return scan_windows(_read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded by the transducer and decoded again."""
    return digest_table(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return quality(_read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records in seekable bundles, read back."""
    return read_archive(write_archive(_read(spark, sf_dir, "pages")))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language, op3_decontamination, op4_near_duplicates, op5_html_text, op6_token_files, op7_licences, op7_licence_windows, op8_byte_bpe, op9_quality, op10_warc)}
ORACLE_SQL: dict[str, str] = {"op3_decontamination": decontamination.oracle(), "op4_near_duplicates": near_dup.oracle(), "op7_licences": licences.oracle(), "op9_quality": rules.oracle(), "op10_warc": warc.oracle()}
