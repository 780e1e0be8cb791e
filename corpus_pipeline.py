"""From raw documents to packed training sequences: language ID, line dedup, near-duplicate join, secret scan, packing.

Every stage works on all that its predecessor kept and is written as Parquet before the next one reads it. Documents go
where no language can be told, where every line with a word stands in an earlier document too, or where a document of the
same group stays; lines and secrets go where the operators find them, and `n_chars` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlens.llm import language_id, line_dedup, ngram_join, packing, secret_scan
from sessionlens.session import scratch_path

WORDS = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    found = language_id.predict_language(docs, language_id.fitted(docs), keep_text=True)
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).select(docs.columns)


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat across sources; those that lose all their lines go."""
    out = line_dedup.line_dedup(docs)
    return counted(out.filter((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines"))), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    kept = ngram_join.ngram_join(docs).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.xxhash64("doc_id", "text_key").alias("_k"))
    keyed = docs.withColumn("_text_key", F.xxhash64("text")).withColumn("_doc", F.xxhash64("doc_id", "_text_key"))
    same = (F.col("_doc") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    once = Window.partitionBy("_doc", "doc_id", "_text_key").orderBy("lang", "source")
    stay = keyed.join(kept.hint("merge"), same, "left_semi").withColumn("_n", F.row_number().over(once))
    return stay.filter("_n = 1").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    words = public_tokenizers.path(WORDS)
    return counted(secret_scan.scan_secrets(docs, secret_scan.fitted(docs, words), words, redact=True), docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(spark, packing.pieces(docs, public_tokenizers.path(WORDS)))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", cut_lines),
    ("ngram_jaccard", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_documents),
]

#: Fitted models and token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
