"""The corpus pipeline: four stages over ``documents``.

Each stage takes all that the stage before kept. All but the last return the
columns of ``documents``; each result is written as Parquet and read again.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import langid, minhash, packing, secrets
from pairloom.llm.streams import bounded_batches, small
from pairloom.runtime import cut, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and no others; ``lang`` becomes the predicted language.

    Machines learn from the labelled documents that are not held out. If there are
    none, a document keeps its own label; without one it is ``und``.
    """
    bounded_batches(spark)
    judged = langid.identify(docs.select(*COLUMNS), docs.where(~langid.held_out(F.col("doc_id"))))
    learnt = F.when(F.col("score") > 0, F.col("lang_pred"))
    return judged.where(langid.lettered(F.col("text"))).withColumn("lang", F.coalesce(learnt, "lang", F.lit(langid.UNDETERMINED))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group linked at similarity 0.8."""
    bounded_batches(spark)
    judged = minhash.near_duplicates(docs.select("doc_id", "text"), percent=80)
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("doc_id")
    return docs.select(*COLUMNS).join(small(cut(gone)), "doc_id", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; every secret found in a text is replaced by a mark."""
    ledger = cut(secrets.scan(docs.select("text")))
    found = secrets.joined_back(docs.select(*COLUMNS, secrets.blob_id(F.col("text")).alias("blob")), ledger)
    hit = F.size("spans") > 0
    clean = found.withColumn("text", F.when(hit, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pattern_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    bounded_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.packed_documents(docs, "doc_id", "text", path, public_tokenizers.PATTERN, special=packing.SPECIAL)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("pattern_packing", pattern_packing),
]

#: SQL can't express the first two stages and the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; the result of each is a written table."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
