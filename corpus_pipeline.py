"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again for the next.  All but the last keep the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.llm import line_dedup, minhash, packing, quality, secrets
from phaseloom.llm.common import stored, table

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds for bad rather than good go; without
    labels, none."""
    model = quality.train(spark, docs, table(spark, sf_dir, "labels"))
    if not model.learned:
        return docs.select(*COLUMNS)
    return docs.select(*COLUMNS).filter(quality.score(model, docs["text"]) >= 0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later documents lose blocks that they share with earlier ones; a document
    of which nothing is left goes."""
    return _documents(line_dedup.left_over(line_dedup.dedup_lines(spark, docs.select(*COLUMNS))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the least doc_id stays."""
    docs = docs.select(*COLUMNS)
    gone = minhash.near_duplicates(spark, docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out."""
    return _documents(docs.withColumn("text", secrets.redacted(F.col("text").cast("string"))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicate removal", near_duplicate_stage),
    ("secret scan", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(spark, docs, f"stage-{k}")
    return docs
