"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from flowlens.llm import jaccard, packing, quality, secrets
from flowlens.operators.store import materialize
from flowlens.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    checkpoint_dir(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judge_quality(docs, labels, keep=COLUMNS)
    return quality.settled(judged, "stays").select(*[F.col(f"kept.{c}").alias(c) for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, its first by id and then by text.
    A class's other rows go by id and text, so another text under the same id stays."""
    checkpoint_dir(spark)
    return jaccard.keep_first(docs.select(*COLUMNS))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each secret's span replaced by a mark; n_chars follows the text."""
    checkpoint_dir(spark)
    found = secrets.find_secrets(docs, keep=COLUMNS)
    text = secrets.redact(F.col("text"), F.col("spans"))
    found = found.withColumn("clean", text)
    hit = F.size("spans") > 0
    return found.select(F.col("kept.doc_id"), F.when(hit, F.col("clean")).otherwise(F.col("kept.text")).alias("text"),
                        F.col("kept.lang"), F.col("kept.source"),
                        F.when(hit, F.length("clean").cast("long")).otherwise(F.col("kept.n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    checkpoint_dir(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scans", secret_scans),
          ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
