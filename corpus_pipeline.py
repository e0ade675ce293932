"""The corpus pipeline: toxic texts go, one document of each near-duplicate group stays, contaminated documents go, secrets are masked,
and what is left is encoded. Each stage works on all that the stage before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textbayes.llm import decontaminate, ngram_join, secrets, sentencepieces, toxicity
from textbayes.llm.common import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by the near-duplicate definition: five-word shingles at a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.sentencepiece_encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", reject_toxic), ("near copies", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("encoding", encode)]

#: SQL can't express the stages; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
