"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cytoframe.llm import bpe, decontam, neardup, pii, quality
from cytoframe.llm.common import stored
from cytoframe.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the learned decision list or the base rule rejects."""
    return quality.filter_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold passages of the benchmark."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and generalises or removes the terms that give it away."""
    return pii.sanitise(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token and text digests of what is left."""
    return bpe.token_digests(bpe.encode_texts(docs, tokenizer_path()))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", neardup_stage),
    ("benchmark decontamination", decontam_stage),
    ("personal data", pii_stage),
    ("tokens", tokens_stage),
]
#: No SQL: several stages are learned or search the corpus; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
