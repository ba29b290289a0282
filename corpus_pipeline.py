"""From raw documents to a token file: each stage reads what its predecessor kept.

    toxicity          documents that score as toxic go
    near duplicates   of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more one stays
    decontamination   documents that hold a benchmark item go
    mixing            sources are drawn to their target weights; a row is what one pass takes of a document
    token file        ids as packed shards, read back
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, mixing, simhash, token_files, toxicity
from tessella.llm.common import saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, simhash.SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def write_token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_files(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_file", write_token_file),
]
#: SQL has neither the trained model nor XXH64 fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
