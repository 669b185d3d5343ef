"""A corpus pipeline over ``documents``: drop toxic texts, near duplicates and leaked benchmark passages, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as
Parquet in the shared folder and reads them again as the next one's docs.

Defined cases, for every stage: null and empty texts are clean, alike with nothing and weigh 8 bytes, but the
mix never takes them; rows without a doc_id are documents of their own; of rows that repeat a doc_id near-dedup
keeps one, and the mix may repeat rows again; empty tables give no rows; other columns go along unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwright.llm import decontam, minhash, mixing, sharding, toxicity
from spanwright.llm.common import new_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8."""
    return minhash.deduplicated(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their places: copy (0, 1, ... among rows alike), size, text_crc32, shard and slot."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The toxicity model is fitted, so SQL cannot tell its rows; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
