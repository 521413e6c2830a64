"""Corpus pipeline: documents through quality rules, near-dedup, substring dedup, decontamination and packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir).  ``run`` writes
every stage's rows as Parquet in the shared folder and rereads them as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deluge.llm.common import cut, ship
from deluge.llm.decontaminate import keep_clean
from deluge.llm.packing import pack
from deluge.llm.quality import keep_good
from deluge.llm.queries import SEQUENCE_TOKENS, SIMHASH_BITS, SIMHASH_SHINGLE, tokenizer_path
from deluge.llm.simhash import keep_one, near_duplicates
from deluge.llm.substring_dedup import remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    ship(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    ship(spark)
    return keep_one(docs, near_duplicates(docs, SIMHASH_SHINGLE, SIMHASH_BITS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more stay in the first document that has them."""
    ship(spark)
    return remove(docs, window=13)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document placed in sequences of 2048 tokens."""
    ship(spark)
    return pack(docs, tokenizer_path(), SEQUENCE_TOKENS)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Tokenisation and the fitted model are not expressible in SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
