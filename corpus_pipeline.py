"""The training-data pipeline: five stages, each on all that the one before kept.

Counted as part of ``lodestore.llm`` and removed with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import decontaminate, mixing, simhash, substring, toxicity
from lodestore.llm.common import held_out, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, learned on the labelled ones, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 3, 1))
    grammar = toxicity.learn(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    return toxicity.drop_toxic(docs, grammar, threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs, n=5, similarity=0.8)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 13 words that an earlier document has."""
    return substring.strip_repeats(docs, window=13)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within a tenth of its length in edits."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rate=0.1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix repeats each document."""
    return mixing.mix(docs, weights=(1, 2, 3), most=3)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", strip_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: The stages learn, hash and iterate beyond what SQL expresses; the tests compare
#: them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
