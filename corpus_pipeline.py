"""A corpus from raw documents: quality, near duplicates, decontamination, mix, shards.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame
that is stored as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratafold.llm import decontaminate, minhash, mixing, quality, sharding
from stratafold.llm.common import table
from stratafold.session import pin

#: Percent of similarity from which on documents are near duplicates.
SIMILAR = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    scored = quality.score(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; linked are
    documents whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return minhash.deduplicated(docs, SIMILAR).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages of a twentieth of their words or more."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, mixed to the target weights, none of them twice."""
    return mixing.mix(docs, budget=(4, 5), max_epochs=1).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of nearly equal bytes."""
    return sharding.shard(docs, shards=8)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier can't be put as SQL; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name)
    return docs
