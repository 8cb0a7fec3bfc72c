"""One query per operator over the whole of its table, with the columns that are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm import (
    collocations,
    decontaminate,
    html_text,
    lm,
    merkle,
    minhash,
    mixing,
    pii,
    quality,
    secret_scan,
    sharding,
    url_filter,
    vectors,
)
from stratafold.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    n_tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(mixing.TOKEN))
    return taken.select("doc_id", "lang", "source", n_tokens.cast("long").alias("n_tokens"), "epoch")


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    )
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.detect(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"), merkle.crc_divides())


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_lattice": op2_lattice,
    "op3_cross_polytope": op3_cross_polytope,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_personal_data": op7_personal_data,
    "op8_minhash": op8_minhash,
    "op9_secrets": op9_secrets,
    "op10_html": op10_html,
    "op11_merkle": op11_merkle,
    "op12_collocations": op12_collocations,
    "op13_urls": op13_urls,
}
ORACLE = {
    "op5_mixing": mixing.oracle_sql(),
    "op6_decontamination": decontaminate.oracle_sql(),
    "op11_merkle": merkle.oracle_sql(),
    "op12_collocations": collocations.oracle_sql(),
    "op13_urls": url_filter.oracle_sql(),
}
