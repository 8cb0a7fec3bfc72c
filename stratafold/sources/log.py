"""The metadata log: an append-only table of typed, timestamped JSON values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

DELETED = "DELETED"
LOG_SCHEMA = StructType(
    [
        StructField("type", StringType()),
        StructField("key", StringType()),
        StructField("value", StringType()),
        StructField("ts", TimestampType()),
    ]
)


def newest(log: DataFrame) -> DataFrame:
    """The newest entry per type and key, tombstones included.

    ``max`` of a struct combines on the mapper, so a key with very many versions
    is reduced before the shuffle.
    """
    entry = F.max(F.struct("ts", "value")).alias("newest")
    return log.groupBy("type", "key").agg(entry).select("type", "key", "newest.value", "newest.ts")


def latest(log: DataFrame) -> DataFrame:
    """The newest value per type and key; keys whose newest value is a tombstone are gone."""
    return newest(log).where(F.col("value") != DELETED)


def live_entries(log: DataFrame, kind: str, prefix: str = "") -> DataFrame:
    """Live entries of one type whose key starts with ``prefix``, newest first."""
    entries = latest(log.where(F.col("type") == kind))
    if prefix:
        entries = entries.where(F.col("key").startswith(prefix))
    return entries.orderBy(F.desc("ts"), "key")
