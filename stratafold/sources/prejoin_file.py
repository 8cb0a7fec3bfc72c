"""Prejoin descriptions as text, one per line: ``database;name;t1,t2;a = b AND c = d``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.spec import JoinPair, PrejoinSpec


def _trimmed(parts: Column) -> Column:
    return F.transform(parts, lambda part: F.trim(part))


def read_prejoin_file(spark: SparkSession, path: str, facts: Sequence[str]) -> DataFrame:
    """Parsed lines: database, name, fact, tables, pairs (sorted, sides normalised).

    The fact is the first listed table that is one of ``facts``; lines without
    one are left out. Tables that are facts get the spelling of ``facts``. A line
    with fewer than four fields is an error; empty lines are passed over.
    """
    fields = F.split("value", ";")
    trimmed = _trimmed(F.split(fields[2], ","))
    pair = F.transform(
        F.split(fields[3], "(?i) AND "),
        lambda p: F.concat_ws(" = ", F.array_sort(_trimmed(F.split(p, "=")))),
    )
    known = [f.lower() for f in facts]
    spelled = F.create_map(*(F.lit(x) for f in facts for x in (f.lower(), f)))
    trimmed = F.transform(trimmed, lambda t: F.coalesce(spelled[F.lower(t)], t))
    fact = F.filter(trimmed, lambda t: F.lower(t).isin(known))
    short = F.raise_error(F.concat(F.lit("prejoin line with fewer than four fields: "), "value"))
    whole = F.when(F.size(fields) >= 4, F.lit(True)).otherwise(short.cast("boolean"))
    return (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .where(whole)
        .select(
            F.trim(fields[0]).alias("database"),
            F.trim(fields[1]).alias("name"),
            F.get(fact, F.lit(0)).alias("fact"),
            F.array_sort(trimmed).alias("tables"),
            F.array_sort(pair).alias("pairs"),
        )
        .where(F.col("fact").isNotNull())
    )


def prejoin_specs(described: DataFrame) -> list[PrejoinSpec]:
    """The described prejoins as values; a list people write by hand, so it is short."""
    return [
        PrejoinSpec(
            row["database"],
            row["fact"],
            frozenset(row["tables"]),
            frozenset(JoinPair.parse(p) for p in row["pairs"]),
            row["name"],
        )
        for row in described.collect()
    ]
