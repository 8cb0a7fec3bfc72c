"""Stratum sizes, targets and their summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.sizing import SizeRule, cochran
from stratafold.operators.joins import null_safe_join

SUMMARY = {
    "group_count": F.count,
    "population_size": F.sum,
    "target_sample_size": F.sum,
    "avg_group_size": F.avg,
    "min_group_size": F.min,
    "max_group_size": F.max,
}


def stratum_sizes(source: DataFrame, qcs: Sequence[str]) -> DataFrame:
    """Rows per value of the query columns. NULL is a value like any other."""
    return source.groupBy(*qcs).agg(F.count("*").alias("groupsize"))


def with_targets(sizes: DataFrame, rule: SizeRule | None = None) -> DataFrame:
    rule = rule or cochran()
    return sizes.withColumn("target_group_sample_size", rule(F.col("groupsize")))


def _summary_columns() -> list:
    source = {"group_count": "*", "target_sample_size": "target_group_sample_size"}
    return [f(source.get(name, "groupsize")).alias(name) for name, f in SUMMARY.items()]


def summarise(stats: DataFrame) -> DataFrame:
    """One row: strata, rows, rows wanted, and the average and range of sizes."""
    return stats.agg(*_summary_columns())


def profile_many(source: DataFrame, column_sets: Sequence[Sequence[str]]) -> DataFrame:
    """Stratum sizes for several column sets of one source in a single scan.

    Grouping sets expand each row on the mapper and are combined there before
    the shuffle, so the (often joined) source is read once and not once per set.
    ``profile`` is the position of the column set.
    """
    sets = [tuple(sorted(set(s))) for s in column_sets]
    columns = sorted({c for s in sets for c in s})
    distinct = list(dict.fromkeys(sets))
    # grouping_id has one bit per column, set where the column is rolled away
    bits = {
        s: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
        for s in distinct
    }
    sizes = source.groupingSets([[F.col(c) for c in s] for s in distinct], *columns).agg(
        F.count("*").alias("groupsize"), F.grouping_id().alias("_gid")
    )
    positions = F.create_map(
        *(
            part
            for s in distinct
            for part in (
                F.lit(bits[s]).cast("bigint"),
                F.array(*(F.lit(i) for i, t in enumerate(sets) if t == s)),
            )
        )
    )
    return sizes.withColumn("profile", F.explode(positions[F.col("_gid")])).drop("_gid")


def add_counts(profiles: DataFrame, before: Sequence[DataFrame]) -> DataFrame:
    """Counts of :func:`profile_many` over new rows, added to the sizes counted before, by position."""
    for position, sizes in enumerate(before):
        sizes = sizes.drop("target_group_sample_size").withColumn("profile", F.lit(position))
        profiles = profiles.unionByName(sizes, allowMissingColumns=True)
    columns = [c for c in profiles.columns if c != "groupsize"]
    return profiles.groupBy(*columns).agg(F.sum("groupsize").alias("groupsize"))


def summarise_profiles(profiles: DataFrame, rule: SizeRule | None = None) -> DataFrame:
    return with_targets(profiles, rule).groupBy("profile").agg(*_summary_columns())


def with_group_size(source: DataFrame, sizes: DataFrame, qcs: Sequence[str]) -> DataFrame:
    """The size of its stratum next to every row.

    A window count would shuffle all rows by stratum, largest strata included;
    the stored sizes are joined instead, by broadcast when they are small.
    """
    return null_safe_join(source, sizes.select(*qcs, "groupsize"), list(qcs))
