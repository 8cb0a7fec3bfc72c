"""Uniform sample, stratified sample, or none."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.strata import profile_many, summarise_profiles
from stratafold.spec import STRATIFIED, UNIFORM, QuerySpec, SampleSpec

UNIFORM_THRESHOLD = 100_000
LARGEST_RATIO = 2.0 / 3.0
NONE = "none"


def decide(summary: DataFrame, uniform_above: int | None = None) -> DataFrame:
    """Add ``advice``, ``ratio`` and ``reason`` to stratum summaries.

    Strata above ``uniform_above`` rows on average (``UNIFORM_THRESHOLD`` if not
    given) get a uniform sample, unless it would keep over two thirds of the
    rows; smaller ones a stratified sample under the same limit. Large strata never fall back to a stratified sample.
    """
    if uniform_above is None:
        uniform_above = UNIFORM_THRESHOLD
    large = F.col("avg_group_size") > F.lit(uniform_above)
    ratio = F.when(large, F.lit(uniform_above) / F.col("avg_group_size")).otherwise(
        F.try_divide("target_sample_size", "population_size")
    )
    useful = ratio <= F.lit(LARGEST_RATIO)
    return summary.withColumns(
        {
            "ratio": ratio,
            "advice": F.when(large & useful, F.lit(UNIFORM))
            .when(~large & useful, F.lit(STRATIFIED))
            .otherwise(F.lit(NONE)),
            "reason": F.when(useful, F.lit("ok"))
            .when(large, F.lit("uniform sample too large"))
            .otherwise(F.lit("stratified sample too large")),
        }
    )


def every_profile(summaries: DataFrame, count: int) -> DataFrame:
    """A summary for each of ``count`` profiles; those of an empty source have no strata."""
    numbers = summaries.sparkSession.range(count).select(F.col("id").cast("int").alias("profile"))
    zeros = {c: F.coalesce(c, F.lit(0)) for c in summaries.columns if c != "profile"}
    return numbers.join(summaries, "profile", "left").withColumns(zeros)


def advise(
    queries: Sequence[QuerySpec],
    source_of: Callable[[QuerySpec], DataFrame],
    uniform_above: int | None = None,
) -> DataFrame:
    """One row of summary and advice per query with query columns.

    Queries on the same tables and pairs share one scan of their source, however
    many different column sets they have.
    """
    by_source: dict = {}
    for query in queries:
        if query.qcs:
            by_source.setdefault((query.fact, query.tables, query.pairs), []).append(query)
    parts = []
    for group in by_source.values():
        profiles = profile_many(source_of(group[0]), [q.qcs for q in group])
        ids = F.array(*(F.lit(q.id) for q in group))
        parts.append(
            every_profile(summarise_profiles(profiles), len(group))
            .withColumn("query_id", ids[F.col("profile")])
            .drop("profile")
        )
    summaries = parts[0]
    for part in parts[1:]:
        summaries = summaries.unionByName(part)
    return decide(summaries, uniform_above)


def samples_to_create(queries: Sequence[QuerySpec], advice: DataFrame) -> list[SampleSpec]:
    """The advised samples; one row per query reaches the driver."""
    by_id = {q.id: q for q in queries}
    samples = []
    for row in advice.select("query_id", "advice", "ratio").collect():
        query = by_id[row["query_id"]]
        shape = (query.fact, query.qcs, query.tables, query.pairs)
        if row["advice"] == UNIFORM:
            samples.append(SampleSpec(UNIFORM, *shape, ratio=row["ratio"]))
        elif row["advice"] == STRATIFIED:
            samples.append(SampleSpec(STRATIFIED, *shape))
    return list(dict.fromkeys(samples))
