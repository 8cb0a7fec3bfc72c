"""How far a sample's answer is from the exact one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators.joins import any_of

STEPS = 100_000  # truncated errors are multiples of 1 / STEPS


def _whole(value: Column) -> Column:
    """Drop the fraction; 38 digits, so large sums do not overflow."""
    # rounding up front keeps noise in the last bits from deciding the fraction
    exact = F.round(value.cast("double"), 4).cast("decimal(38,4)")
    return F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact)).cast("decimal(38,0)")


def truncated_error(estimate: Column, truth: Column) -> Column:
    """Relative error by integer division, in steps of 1/100000; NULL if truth is 0."""
    gap = _whole((estimate.cast("double") - truth.cast("double")) * F.lit(STEPS))
    base = _whole(truth)
    quotient = F.call_function("div", gap, F.when(base != 0, base))
    return F.abs(quotient.cast("double") / F.lit(STEPS))


def relative_error(estimate: Column, truth: Column) -> Column:
    truth = truth.cast("double")
    return F.abs(estimate.cast("double") - truth) / F.abs(F.when(truth != 0, truth))


def _side_by_side(answers, groups, aggs) -> DataFrame:
    """Answers next to each other: a full outer join on the group columns, NULL equal to NULL.

    Each answer has one row per group, so a union and one aggregate do it in a
    single shuffle, also for an answer without group columns.
    """
    sides = None
    for mark, answer in answers.items():
        side = answer.select(
            *groups, *(F.col(a).alias(f"_{mark}_{a}") for a in aggs), F.lit(1).alias(f"_{mark}")
        )
        sides = side if sides is None else sides.unionByName(side, allowMissingColumns=True)
    values = [c for c in sides.columns if c not in groups]
    return sides.groupBy(*groups).agg(*(F.max(c).alias(c) for c in values))


def _mean_error(error, mark: str, aggs: Sequence[str]) -> Column:
    """Errors added over aggregates, averaged over groups, divided by the number of aggregates."""
    terms = [error(F.col(f"_{mark}_{a}"), F.col(f"_o_{a}")) for a in aggs]
    return F.avg(reduce(lambda a, b: a + b, terms)) / F.lit(len(aggs))


def compare_answers(
    exact: DataFrame,
    approx: DataFrame,
    groups: Sequence[str],
    aggs: Sequence[str],
    other: DataFrame | None = None,
    other_error: str = "other_error",
) -> DataFrame:
    """One row of quality measures for an already scaled answer.

    ``avg_pct_error`` uses truncated errors, adds them over the aggregates of a
    group, averages over groups and divides by the number of aggregates; a group
    with an aggregate that is 0 or NULL drops out and is counted in
    ``skipped_groups``. ``avg_rel_error`` is the mean of the untruncated errors.
    ``other`` may be a second scaled answer, whose truncated error is added.
    """
    answers = {"o": exact, "s": approx}
    if other is not None:
        answers["p"] = other
    rows = _side_by_side(answers, groups, aggs)
    in_both = F.col("_o").isNotNull() & F.col("_s").isNotNull()
    undefined = any_of(truncated_error(F.col(f"_s_{a}"), F.col(f"_o_{a}")).isNull() for a in aggs)
    missing = (F.count("_o") - F.count("_s")) / F.nullif(F.count("_o"), F.lit(0))
    measures = {
        "exact_groups": F.count("_o"),
        "sample_groups": F.count("_s"),
        "skipped_groups": F.count_if(in_both & undefined),
        "missing_group_ratio": missing,
        "avg_pct_error": _mean_error(truncated_error, "s", aggs),
        "avg_rel_error": _mean_error(relative_error, "s", aggs),
    }
    if other is not None:
        measures[other_error] = _mean_error(truncated_error, "p", aggs)
    return rows.agg(*(m.alias(name) for name, m in measures.items()))


def avg_pct_error(exact, approx, groups, aggs) -> DataFrame:
    return compare_answers(exact, approx, groups, aggs).select("avg_pct_error")


def missing_group_ratio(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Share of the exact answer's groups that the sample's answer lacks, by count."""
    sides = exact.select(F.lit("o").alias("side")).unionByName(
        approx.select(F.lit("s").alias("side"))
    )
    counts = sides.agg(
        F.count_if(F.col("side") == "o").alias("exact_groups"),
        F.count_if(F.col("side") == "s").alias("sample_groups"),
    )
    ratio = (F.col("exact_groups") - F.col("sample_groups")) / F.nullif(
        F.col("exact_groups"), F.lit(0)
    )
    return counts.withColumn("missing_group_ratio", ratio)
