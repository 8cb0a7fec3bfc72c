"""Answers from a sample: scale what was seen up to what is there."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators.joins import all_of, null_safe_join


def one_rate_per_group(
    qcs: Sequence[str], groups: Sequence[str], pinned: Mapping[str, Any] | None = None
) -> bool:
    """True if every output group lies in one stratum, so a plain ratio is unbiased."""
    return set(qcs) <= set(groups) | set(pinned or {})


def rescaled(
    sample: DataFrame,
    sizes: DataFrame,
    qcs: Sequence[str],
    groups: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    counts: Sequence[str] = (),
    *,
    pinned: Mapping[str, Any] | None = None,
    where: Column | None = None,
    ratio: float | None = None,
    whole_strata: bool = False,
) -> DataFrame:
    """Estimated sums and counts per group, from a sample joined to its dimensions.

    ``sizes`` holds the true stratum sizes. ``pinned`` are equality filters on
    query columns; they select whole strata and are pushed to the scan. ``where``
    may be any predicate: rows that fail it still count as seen, because their
    stratum's rate depends on all of its sampled rows.

    Each stratum is scaled by its own size over its own sampled rows before
    strata are added up. Where a group is a single stratum that is the plain
    ratio ``sum / sampled * size`` and the second step falls away. A sampled
    stratum without a size is an error: its sizes are of another state. So is a
    size without a sampled row where the caller knows that no join or filter took
    ``whole_strata`` away.

    ``ratio`` is the rate of a uniform sample. Every row stands for as many
    there, also for strata of which none was drawn; sizes are not needed.
    """
    sums = dict(sums or {})
    qcs, groups, pinned = list(qcs), list(groups), dict(pinned or {})
    unknown = set(pinned) - set(qcs)
    if unknown:
        raise ValueError(f"only query columns can be pinned, not {sorted(unknown)}")
    if ratio is not None:
        return _by_ratio(sample, groups, sums, counts, pinned, where, ratio)
    if pinned:
        fixed = [F.col(c).eqNullSafe(F.lit(v)) for c, v in pinned.items()]
        sample, sizes = sample.where(all_of(fixed)), sizes.where(all_of(fixed))

    def seen(value: Column) -> Column:
        return value if where is None else F.when(where, value)

    extra = [c for c in groups if c not in qcs]
    per_stratum = sample.groupBy(*qcs, *extra).agg(
        F.count("*").alias("_rows"),
        F.count(seen(F.lit(1))).alias("_hits"),
        *(F.sum(seen(v)).alias(f"_sum_{name}") for name, v in sums.items()),
    )
    rates = sizes.select(*qcs, "groupsize")
    if extra:
        # the groups cut strata apart, the rate is that of the whole stratum; counted
        # by an aggregate of its own, as a window would gather a stratum's groups
        whole = sample.groupBy(*qcs).agg(F.count("*").alias("_sampled"))
        rates = _matched(rates, whole, qcs).where(_of_one_state(F.lit(True), whole_strata))
        scaled = null_safe_join(per_stratum.where(F.col("_hits") > 0), rates, qcs)
    else:
        per_stratum = per_stratum.withColumn("_sampled", F.col("_rows"))
        scaled = _matched(per_stratum, rates, qcs).where(_of_one_state(F.col("_hits") > 0, whole_strata))
    estimates = {
        **{
            n: F.col(f"_sum_{n}").cast("double") / F.col("_sampled") * F.col("groupsize")
            for n in sums
        },
        **{n: F.col("_hits") / F.col("_sampled") * F.col("groupsize") for n in counts},
    }
    if one_rate_per_group(qcs, groups, pinned):
        return scaled.select(*groups, *(e.alias(n) for n, e in estimates.items()))
    return scaled.groupBy(*groups).agg(*(F.sum(e).alias(n) for n, e in estimates.items()))


def _matched(left: DataFrame, right: DataFrame, qcs: Sequence[str]) -> DataFrame:
    """Full outer join with a row per stratum of either side, NULL equal to NULL.

    Both have one row per stratum, so a union and one aggregate do it.
    """
    both = left.unionByName(right, allowMissingColumns=True)
    values = [c for c in both.columns if c not in qcs]
    return both.groupBy(*qcs).agg(*(F.max(c).alias(c) for c in values))


def _of_one_state(condition: Column, whole_strata: bool) -> Column:
    """``condition``, where a stratum has both a size and sampled rows. One without a size is an
    error; so is one without rows if ``whole_strata`` are expected, else it is left out.

    Part of the filter, so that no rewrite drops the rows it is about before they are seen.
    """
    unsized = F.raise_error(F.lit("a sampled stratum has no size; profile the source again"))
    unsampled = F.raise_error(F.lit("a stratum has no sampled row; draw the sample again"))
    return (
        F.when(F.col("groupsize").isNull(), unsized.cast("boolean"))
        .when(
            F.col("_sampled").isNull(),
            unsampled.cast("boolean") if whole_strata else F.lit(False),
        )
        .otherwise(condition)
    )


def _by_ratio(sample, groups, sums, counts, pinned, where, ratio) -> DataFrame:
    seen = [F.col(c).eqNullSafe(F.lit(v)) for c, v in pinned.items()]
    seen += [] if where is None else [where]
    rows = sample.where(all_of(seen)) if seen else sample
    return rows.groupBy(*groups).agg(
        *((F.sum(v).cast("double") / F.lit(ratio)).alias(n) for n, v in sums.items()),
        *((F.count(F.lit(1)) / F.lit(ratio)).alias(n) for n in counts),
    )


def rescaled_merge(
    sample: DataFrame,
    sizes: DataFrame,
    qcs: Sequence[str],
    groups: Sequence[str],
    sums: Mapping[str, Column],
    exact: Sequence[DataFrame],
    **options,
) -> DataFrame:
    """A rescaled branch and exactly computed branches, added up per group."""
    merged = rescaled(sample, sizes, qcs, groups, sums, **options)
    for branch in exact:
        merged = merged.unionByName(
            branch.select(*groups, *(F.col(n).cast("double").alias(n) for n in sums))
        )
    return merged.groupBy(*groups).agg(*(F.sum(n).alias(n) for n in sums))


def self_scaled(
    exact: DataFrame, approx: DataFrame, groups: Sequence[str], aggs: Sequence[str]
) -> DataFrame:
    """Scale a sample's plain answer by the exact answer's own group sizes.

    Needs the exact answer, so it serves to judge a sample, not to use one.
    Counts come out exact by construction.
    """
    seen = approx.select(*groups, *(F.col(c).alias(f"_s_{c}") for c in [*aggs, "groupsize"]))
    both = null_safe_join(exact.select(*groups, *aggs, "groupsize"), seen, groups)
    factor = F.col("groupsize") / F.col("_s_groupsize")
    return both.select(
        *groups, *((F.col(f"_s_{c}").cast("double") * factor).alias(c) for c in aggs)
    )
