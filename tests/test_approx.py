import statistics

import pytest
from pyspark.sql import functions as F

from stratafold.operators.approx import one_rate_per_group, rescaled, rescaled_merge, self_scaled
from stratafold.operators.evaluate import (
    avg_pct_error,
    compare_answers,
    missing_group_ratio,
    truncated_error,
)
from stratafold.operators.sampling import min_row_sample
from stratafold.operators.strata import stratum_sizes


@pytest.fixture(scope="module")
def fact(spark):
    return (
        spark.range(0, 12000, 1, 4)
        .withColumn("a", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3))
        .withColumn("b", F.when(F.col("id") < 10000, "big").otherwise("small"))
        .withColumn("c", F.col("id") % 5)
        .withColumn("v", (F.col("id") % 100 + 1).cast("double"))
        .cache()
    )


def totals(df, groups):
    return {tuple(r[g] for g in groups): (r["s"], r["n"]) for r in df.collect()}


@pytest.mark.parametrize("groups", [["a", "b"], ["a"], ["b"], ["c"], ["a", "c"], []])
def test_a_whole_sample_gives_the_exact_answer(fact, groups):
    """With every row sampled all rates are 1, for groups of, across and within strata."""
    qcs = ["a", "b"]
    sample = min_row_sample(fact, qcs, 10**6, ["id"])
    got = rescaled(sample, stratum_sizes(fact, qcs), qcs, groups, {"s": F.col("v")}, ["n"])
    want = fact.groupBy(*groups).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    got, want = totals(got, groups), totals(want, groups)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])


def test_estimates_are_unbiased_where_groups_cut_strata(fact):
    qcs, truth = ["b"], fact.where("c = 2").agg(F.sum("v")).first()[0]
    sizes = stratum_sizes(fact, qcs)
    errors = []
    for seed in range(12):
        sample = min_row_sample(fact, qcs, 300, ["id"], seed=seed)
        got = rescaled(sample, sizes, qcs, ["c"], {"s": F.col("v")})
        errors.append(got.where("c = 2").first()["s"] / truth - 1)
    assert abs(statistics.mean(errors)) < 3.5 * statistics.stdev(errors) / len(errors) ** 0.5
    assert statistics.stdev(errors) < 0.3


def test_counts_are_scaled_by_stratum_sizes(fact):
    sample = min_row_sample(fact, ["b"], 50, ["id"])
    got = rescaled(sample, stratum_sizes(fact, ["b"]), ["b"], ["b"], counts=["n"])
    assert {r["b"]: r["n"] for r in got.collect()} == {"big": 10000.0, "small": 2000.0}


def test_filters_on_other_columns_keep_the_stratum_rate(fact):
    """A filter on v must not change the rate: seen rows include those it rejects."""
    qcs = ["b"]
    sample = min_row_sample(fact, qcs, 10**6, ["id"])
    half = sample.where("id % 2 = 0")
    got = rescaled(
        half, stratum_sizes(fact, qcs), qcs, ["b"], counts=["n"], where=F.col("c") == 1
    )
    got = {r["b"]: r["n"] for r in got.collect()}
    assert got == pytest.approx({"big": 2000.0, "small": 400.0})


def test_pinned_null_and_unknown_pins(fact):
    qcs = ["a", "b"]
    sample = min_row_sample(fact, qcs, 10**6, ["id"])
    sizes = stratum_sizes(fact, qcs)
    got = rescaled(sample, sizes, qcs, ["b"], counts=["n"], pinned={"a": None})
    want = fact.where("a is null").groupBy("b").count().collect()
    assert {r["b"]: r["n"] for r in got.collect()} == {r["b"]: float(r["count"]) for r in want}
    with pytest.raises(ValueError):
        rescaled(sample, sizes, qcs, ["b"], counts=["n"], pinned={"c": 1})


def test_rate_check():
    assert one_rate_per_group(["a", "b"], ["a"], {"b": 1})
    assert not one_rate_per_group(["a", "b"], ["a"])


def test_merge_adds_exact_branches(fact, spark):
    sample = min_row_sample(fact, ["b"], 10**6, ["id"])
    other = spark.createDataFrame([("big", 5), ("new", 7)], "b string, s bigint")
    got = rescaled_merge(
        sample, stratum_sizes(fact, ["b"]), ["b"], ["b"], {"s": F.col("v")}, [other]
    )
    base = {r["b"]: r["s"] for r in fact.groupBy("b").agg(F.sum("v").alias("s")).collect()}
    got = {r["b"]: r["s"] for r in got.collect()}
    assert got == pytest.approx({"big": base["big"] + 5, "small": base["small"], "new": 7.0})


def test_self_scaling_uses_the_exact_group_size(spark):
    exact = spark.createDataFrame([(None, 100.0, 10)], "k string, s double, groupsize bigint")
    seen = spark.createDataFrame([(None, 30.0, 2)], "k string, s double, groupsize bigint")
    assert self_scaled(exact, seen, ["k"], ["s"]).first()["s"] == 150.0


def test_errors_skip_zero_and_null_and_count_them(spark):
    exact = spark.createDataFrame(
        [("a", 100.0, 10), ("b", 0.0, 10), ("c", None, 10), (None, 200.0, 20), ("e", 50.0, 1)],
        "k string, x double, y bigint",
    )
    approx = spark.createDataFrame(
        [("a", 90.0, 10), ("b", 1.0, 10), ("c", 1.0, 10), (None, 250.0, 15)],
        "k string, x double, y bigint",
    )
    row = compare_answers(exact, approx, ["k"], ["x", "y"]).first()
    assert (row["exact_groups"], row["sample_groups"], row["skipped_groups"]) == (5, 4, 2)
    assert row["missing_group_ratio"] == pytest.approx(0.2)
    # a: 0.1 + 0, NULL: 0.25 + 0.25; two groups, two aggregates
    assert row["avg_pct_error"] == pytest.approx((0.1 + 0.5) / 2 / 2)
    assert row["avg_rel_error"] == pytest.approx((0.1 + 0.5) / 2 / 2)
    assert avg_pct_error(exact, approx, ["k"], ["x", "y"]).first()[0] == row["avg_pct_error"]
    assert missing_group_ratio(exact, approx).first()["missing_group_ratio"] == 0.2


def test_truncated_error_drops_fractions_and_survives_large_sums(spark):
    cases = [(10.9, 7.9, 0.42857), (3.0, 7.0, 0.57142), (1.0e17, 3.0e17, 0.66666), (5.0, 0.4, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "e double, t double")
    got = [r[0] for r in df.select(truncated_error(F.col("e"), F.col("t"))).collect()]
    # 7.9 counts as 7: (10.9 - 7.9) * 100000 div 7
    assert got == [c[2] for c in cases]


def test_no_group_columns_and_empty_answers(spark):
    one = spark.createDataFrame([(10.0,)], "x double")
    other = spark.createDataFrame([(12.0,)], "x double")
    assert compare_answers(one, other, [], ["x"]).first()["avg_pct_error"] == 0.2
    empty = spark.createDataFrame([], "x double")
    assert missing_group_ratio(empty, empty).first()["missing_group_ratio"] is None
