import math

import pytest
from pyspark.sql import functions as F

from stratafold.functions.sizing import at_least, cochran, whole_rows
from stratafold.operators.strata import (
    profile_many,
    stratum_sizes,
    summarise,
    summarise_profiles,
    with_group_size,
    with_targets,
)


@pytest.fixture
def null_keys(spark):
    rows = [
        (i, None if i % 3 == 0 else f"k{i % 3}", None if i % 4 == 0 else i % 4, i * 1.5)
        for i in range(240)
    ]
    return spark.createDataFrame(rows, "id bigint, k1 string, k2 int, v double")


def test_null_keys_are_strata(null_keys):
    rows = stratum_sizes(null_keys, ["k1", "k2"]).collect()
    sizes = {(r["k1"], r["k2"]): r["groupsize"] for r in rows}
    assert len(sizes) == 12 and set(sizes.values()) == {20}
    assert (None, None) in sizes


def test_targets_follow_the_formula(spark):
    groups = [(g,) for g in (1, 2, 100, 16589, 10**6, 10**11)]
    sizes = spark.createDataFrame(groups, "groupsize bigint")
    s0 = 2.576**2 * 0.25 / 0.01**2
    for row in with_targets(sizes).collect():
        g = row["groupsize"]
        assert math.isclose(row["target_group_sample_size"], g * s0 / (g + s0 - 1))
    one = sizes.where("groupsize = 1").select(
        *(whole_rows(cochran(z, e)(F.col("groupsize"))).alias(f"c{i}")
          for i, (z, e) in enumerate([(2.576, 0.01), (1.96, 0.03), (1.645, 0.07)]))
    )
    assert tuple(one.first()) == (1, 1, 1)
    assert sizes.select(at_least(7)(F.col("groupsize")).alias("n")).distinct().first()["n"] == 7.0


def test_summary(spark):
    sizes = spark.createDataFrame([(10,), (20,), (60,)], "groupsize bigint")
    row = summarise(with_targets(sizes, at_least(5))).first().asDict()
    assert row == {
        "group_count": 3,
        "population_size": 90,
        "target_sample_size": 15.0,
        "avg_group_size": 30.0,
        "min_group_size": 10,
        "max_group_size": 60,
    }


def test_one_scan_profiles_equal_separate_ones(null_keys):
    sets = [("k1",), ("k2", "k1"), ("k2",), ("k1",)]
    together = profile_many(null_keys, sets)
    summaries = {r["profile"]: r for r in summarise_profiles(together).collect()}
    assert sorted(summaries) == [0, 1, 2, 3]
    for i, qcs in enumerate(sets):
        columns = sorted(qcs)
        alone = stratum_sizes(null_keys, columns)
        part = together.where(F.col("profile") == i).select(*columns, "groupsize")
        assert sorted(map(repr, part.collect())) == sorted(map(repr, alone.collect()))
        want = summarise(with_targets(alone)).first()
        assert all(math.isclose(want[c], summaries[i][c]) for c in want.asDict())


def test_profiles_scan_the_source_once(null_keys, spark, tmp_path):
    null_keys.write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    plan = profile_many(source, [("k1",), ("k2",)])._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("FileScan parquet") == 1


def test_group_size_next_to_rows_keeps_null_strata(null_keys):
    sizes = stratum_sizes(null_keys, ["k1"])
    rows = with_group_size(null_keys, sizes, ["k1"])
    assert rows.count() == 240
    assert rows.select("groupsize").distinct().collect()[0][0] == 80
