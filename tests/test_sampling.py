import random
from collections import Counter
from functools import partial

import pytest
from pyspark.sql import functions as F

from stratafold.functions.rowhash import row_digest, with_position
from stratafold.functions.sizing import at_least, cochran
from stratafold.operators import sampling
from stratafold.operators.sampling import min_row_sample, stratified_sample, uniform_sample


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """One stratum with most rows, a NULL stratum, many tiny ones."""
    path = str(tmp_path_factory.mktemp("skewed") / "t")
    key = (
        F.when(F.col("id") < 20000, "big")
        .when(F.col("id") < 24000, F.lit(None))
        .otherwise(F.concat(F.lit("s"), (F.col("id") % 300).cast("string")))
    )
    df = spark.range(0, 25000, 1, 4).withColumn("k", key).withColumn("v", F.col("id") * 0.5)
    df.write.parquet(path)
    return spark.read.parquet(path)


def brute_force(df, rule, seed=0, tail=True):
    """The sample by plain Python over all rows."""
    rows = df.withColumn("d", row_digest(["id"], seed)).collect()
    sizes = Counter(r["k"] for r in rows)
    spark = df.sparkSession
    distinct = sorted(set(sizes.values()))
    targets = {
        r["g"]: r["t"]
        for r in spark.createDataFrame([(g,) for g in distinct], "g bigint")
        .select("g", rule(F.col("g")).alias("t"))
        .collect()
    }
    kept = []
    for k, size in sizes.items():
        target = targets[size]
        for rank, r in enumerate(sorted((r for r in rows if r["k"] == k), key=lambda r: r["d"]), 1):
            in_tail = tail and int(r["d"][13:26], 16) / 2.0**52 < target / 20 / size
            if rank <= int(round(target, 6)) or in_tail:
                kept.append(r["id"])
    return sorted(kept)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("tail", [False, True])
def test_stratified_equals_brute_force(skewed, tail):
    got = stratified_sample(skewed, ["k"], ["id"], tail=tail)
    assert ids(got) == brute_force(skewed, cochran(), tail=tail)
    assert got.columns == skewed.columns


@pytest.mark.parametrize("n", [0, 1, 5, 400, 10**6])
def test_min_rows_equals_brute_force(skewed, n):
    got = min_row_sample(skewed, ["k"], n, ["id"], seed=3)
    assert ids(got) == brute_force(skewed, at_least(n), seed=3)


def test_missed_band_falls_back_to_the_exact_cutoff(skewed, monkeypatch):
    want = ids(min_row_sample(skewed, ["k"], 50, ["id"]))
    monkeypatch.setattr(sampling, "BAND", 0.0)
    assert ids(min_row_sample(skewed, ["k"], 50, ["id"])) == want


def test_prefix_search_works_for_any_step(skewed, monkeypatch):
    want = ids(min_row_sample(skewed, ["k"], 50, ["id"]))
    monkeypatch.setattr(sampling, "BAND", 0.0)
    monkeypatch.setattr(sampling, "PREFIX_STEPS", (1, 2, 3, 32))
    assert ids(min_row_sample(skewed, ["k"], 50, ["id"])) == want


@pytest.fixture
def shuffled_joins(spark):
    """As with too many strata to broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("sampler", [stratified_sample, partial(min_row_sample, min_rows=50)])
def test_more_strata_than_may_be_broadcast(skewed, request, sampler):
    want = ids(sampler(skewed, ["k"], key=["id"]))
    request.getfixturevalue("shuffled_joins")
    got = sampler(skewed, ["k"], key=["id"])
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().toString()
    assert ids(got) == want


def test_stored_sizes_give_the_same_sample(skewed):
    from stratafold.operators.strata import stratum_sizes

    sizes = stratum_sizes(skewed, ["k"])
    want = ids(stratified_sample(skewed, ["k"], ["id"]))
    assert ids(stratified_sample(skewed, ["k"], ["id"], sizes=sizes)) == want


def test_every_stratum_is_present_and_singletons_are_kept(spark):
    df = spark.range(500).withColumn("k", F.col("id"))
    assert stratified_sample(df, ["k"], ["id"], tail=False).count() == 500


def test_same_rows_whatever_the_partitioning(skewed):
    want = ids(stratified_sample(skewed, ["k"], ["id"]))
    assert ids(stratified_sample(skewed.repartition(7, "v"), ["k"], ["id"])) == want
    other = ids(stratified_sample(skewed, ["k"], ["id"], seed="other"))
    assert other != want


def test_copies_of_one_row_hold_a_third_of_the_table(spark):
    """The key of one row is repeated; the sample still has exactly n rows per stratum."""
    base = spark.range(6000).withColumn("copy", F.lit(0))
    copies = spark.range(3000).select(
        F.lit(77).cast("bigint").alias("id"), F.col("id").alias("copy")
    )
    df = base.where("id <> 77").unionByName(copies).repartition(5)
    df = df.withColumn("k", F.lit("only"))
    for n in (1, 10, 3000, 5000, 8999, 9000):
        got = min_row_sample(df, ["k"], n, ["id"], order=["copy"], tail=False)
        assert got.count() == min(n, df.count()), n
    # the copies come in the given order: of 77's copies the first ones
    digests = df.withColumn("d", row_digest(["id"]))
    before = digests.where(F.col("d") < digests.where("id = 77").first()["d"]).count()
    got = min_row_sample(df, ["k"], before + 100, ["id"], order=["copy"], tail=False)
    assert sorted(r["copy"] for r in got.where("id = 77").collect()) == list(range(100))


def test_copies_that_fit_partly_in_several_strata(spark, monkeypatch):
    df = spark.range(4000).select(
        (F.col("id") % 4).alias("k"), F.lit(1).alias("same"), F.col("id").alias("id")
    )
    got = min_row_sample(df, ["k"], 37, ["same"], order=["id"], tail=False)
    counts = {r["k"]: r["count"] for r in got.groupBy("k").count().collect()}
    assert counts == {0: 37, 1: 37, 2: 37, 3: 37}
    first = min_row_sample(df, ["k"], 37, ["same"], order=["id"], tail=False)
    assert max(ids(first)) < 4 * 37


def test_position_as_key_of_a_table_with_copies(spark, tmp_path):
    copies = spark.range(900).select(F.lit("x").alias("k"), F.lit(5).alias("v"))
    copies.repartition(3).write.parquet(str(tmp_path / "t"))
    df = with_position(spark.read.parquet(str(tmp_path / "t")))
    got = min_row_sample(df, ["k"], 100, ["_file", "_row"], tail=False, columns=["k", "v"])
    assert got.count() == 100 and got.columns == ["k", "v"]


def test_uniform_sample(spark):
    df = spark.range(50000)
    got = uniform_sample(df, 0.1234567, ["id"])
    share = got.count() / 50000
    assert abs(share - 0.123457) < 0.006
    assert ids(got) == ids(uniform_sample(df.repartition(9), 0.1234567, ["id"]))
    assert uniform_sample(df, 1.0, ["id"]).count() == 50000
    assert uniform_sample(df, 0.0, ["id"]).count() == 0


def test_tail_has_the_expected_size(spark):
    df = spark.range(60000).withColumn("k", F.col("id") % 2)
    n, g = 2000, 30000
    got = min_row_sample(df, ["k"], n, ["id"]).count() / 2
    expected = n + (g - n) * (n / 20) / g
    assert abs(got - expected) < 6 * expected**0.5 / 10


def test_the_fact_is_not_shuffled(spark, skewed):
    df = stratified_sample(skewed, ["k"], ["id"])
    plan = df._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "BroadcastHashJoin" in physical
    assert "Exchange hashpartitioning" not in physical
    assert "Cartesian" not in physical and "NestedLoop" not in physical


def test_the_cutoff_scan_reads_key_and_query_columns_only(spark, skewed):
    seen = []
    original = sampling.pin

    def spy(df, label):
        seen.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return original(df, label)

    sampling.pin, keep = spy, sampling.pin
    try:
        stratified_sample(skewed, ["k"], ["id"])
    finally:
        sampling.pin = keep
    plan = dict(seen)["cutoffs"]
    assert "ReadSchema: struct<id:bigint,k:string>" in plan


def test_small_cutoffs_leave_the_rows_where_they_are(skewed):
    df = stratified_sample(skewed, ["k"], ["id"])
    plan = df._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan[plan.index("== Physical Plan ==") :]


def test_no_hint_forces_a_broadcast(skewed, shuffled_joins):
    df = stratified_sample(skewed, ["k"], ["id"])
    plan = df._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "SortMergeJoin" in physical and "BroadcastExchange" not in physical


def test_a_thin_sample_is_written_in_few_files(skewed, tmp_path):
    from stratafold.session import compact

    thin = uniform_sample(skewed.repartition(40), 0.01, ["id"])
    compact(thin, 0.01).write.parquet(str(tmp_path / "few"))
    assert len(list((tmp_path / "few").glob("*.parquet"))) <= 2
    assert compact(thin, 0.9) is thin


@pytest.mark.parametrize("seed", range(4))
def test_random_tables_with_copies_and_nulls(spark, seed):
    """Strata of all sizes, NULL strata, keys repeated up to dozens of times."""
    rng = random.Random(seed)
    rows = []
    for stratum in [None, *range(rng.randrange(2, 7))]:
        for _ in range(rng.randrange(1, 400)):
            key = rng.randrange(5) if rng.random() < 0.4 else rng.randrange(10**6)
            rows.append((stratum, rng.choice([None, "a", "b"]), key, len(rows)))
    df = spark.createDataFrame(rows, "a bigint, b string, key bigint, seq bigint")
    df = df.repartition(rng.randrange(1, 6))
    n = rng.randrange(1, 40)
    got = min_row_sample(df, ["a", "b"], n, ["key"], order=["seq"], seed=seed, tail=False)
    want = []
    digests = df.withColumn("d", row_digest(["key"], seed)).collect()
    for group in {(r["a"], r["b"]) for r in digests}:
        members = [r for r in digests if (r["a"], r["b"]) == group]
        want += sorted(members, key=lambda r: (r["d"], r["seq"]))[:n]
    assert sorted(r["seq"] for r in got.collect()) == sorted(r["seq"] for r in want)
