"""Beyond the broadcast limit: only rows that can be in a sample are shuffled."""

import pytest
from pyspark.sql import functions as F

from stratafold.operators import sampling
from stratafold.operators.sampling import min_row_sample, stratified_sample
from stratafold.operators.strata import stratum_sizes
from stratafold.workloads import registry


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def shuffled(df):
    """Rows that each shuffle of an executed plan wrote."""
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_a_sample_of_many_strata_moves_little_more_than_itself(spark, small, no_broadcast):
    df = registry.min_row_sample_orders(spark, small)
    kept = len(df.collect())
    moved = shuffled(df)
    assert kept < 30_000 and len(moved) == 2
    assert max(moved) < 1.1 * kept  # rows of the fact, of 60,000
    assert sum(moved) < 2 * kept


@pytest.mark.parametrize("buckets", [1, 7, 1 << 18])
@pytest.mark.parametrize("tail", [False, True])
def test_the_filter_changes_no_sample(spark, no_broadcast, monkeypatch, buckets, tail):
    source = spark.range(6000).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 11 <> 0 THEN CAST(id % 500 AS string) END AS k",
    )

    def ids(df):
        return sorted(r.id for r in df.collect())

    monkeypatch.setattr(sampling, "BUCKETS", buckets)
    got = [
        ids(min_row_sample(source, ["k"], 5, ["id"], tail=tail)),
        ids(stratified_sample(source, ["k"], ["id"], tail=tail)),
    ]
    monkeypatch.setattr(sampling, "fits_broadcast", lambda df: True)
    assert got == [
        ids(min_row_sample(source, ["k"], 5, ["id"], tail=tail)),
        ids(stratified_sample(source, ["k"], ["id"], tail=tail)),
    ]


def test_sizes_of_another_state_are_noticed(spark, no_broadcast):
    source = spark.range(900).selectExpr("id", "id % 30 AS k")
    sizes = stratum_sizes(source, ["k"])
    assert min_row_sample(source, ["k"], 3, ["id"], sizes=sizes, tail=False).count() == 90
    for other in (
        sizes.where("k <> 7"),
        sizes.withColumn("groupsize", F.when(F.col("k") == 7, 29).otherwise(F.col("groupsize"))),
        sizes.union(spark.range(1).selectExpr("30L AS k", "1L AS groupsize")),
    ):
        with pytest.raises(ValueError, match="no size or another"):
            min_row_sample(source, ["k"], 3, ["id"], sizes=other)
