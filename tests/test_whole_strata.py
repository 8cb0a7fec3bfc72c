"""Strata that are kept whole need no limits."""

import pytest
from pyspark.sql import functions as F

from stratafold.functions.sizing import at_least
from stratafold.operators.sketch import KEPT, Shape, build_sketch
from stratafold.operators.strata import stratum_sizes
from stratafold.session import pin
from test_likely_rows import shuffled


@pytest.fixture
def limit(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, before)


@pytest.fixture
def source(spark):
    """Some 6,000 strata of one or two rows, one NULL among them, and two of 500 rows."""
    row = F.col("id")
    k = F.when(row < 1000, row % 2 - 2).when(row == 1500, None).otherwise(F.floor(row * 2 / 3))
    return pin(spark.range(10_000).select(row, k.cast("long").alias("k")), "source")


def drawn(source, sizes, moved=None):
    def save(df, part):
        saved = pin(df, part)
        if part == "rows" and moved is not None:
            df.collect()
            moved.append(max(shuffled(df), default=0))
        return saved

    shape = Shape(("k",), ("id",), at_least(50), source.columns)
    rows = build_sketch(shape, source, sizes, save=save).rows
    return sorted(tuple(r) for r in rows.select("id", "k", KEPT).collect())


def test_rows_of_strata_kept_whole_are_not_shuffled(source, limit):
    sizes = pin(stratum_sizes(source, ["k"]), "sizes")
    expected = drawn(source, sizes)
    assert sum(kept for *_, kept in expected) >= 9100
    limit(20_000)  # all limits don't fit, those of the two large strata do
    moved = []
    assert drawn(source, sizes, moved) == expected
    assert moved == [0]


def test_beyond_the_limit_a_row_without_a_size_is_an_error(source, limit):
    sizes = pin(stratum_sizes(source, ["k"]).where("k <> 5000"), "sizes")
    limit(20_000)
    with pytest.raises(ValueError, match="no size"):
        drawn(source, sizes)
