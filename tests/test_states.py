"""Artefacts that were made of another state of the tables, and answers from uniform samples."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratafold.engine import Engine
from stratafold.functions.state import state_of
from stratafold.session import literal_rows
from stratafold.sources.log import LOG_SCHEMA
from stratafold.sources.prejoin_file import read_prejoin_file
from stratafold.sources.store import Store
from stratafold.spec import STRATIFIED, UNIFORM, SampleSpec
from stratafold.workloads.star import star_query


def stored(spark, df, path):
    df.write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def sales(spark, rows, strata="id % 4"):
    return spark.range(rows).selectExpr("id", f"cast({strata} as string) AS k", "id % 2 AS g", "1.0D AS v")


def query(**more):
    options = dict(groups=["g"], sums={"total": F.col("v")}, counts=["n"]) | more
    return star_query("q", "f", [], [], ["k"], **options)


def engine(spark, frame, folder, name):
    return Engine({"f": frame}, Store(spark, str(folder), name), {"f": ["id"]})


def test_uniform_answers_count_strata_of_which_nothing_was_drawn(spark, tmp_path):
    # half of the rows lie in strata of one row
    frame = stored(spark, sales(spark, 40_000, "if(id < 20000, id % 5, id)"), tmp_path / "f")
    made = engine(spark, frame, tmp_path / "s", "uniform")
    sample = SampleSpec(UNIFORM, "f", ("k",), ratio=0.1)
    made.create_sample(sample, ["q"])
    for row in made.approximate(query(), sample).collect():
        assert row.total == pytest.approx(20_000, rel=0.05)
        assert row.n == pytest.approx(20_000, rel=0.05)


def test_changed_rows_make_a_new_profile_at_the_same_count(spark, tmp_path):
    frame = stored(spark, sales(spark, 100, "'old'"), tmp_path / "f")
    sample = SampleSpec(STRATIFIED, "f", ("k",))
    first = engine(spark, frame, tmp_path / "s", "changed")
    first.create_sample(sample, ["q"])
    frame = stored(spark, sales(spark, 100, "'new'"), tmp_path / "g")
    later = engine(spark, frame, tmp_path / "s", "changed")
    later.create_sample(sample, ["q"], overwrite=True)
    assert later.sample_rows(sample).select("k").distinct().first().k == "new"


def test_report_follows_the_grown_fact(spark, tmp_path):
    sample = SampleSpec(STRATIFIED, "f", ("k",))
    for rows in (1000, 2000):
        frame = stored(spark, sales(spark, rows), tmp_path / f"f{rows}")
        made = engine(spark, frame, tmp_path / "s", "grown")
        made.create_sample(sample, ["q"], overwrite=True)
        report = made.evaluate(query(), sample).first()
        assert report.avg_pct_error == pytest.approx(0, abs=1e-9)


def test_sessions_that_add_queries_lose_none(spark, tmp_path):
    frame = stored(spark, sales(spark, 100), tmp_path / "f")
    sample = SampleSpec(STRATIFIED, "f", ("k",))
    engine(spark, frame, tmp_path / "s", "two").create_sample(sample, ["q1"])
    a, b = (engine(spark, frame, tmp_path / "s", "two") for _ in range(2))
    a.create_sample(sample, ["q2"])
    b.create_sample(sample, ["q3"])
    fresh = engine(spark, frame, tmp_path / "s", "two")
    assert fresh.samples()[0][1] == ("q1", "q2", "q3")


def test_a_lagging_clock_still_removes(spark, tmp_path):
    store = Store(spark, str(tmp_path), "clock")
    ahead = datetime.now(UTC) + timedelta(hours=1)
    literal_rows(spark, [("stat", "x", "{}", ahead)], LOG_SCHEMA).write.mode("append").parquet(
        store.log_path
    )
    later = Store(spark, str(tmp_path), "clock")
    later.remove("stat", "x")
    later.refresh()
    assert later.latest("stat", "x") is None


def test_empty_fact_gets_the_advice_none(spark, tmp_path):
    frame = stored(spark, sales(spark, 0), tmp_path / "f")
    row = engine(spark, frame, tmp_path / "s", "empty").advise([query()]).first()
    assert (row.advice, row.group_count) == ("none", 0)


def test_malformed_prejoin_lines_are_errors(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("ds;p1;item,store_sales\n")
    with pytest.raises(Exception, match="fewer than four fields"):
        read_prejoin_file(spark, str(path), ["store_sales"]).collect()


def test_register_leaves_foreign_tables_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "foreign")
    spark.range(3).write.option("path", str(tmp_path / "mine")).saveAsTable("foreign.t")
    store.write("t", spark.range(5).toDF("id"))
    assert spark.table(store.register("t")).count() == 5
    assert spark.table("foreign.t").count() == 3
    store.analyze("t")
    elsewhere = Store(spark, str(tmp_path / "other"), "foreign")
    assert store.analyzed("t") and not elsewhere.analyzed("t")


def test_states(spark, tmp_path):
    a = stored(spark, sales(spark, 10), tmp_path / "a")
    assert state_of(a) == state_of(spark.read.parquet(str(tmp_path / "a")))
    assert state_of(a) != state_of(stored(spark, sales(spark, 11), tmp_path / "b"))
    assert state_of(sales(spark, 10)) == state_of(sales(spark, 10)) != state_of(sales(spark, 9))
