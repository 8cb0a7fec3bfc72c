"""Every registered query against its SQL in DuckDB."""

import pytest
from compare import connect, duck_rows, same, spark_rows

import __spark_entry__ as entry
from stratafold.workloads.oracle import ORACLE
from stratafold.workloads.registry import QUERIES


@pytest.fixture(scope="module")
def db(tiny):
    return connect(tiny)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, db, tiny, name):
    assert same(spark_rows(QUERIES[name](spark, tiny)), duck_rows(db, ORACLE[name])) == ""


def test_entry_has_a_row_per_stratum(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6
    for row in rows:
        assert abs(row["est_sum_price"] - row["sum_price"]) / row["sum_price"] < 0.05


def test_evaluate_all_reports_each_sample(spark, tiny):
    rows = QUERIES["evaluate_all"](spark, tiny).collect()
    assert {r["query_id"] for r in rows} == {"flag", "65", "88"}
    assert all(r["missing_group_ratio"] == 0 for r in rows)
    assert all(r["avg_pct_error"] < 0.2 for r in rows)


@pytest.mark.parametrize("name", ["stratified_sample_tail", "min_row_sample_tail"])
def test_joined_samples_read_the_stored_join(spark, tiny, name):
    files = QUERIES[name](spark, tiny).inputFiles()
    assert files and not any(tiny in f for f in files)
