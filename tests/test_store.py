from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratafold.sources.log import DELETED, LOG_SCHEMA, latest, live_entries
from stratafold.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path), "testdb")


def test_latest_version_wins_and_tombstones_hide(spark):
    day = datetime
    rows = [
        ("stat", "a", "old", day(2024, 1, 1)),
        ("stat", "a", "new", day(2024, 1, 2)),
        ("stat", "b", "one", day(2024, 1, 3)),
        ("stat", "b", DELETED, day(2024, 1, 4)),
        ("stat", "c", DELETED, day(2024, 1, 5)),
        ("stat", "c", "again", day(2024, 1, 6)),
        ("sample", "a", "other type", day(2024, 1, 7)),
    ]
    log = spark.createDataFrame(rows, LOG_SCHEMA).repartition(3)
    got = {(r["type"], r["key"]): r["value"] for r in latest(log).collect()}
    assert got == {
        ("stat", "a"): "new",
        ("stat", "c"): "again",
        ("sample", "a"): "other type",
    }
    assert [r["key"] for r in live_entries(log, "stat").collect()] == ["c", "a"]
    assert [r["key"] for r in live_entries(log, "stat", "a").collect()] == ["a"]


def test_log_survives_quotes_and_other_sessions(store, spark, tmp_path):
    text = "it's \"null\"; DROP TABLE x"
    store.append(("stat", "k", {"text": text, "nothing": None}))
    store.append(("stat", "k2", {"n": 1}), ("stat", "k", {"text": text, "nothing": 2}))
    again = Store(spark, str(tmp_path), "testdb")
    assert again.latest("stat", "k") == {"text": text, "nothing": 2}
    assert [k for k, _ in again.entries("stat")] == ["k", "k2"] == [k for k, _ in store.entries("stat")]
    again.remove("stat", "k")
    assert store.latest("stat", "k") is not None
    store.refresh()
    assert store.latest("stat", "k") is None
    assert store.log().where("key = 'k'").count() == 3


def test_write_skip_overwrite_and_read(store, spark):
    one, two = spark.range(3), spark.range(5)
    assert store.write("t", one) and store.exists("t")
    assert not store.write("t", two)
    assert store.read("t").count() == 3
    before = store.read("t")
    assert store.write("t", two, overwrite=True)
    assert store.read("t").count() == 5
    assert before.count() == 3  # the old version stays readable
    assert store.columns("t") == ["id"]
    with pytest.raises(LookupError):
        store.read("missing")


def test_a_table_whose_files_are_gone_does_not_exist(store, spark, tmp_path):
    store.append(Store.table_entry("ghost", str(tmp_path / "nowhere"), spark.range(1).schema))
    assert not store.exists("ghost")


def test_overwriting_a_table_with_itself_is_safe(store, spark):
    store.write("t", spark.range(10))
    store.write("t", store.read("t").where(F.col("id") > 3), overwrite=True)
    assert store.read("t").count() == 6


def test_statistics(store, spark):
    store.write("t", spark.range(10))
    assert not store.analyzed("t")
    store.analyze("t")
    assert store.analyzed("t")
    assert spark.table(store.register("t")).count() == 10
