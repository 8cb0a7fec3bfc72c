"""The log in few files, and folders that nothing names any more."""

import pytest
from pyspark.sql import functions as F

from stratafold.engine import Engine
from stratafold.sources import files
from stratafold.sources.store import Store
from stratafold.spec import MIN_ROW, SampleSpec


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), "vacuum")


def folders(store, name):
    return files.children(store.spark, f"{store.root}/{name}")


def test_many_appends_become_one_file_and_lose_nothing(store, spark, tmp_path):
    for i in range(12):
        store.append(("stat", f"k{i % 5}", {"n": i}))
    store.remove("stat", "k0")
    other = Store(spark, str(tmp_path / "s"), "vacuum")
    assert store.compact_log() >= 13
    assert len(store.log().inputFiles()) == 1
    other.append(("stat", "late", {"n": 1}))
    assert len(store.log().inputFiles()) == 2
    fresh = Store(spark, str(tmp_path / "s"), "vacuum")
    assert dict(fresh.entries("stat")) == {
        "k1": {"n": 11}, "k2": {"n": 7}, "k3": {"n": 8}, "k4": {"n": 9}, "late": {"n": 1}
    }
    assert store.compact_log() == 2 and store.compact_log() == 0
    assert Store(spark, str(tmp_path / "s"), "vacuum").latest("stat", "k0") is None


def test_an_interrupted_compaction_changes_nothing(store, spark, tmp_path, monkeypatch):
    for i in range(4):
        store.append(("stat", "k", {"n": i}))
    store.append(("stat", "gone", {"n": 0}))
    store.remove("stat", "gone")
    kept, deletions = files.delete, []

    def once(spark, path):
        if deletions:
            raise OSError("the driver is lost")
        deletions.append(path)
        kept(spark, path)

    monkeypatch.setattr(files, "delete", once)
    with pytest.raises(OSError):
        store.compact_log()
    monkeypatch.setattr(files, "delete", kept)
    again = Store(spark, str(tmp_path / "s"), "vacuum")
    assert dict(again.entries("stat")) == {"k": {"n": 3}}
    again.compact_log()
    assert dict(Store(spark, str(tmp_path / "s"), "vacuum").entries("stat")) == {"k": {"n": 3}}


def test_vacuum_deletes_replaced_versions_only(store, spark):
    store.write("t", spark.range(3))
    store.write("t", spark.range(5), overwrite=True)
    store.append(store.extended("t", spark.range(2)))
    store.write("u", spark.range(1))
    store.remove("table", "u")
    assert store.vacuum() == []  # too young
    assert len(store.vacuum(grace_seconds=-60)) == 2
    assert len(folders(store, "t")) == 2 and folders(store, "u") == []
    assert store.read("t").count() == 7 and not store.exists("u")
    assert store.vacuum(grace_seconds=-60) == []


def test_vacuum_keeps_what_an_engine_needs(store, spark, tmp_path):
    path = str(tmp_path / "f")
    rows = "id", "id % 7 AS k", "1.0D AS v"
    spark.range(500).selectExpr(*rows).write.parquet(path)

    def engine():
        return Engine({"f": spark.read.parquet(path)}, store, {"f": ["id"]})

    kept, dropped = (SampleSpec(MIN_ROW, "f", ("k",), min_rows=n) for n in (9, 20))
    for sample in (kept, dropped):
        engine().create_sample(sample, ["q"])
    engine().drop_sample(dropped)
    assert store.vacuum(grace_seconds=-60)
    assert folders(store, f"{dropped.name}_rows") == []
    spark.range(500, 600).selectExpr(*rows).write.mode("append").parquet(path)
    made = engine()
    made.source_of = None  # the whole fact isn't read again
    assert made.create_sample(kept)
    assert made.sample_rows(kept).groupBy("k").count().where(F.col("count") < 9).isEmpty()
    assert [s for s, _ in made.samples()] == [kept]
