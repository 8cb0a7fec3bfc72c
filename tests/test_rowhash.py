import hashlib

from pyspark.sql import functions as F

from stratafold.functions.rowhash import (
    EVERYTHING,
    SCALE,
    literal_threshold,
    row_digest,
    second_draw,
    threshold,
    with_position,
)


def test_digest_is_md5_of_seed_and_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k bigint, s string")
    got = [r[0] for r in df.orderBy("k").select(row_digest(["k", "s"], 7)).collect()]
    want = [hashlib.md5(t.encode()).hexdigest() for t in ("7|1|a", "7|2|~")]
    assert got == want


def test_threshold_compares_like_the_number(spark):
    probabilities = [0.0, 2**-52, 0.001, 0.25, 1 / 3, 0.5, 0.999999, 1.0, 7.0, -1.0]
    df = spark.range(3000).withColumn("d", row_digest(["id"]))
    for p in probabilities:
        assert df.select(threshold(F.lit(p)).alias("t")).first()["t"] == literal_threshold(p)
        number = F.conv(F.substring("d", 1, 13), 16, 10).cast("double") / SCALE
        wrong = df.where((F.col("d") < literal_threshold(p)) != (number < p))
        assert wrong.count() == 0
    assert literal_threshold(1.0) == EVERYTHING


def test_draws_are_uniform_and_independent(spark):
    df = spark.range(20000).withColumn("d", row_digest(["id"], "seed"))
    low, second = F.col("d") < literal_threshold(0.3), second_draw(F.col("d"))
    other = second < literal_threshold(0.2)
    a, b, both = df.agg(
        F.avg(low.cast("int")), F.avg(other.cast("int")), F.avg((low & other).cast("int"))
    ).first()
    assert abs(a - 0.3) < 0.015 and abs(b - 0.2) < 0.015 and abs(both - 0.06) < 0.01


def test_position_tells_copies_apart(spark, tmp_path):
    path = str(tmp_path / "copies")
    spark.range(1000).select(F.lit(1).alias("v")).repartition(3).write.parquet(path)
    df = with_position(spark.read.parquet(path))
    assert df.select("_file", "_row").distinct().count() == 1000


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from stratafold.session import scratch_root

    nothing = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: nothing, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(SimpleNamespace(conf=nothing, sparkContext=context))
    shared = SimpleNamespace(get=lambda *_: "hdfs:///shared/")
    assert scratch_root(SimpleNamespace(conf=shared, sparkContext=context)) == "hdfs:///shared"
