"""Exact answers that are not timed read the joins that are stored."""

from pyspark.sql import functions as F

from stratafold.engine import Engine
from stratafold.sources.store import Store
from stratafold.spec import MIN_ROW, SampleSpec
from stratafold.workloads.star import star_query


def test_exact_answers_read_the_stored_join(spark, tmp_path):
    rows = "f_id bigint, f_a bigint, f_v double"
    tables = {
        "fact": spark.createDataFrame([(i, i % 6, float(i)) for i in range(200)], rows),
        "a": spark.range(5).select(F.col("id").alias("a_id"), (F.col("id") % 2).alias("a_k")),
    }
    query = star_query("q", "fact", ["f_a = a_id"], ["a"], ["a_k"], ["a_k"], {"v": F.col("f_v")})
    engine = Engine(tables, Store(spark, str(tmp_path / "s"), "stored"), {"fact": ("f_id",)})
    assert not engine._answer_from_prejoin(query).inputFiles()  # no prejoin yet
    [made] = engine.build_prejoins([query])
    answer = engine._answer_from_prejoin(query)
    assert all(made.name in path for path in answer.inputFiles()) and answer.inputFiles()
    assert sorted(answer.collect()) == sorted(engine.answer(query).collect())
    spec = SampleSpec(MIN_ROW, "fact", query.qcs, query.tables, query.pairs, min_rows=10)
    assert engine.evaluate(query, spec).first()["exact_groups"] == 2

    # a prejoin of another state of its tables does not answer
    engine.tables = {**tables, "a": tables["a"].where("a_id < 4")}
    assert not engine._answer_from_prejoin(query).inputFiles()
    assert engine._answer_from_prejoin(query).agg(F.sum("groupsize")).first()[0] == 134
