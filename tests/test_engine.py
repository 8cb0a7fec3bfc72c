import pytest
from pyspark.sql import functions as F

from stratafold.engine import Engine
from stratafold.plans.advisor import advise, decide, samples_to_create
from stratafold.operators.joins import star_join
from stratafold.operators.strata import stratum_sizes, summarise, with_targets
from stratafold.sources.store import Store
from stratafold.spec import MIN_ROW, STRATIFIED, UNIFORM, QuerySpec, SampleSpec
from stratafold.workloads import tpch
from stratafold.workloads.star import sql_template, star_query

# Expected decisions per scale: source, columns, strata, ratio, advice.
DECISIONS = [
    ("0.01", "lineitem", "l_returnflag", 3, 0.4534, STRATIFIED),
    ("0.1", "lineitem", "l_returnflag", 3, 0.5000, UNIFORM),
    ("0.01", "lineitem", "l_returnflag,l_linestatus", 6, 0.6239, STRATIFIED),
    ("0.1", "lineitem", "l_returnflag,l_linestatus", 6, 0.1423, STRATIFIED),
    ("0.01", "lineitem", "l_suppkey", 100, 0.9651, "none"),
    ("0.1", "lineitem", "l_suppkey", 1000, 0.9651, "none"),
    ("0.01", "wide", "p_type", 6, 0.6237, STRATIFIED),
    ("0.1", "wide", "p_type", 6, 0.1423, STRATIFIED),
    ("0.01", "wide", "c_mktsegment", 5, 0.5802, STRATIFIED),
    ("0.1", "wide", "c_mktsegment", 5, 0.833, "none"),
    ("0.01", "wide", "o_orderstatus", 3, 0.4534, STRATIFIED),
    ("0.1", "wide", "o_orderstatus", 3, 0.5000, UNIFORM),
    ("0.01", "wide", "c_mktsegment,o_orderpriority", 25, 0.8735, "none"),
    ("0.1", "wide", "c_mktsegment,o_orderpriority", 25, 0.4087, STRATIFIED),
    ("0.01", "wide", "o_orderstatus,p_type", 18, 0.8325, "none"),
    ("0.1", "wide", "o_orderstatus,p_type", 18, 0.3323, STRATIFIED),
    ("0.01", "orders", "o_orderstatus", 3, 0.7684, "none"),
    ("0.1", "orders", "o_orderstatus", 3, 0.2491, STRATIFIED),
    ("0.01", "events", "event_type", 5, 0.8925, "none"),
    ("0.1", "events", "event_type", 5, 0.4534, STRATIFIED),
]


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_decisions(spark, scale):
    tables = tpch.load(spark, f"/root/testdata/sf{scale}")
    expected, queries = {}, []
    wide = tpch.wide_profile()
    for at, source, columns, *want in DECISIONS:
        if at != scale:
            continue
        qcs = tuple(columns.split(","))
        if source == "wide":
            query = QuerySpec(f"wide {columns}", "lineitem", qcs, wide.dims, wide.pairs)
        else:
            query = QuerySpec(f"{source} {columns}", source, qcs)
        queries.append(query)
        expected[query.id] = want
    advice = advise(queries, lambda q: star_join(q.fact, tables, q.dims, q.pairs))
    got = {r["query_id"]: r for r in advice.collect()}
    for id, (strata, ratio, kind) in expected.items():
        row = got[id]
        assert row["group_count"] == strata, id
        assert row["ratio"] == pytest.approx(ratio, abs=5.1e-4), id
        assert row["advice"] == kind, id
    samples = samples_to_create(queries, advice)
    wanted = sum(kind != "none" for _, _, kind in expected.values())
    assert len(samples) == wanted


def test_decision_limits(spark):
    columns = "avg_group_size double, target_sample_size double, population_size bigint"
    rows = [
        (100000.0, 2.0, 3),
        (100000.1, 2.0, 3),
        (150000.0, 2.0, 3),
        (1.0, 2.1, 3),
    ]
    got = decide(spark.createDataFrame(rows, columns)).select("advice", "reason").collect()
    assert [tuple(r) for r in got] == [
        (STRATIFIED, "ok"),
        ("none", "uniform sample too large"),
        (UNIFORM, "ok"),
        ("none", "stratified sample too large"),
    ]


@pytest.fixture
def engine(spark, tiny, tmp_path):
    return Engine(
        tpch.load(spark, tiny), Store(spark, str(tmp_path), "edb"), tpch.KEYS, tpch.ORDERS
    )


def test_workflow_over_prejoins(engine):
    workload = [q for q in tpch.workload() if q.id in ("flag", "42", "47", "91", "43")]
    built = engine.build_prejoins(workload)
    assert [len(p.tables) for p in built] == [5, 3]
    assert engine.build_prejoins(workload) == []
    assert {p.name for p in engine.prejoins()} == {p.name for p in built}
    assert set(engine.lossy_joins().values()) == {()}

    advice = {r["query_id"]: r["advice"] for r in engine.advise(workload).collect()}
    assert set(advice.values()) == {"none"}  # too little data for a sample to pay

    by_id = {q.id: q for q in workload}
    made = SampleSpec(
        MIN_ROW, "lineitem", by_id["42"].qcs, by_id["42"].tables, by_id["42"].pairs, min_rows=100
    )
    assert engine.create_sample(made, ["42"])
    assert not engine.create_sample(made, ["42"])
    assert not engine.create_sample(made, ["47"])
    assert engine.samples() == [(made, ("42", "47"))]
    assert engine.sample_rows(made).columns == engine.tables["lineitem"].columns
    assert engine.store.analyzed(made.name)

    report = {r["query_id"]: r for r in engine.evaluate_all(workload).collect()}
    assert set(report) == {"42", "47"}
    for row in report.values():
        assert row["missing_group_ratio"] == 0
        assert row["avg_rel_error"] < 0.25
    one = engine.evaluate_sample(made.label, ["42"], workload, measure_time=True).first()
    assert one["exact_seconds"] > 0 and one["sample_seconds"] > 0
    assert one["avg_rel_error"] == report["42"]["avg_rel_error"]
    with pytest.raises(LookupError):
        engine.evaluate_sample("nothing", ["42"], workload)
    engine.drop_sample(made)
    assert engine.samples() == []


def test_profiles_are_stored_once_and_shared(engine, monkeypatch):
    first = QuerySpec("a", "lineitem", ("l_returnflag",))
    second = QuerySpec("b", "lineitem", ("l_returnflag",))
    third = QuerySpec("c", "lineitem", ("l_linestatus", "l_returnflag"))
    engine.profile([first, second, third])
    assert len(engine.store.entries("stat")) == 2
    want = stratum_sizes(engine.tables["lineitem"], list(third.qcs))
    got = engine.sizes(third)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    summary = summarise(with_targets(want)).first().asDict()
    assert engine.store.latest("stat", third.profile_name) == pytest.approx(summary)
    before = engine.store.log().count()
    engine.profile([first, third])
    assert engine.store.log().count() == before
    with pytest.raises(LookupError):
        engine.sizes(QuerySpec("d", "lineitem", ("l_tax",)))


def test_uniform_and_advised_samples(engine, monkeypatch):
    import stratafold.plans.advisor as advisor

    monkeypatch.setattr(advisor, "UNIFORM_THRESHOLD", 500)
    flag = tpch.revenue_by_flag()
    samples = engine.create_advised([flag])
    assert [s.kind for s in samples] == [UNIFORM]
    assert samples[0].ratio == pytest.approx(0.5, abs=0.01)
    row = engine.evaluate_all([flag]).first()
    assert row["avg_rel_error"] < 0.1 and row["sample_groups"] == 6


def test_a_lossy_prejoin_does_not_stand_in_for_a_smaller_one(spark, tmp_path):
    tables = {
        "fact": spark.createDataFrame(
            [(i, i % 5, None if i % 4 == 0 else i % 3, float(i)) for i in range(200)],
            "f_id bigint, f_a bigint, f_b bigint, f_v double",
        ),
        "a": spark.range(5).select(F.col("id").alias("a_id"), (F.col("id") % 2).alias("a_k")),
        "b": spark.range(3).select(F.col("id").alias("b_id")),
    }
    engine = Engine(tables, Store(spark, str(tmp_path), "lossy"), {"fact": ("f_id",)})
    large = QuerySpec("large", "fact", ("a_k",), {"a", "b"}, ["f_a = a_id", "f_b = b_id"])
    small = QuerySpec("small", "fact", ("a_k",), {"a"}, ["f_a = a_id"])
    built = engine.build_prejoins([large, small])
    assert [len(p.tables) for p in built] == [3, 2]
    assert engine.source_of(small).count() == 200
    assert engine.source_of(large).count() == 150
    engine.profile([large, small])
    assert engine.sizes(small).agg(F.sum("groupsize")).first()[0] == 200
    assert engine.sizes(large).agg(F.sum("groupsize")).first()[0] == 150


def test_a_grown_fact_is_profiled_again(spark, tmp_path):
    path = str(tmp_path / "fact")
    spark.range(100).select("id", F.lit("old").alias("k")).write.parquet(path)
    tables = {"fact": spark.read.parquet(path)}
    store = Store(spark, str(tmp_path / "s"), "grown")
    spec = SampleSpec(MIN_ROW, "fact", ("k",), min_rows=10)
    Engine(tables, store, {"fact": ("id",)}).create_sample(spec)
    spark.range(100, 150).select("id", F.lit("new").alias("k")).write.mode("append").parquet(path)
    engine = Engine({"fact": spark.read.parquet(path)}, store, {"fact": ("id",)})
    engine.create_sample(spec, overwrite=True)
    counts = {r["k"]: r["count"] for r in engine.sample_rows(spec).groupBy("k").count().collect()}
    assert set(counts) == {"old", "new"} and min(counts.values()) >= 10


def test_missing_prejoin_is_an_error(engine):
    with pytest.raises(LookupError):
        engine.profile([tpch.sales_by_type()])
    with pytest.raises(ValueError):
        engine.create_min_row_sample(["part"], ["p_type"], 5)


def test_loaded_prejoins(engine, tmp_path):
    query = tpch.sales_by_weekday()
    joined = star_join(query.fact, engine.tables, query.dims, query.pairs)
    engine.store.write("mine", joined)
    path = tmp_path / "p.txt"
    pairs = " AND ".join(f"{p.right} = {p.left}" for p in query.pairs)
    tables = ",".join(query.tables)
    path.write_text(f"edb;mine;{tables};{pairs}\nedb;gone;{tables};{pairs}\n")
    assert [p.name for p in engine.load_prejoins(str(path))] == ["mine"]
    assert [p.name for p in engine.prejoins()] == ["mine"]
    assert engine.source_of(query).count() == joined.count()


def test_min_row_sample_over_several_tables(engine):
    query = tpch.sales_by_weekday()
    engine.build_prejoins([query])
    spec = engine.create_min_row_sample(
        ["nation", "supplier", "lineitem"], ["n_regionkey"], 900, [str(p) for p in query.pairs]
    )
    rows = star_join(
        "lineitem", {**engine.tables, "lineitem": engine.sample_rows(spec)}, query.dims, query.pairs
    )
    counts = [r["count"] for r in rows.groupBy("n_regionkey").count().collect()]
    assert counts and min(counts) >= 600
    # strata of the sample are coarser than those of the query
    row = engine.evaluate_sample(spec.name, ["43"], [query]).first()
    assert row["avg_rel_error"] < 1.0


def test_sql_text_as_template(engine):
    text = (
        "SELECT c_mktsegment, sum(l_quantity) AS qty, count(*) AS groupsize "
        "FROM {fact}, {orders}, {customer} "
        "WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey GROUP BY c_mktsegment"
    )
    base = tpch.sales_by_segment_priority()
    query = QuerySpec(
        "sql",
        "lineitem",
        ("l_returnflag",),
        groups=("c_mktsegment",),
        aggs=("qty",),
        template=sql_template(text),
    )
    want = base.template(engine.tables["lineitem"], engine.tables)
    got = {r["c_mktsegment"]: r["groupsize"] for r in engine.answer(query).collect()}
    assert got == {r["c_mktsegment"]: r["groupsize"] for r in want.collect()}
    spec = SampleSpec(MIN_ROW, "lineitem", ("l_returnflag",), min_rows=900)
    engine.create_sample(spec, ["sql"])
    row = engine.evaluate_all([query]).first()
    assert row["avg_pct_error"] == row["self_scaled_error"] < 0.2
    with pytest.raises(ValueError):
        engine.approximate(query, spec)


def test_star_query_without_dimensions_reads_two_columns(spark, tiny):
    query = star_query("x", "orders", [], [], ["o_orderstatus"], ["o_orderstatus"],
                       sums={"s": F.col("o_totalprice")})
    tables = tpch.load(spark, tiny)
    plan = query.template(tables["orders"], tables)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in plan
