import pytest

from stratafold.operators.joins import join_losses, join_order, null_safe_join, star_join
from stratafold.plans.prejoins import best_prejoin, coverage, prejoins_to_build, serves
from stratafold.sources.prejoin_file import prejoin_specs, read_prejoin_file
from stratafold.spec import JoinPair, PrejoinSpec, QuerySpec, SampleSpec
from stratafold.workloads import tpcds


@pytest.fixture
def tables(spark):
    return {
        "fact": spark.createDataFrame(
            [(1, 10, 7), (2, 10, 8), (3, None, 7), (4, 99, 9), (5, 11, None)],
            "f_id bigint, f_a bigint, f_b bigint",
        ),
        "a": spark.createDataFrame([(10, 100), (11, 101), (12, None)], "a_id bigint, a_c bigint"),
        "b": spark.createDataFrame([(7,), (7,), (8,), (9,)], "b_id bigint"),
        "c": spark.createDataFrame([(100, "x")], "c_id bigint, c_name string"),
    }


PAIRS = [JoinPair("f_a", "a_id"), JoinPair("f_b", "b_id"), JoinPair("a_c", "c_id")]


def test_snowflake_order_and_rows(tables):
    order = join_order("fact", tables, ["c", "a", "b"], PAIRS)
    assert [d for d, _ in order].index("a") < [d for d, _ in order].index("c")
    joined = star_join("fact", tables, ["a", "c"], [PAIRS[0], PAIRS[2]])
    assert sorted(r["f_id"] for r in joined.collect()) == [1, 2]


def test_large_dimensions_take_in_what_is_behind_them(spark, tiny):
    """Without broadcasts the fact is shuffled once for orders and customer together."""
    from stratafold.workloads import tpch

    tables = tpch.load(spark, tiny)
    query = tpch.sales_by_segment_priority()
    want = star_join("lineitem", tables, query.dims, query.pairs)
    columns = sorted(want.columns)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = star_join("lineitem", tables, query.dims, query.pairs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        by_customer = [line for line in moved if "custkey" in line]
        assert len(moved) == 4 and len(by_customer) == 2
        # the rows shuffled by customer are orders, the fact moves by order only
        assert plan.index("l_orderkey") < plan.index("o_custkey")
        assert sorted(map(repr, got.select(*columns).collect())) == sorted(
            map(repr, want.select(*columns).collect())
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_invalid_joins_are_refused(tables, spark):
    with pytest.raises(ValueError, match="no joined table has column"):
        star_join("fact", tables, ["a"], [PAIRS[0], JoinPair("f_b", "b_id")])
    with pytest.raises(ValueError, match="no join pair connects"):
        star_join("fact", tables, ["c"], [])
    twice = {**tables, "d": spark.createDataFrame([(1, 2)], "f_id bigint, d_id bigint")}
    with pytest.raises(ValueError, match="is in both"):
        star_join("fact", twice, ["d"], [JoinPair("f_b", "d_id")])
    with pytest.raises(ValueError):
        null_safe_join(tables["a"], tables["b"], [])
    with pytest.raises(ValueError):
        QuerySpec("q", "fact", ("f_a",), {"a"})


def test_losses_count_orphans_nulls_and_copies(tables):
    got = {
        r["dim"]: (r["dropped_rows"], r["multiplied_rows"])
        for r in join_losses("fact", tables, ["a", "b", "c"], PAIRS).collect()
    }
    # a: one orphan, one NULL; b: one NULL, two rows meet the repeated key;
    # c: of the rows that reach it through a, the one with a_c = 101
    assert got == {"a": (2, 0), "b": (1, 2), "c": (1, 0)}


def test_losses_are_unknown_behind_several_tables(tables, spark):
    tables = {**tables, "d": spark.createDataFrame([(7, 100)], "d_b bigint, d_c bigint")}
    pairs = [PAIRS[0], JoinPair("f_b", "d_b"), JoinPair("a_c", "d_c")]
    rows = join_losses("fact", tables, ["a", "d"], pairs).collect()
    assert {r["dim"]: r["dropped_rows"] for r in rows} == {"a": 2, "d": None}


def test_losses_join_counts_not_rows(tables):
    plan = join_losses("fact", tables, ["a"], PAIRS[:1])._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert text.index("Join") < text.index("Aggregate [f_a")


def test_null_safe_join_matches_nulls(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v bigint")
    right = spark.createDataFrame([(None, 3), ("b", 4)], "k string, w bigint")
    assert null_safe_join(left, right, ["k"]).collect() == [(None, 1, 3)]
    assert null_safe_join(left, right, ["k"], "left_anti").collect() == [("a", 2)]


def test_pairs_are_normalised_and_names_follow_the_content():
    assert JoinPair("b", "a") == JoinPair.parse("a = b") == JoinPair.parse(" b=a ")
    with pytest.raises(ValueError):
        JoinPair.parse("a")
    one = PrejoinSpec("db", "f", {"f", "d"}, [("x", "y")])
    two = PrejoinSpec("db", "f", {"d", "f"}, ["y = x"])
    assert one == two and one.name == two.name
    assert PrejoinSpec("db", "f", {"d", "f"}, ["y = z"]).name != one.name


def test_sample_names():
    plain = SampleSpec("stratified", "f", ("b", "a", "a"))
    assert plain.label == "f__st_2_5760_0_0100__a_b"
    assert SampleSpec("uniform", "f", ratio=0.25).label == "f__uf_0_2500"
    assert SampleSpec("min_row", "f", ("a",), min_rows=50).label == "f__st2_50__a"
    joined = SampleSpec("stratified", "f", ("a", "b"), {"f", "d"}, ["x = y"])
    assert joined.label == plain.label and joined.name != plain.name
    with pytest.raises(ValueError):
        SampleSpec("other", "f", ("a",))
    assert QuerySpec("1", "f", ("a",)).stat_name() == "q1__2_5760__0_0100"


# The queries each prejoin of the described workload covers, by the
# query it was built from.
COVERS = {
    "91": "91",
    "6": "3 6 11_1 42 52 55 58_1 59 65 74_1 76_1 98",
    "7": "3 7 42 52 55 58_1 59 65 76_1 98",
    "13": "13 34 59 65 73 79",
    "26": "20 26 32 58_2 76_2",
    "46": "31_1 34 46 59 65 68 73 79",
    "48": "31_1 48 59 65",
    "62": "62",
    "15": "15",
    "16": "16",
    "33_1": "3 31_1 33_1 42 52 55 58_1 59 60_1 65 76_1 98",
    "33_2": "20 32 33_2 58_2 60_2 76_2",
    "33_3": "12 31_2 33_3 58_3 60_3 76_3 92",
    "39": "39",
    "47": "3 42 43 47 52 53 55 58_1 59 63 65 76_1 89 98",
    "57": "20 32 57 58_2 76_2",
    "88": "88 96",
    "90": "90",
    "11_2": "11_2 74_2",
    "30": "30",
    "81": "81",
    "83_1": "1 83_1",
    "83_2": "83_2",
    "83_3": "83_3",
}


def test_described_workload_needs_24_prejoins():
    queries = tpcds.described()
    assert len(queries) == 59
    chosen = prejoins_to_build(queries, database="ds")
    assert len(chosen) == 24
    sizes = [len(p.tables) for p in chosen]
    assert sizes == sorted(sizes, reverse=True)
    covers = coverage(queries, chosen)
    by_id = {q.id: q for q in queries}
    # query 43 joins its own store table here, so every prejoin with store serves it
    with_store = {"13", "46", "48"}
    for id, expected in COVERS.items():
        got = set(covers[PrejoinSpec.of("ds", by_id[id]).name])
        want = set(expected.split()) | ({"43"} if id in with_store else set())
        assert got == want, id
    assert prejoins_to_build(queries, chosen, "ds") == []


def test_best_prejoin_is_the_smallest_harmless_one():
    query = QuerySpec("q", "f", ("x",), {"d"}, ["f_d = d_id"])
    wide = PrejoinSpec("db", "f", {"d", "e"}, ["f_d = d_id", "e_id = f_e"])
    narrow = PrejoinSpec("db", "f", {"d"}, ["d_id = f_d"])
    other = PrejoinSpec("db", "f", {"d"}, ["d_other = f_d"])
    assert best_prejoin(query, [wide, other, narrow]) == narrow
    assert best_prejoin(query, [wide, other]) == wide
    assert best_prejoin(query, [other]) is None
    assert not serves(wide, query, {wide.name: ["e"]})
    assert serves(narrow, query, {narrow.name: ["d"]})


def test_prejoin_file(spark, tmp_path):
    path = tmp_path / "prejoins.txt"
    path.write_text(
        "ds;p1;item,store_sales;ss_item_sk = i_item_sk\n"
        "ds;p2; date_dim , STORE_SALES;d_date_sk  =  ss_sold_date_sk AND i_x = ss_x\n"
        "ds;no_fact;item,date_dim;a = b\n"
        "\n"
    )
    specs = {p.name: p for p in prejoin_specs(read_prejoin_file(spark, str(path), ["store_sales"]))}
    assert set(specs) == {"p1", "p2"}
    assert specs["p1"].pairs == {JoinPair("i_item_sk", "ss_item_sk")}
    assert specs["p2"].fact == "store_sales"
    assert specs["p2"].tables == {"date_dim", "store_sales"}
    assert specs["p2"].pairs == {
        JoinPair("d_date_sk", "ss_sold_date_sk"),
        JoinPair("i_x", "ss_x"),
    }


def test_described_queries_without_joins():
    bare = {q.id: q for q in (tpcds.on_fact_only(q) for q in tpcds.described())}
    assert len(bare) == 59 and all(not q.dims for q in bare.values())
    assert bare["6_nj"].qcs == ("ss_customer_sk", "ss_item_sk", "ss_sold_date_sk")
    assert bare["34_nj"].qcs == ("ss_hdemo_sk", "ss_sold_date_sk", "ss_store_sk")
    assert bare["91_nj"].qcs == (
        "cr_call_center_sk",
        "cr_returned_date_sk",
        "cr_returning_customer_sk",
    )
