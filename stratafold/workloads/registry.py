"""The queries offered to the driver, one per operator. Each reads the given tables whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratafold.engine import Engine
from stratafold.operators import approx, evaluate, joins, sampling, strata
from stratafold.plans import advisor, prejoins
from stratafold.session import compact, literal_rows, pin, scratch_path
from stratafold.sources.log import DELETED, latest, live_entries
from stratafold.sources.prejoin_file import prejoin_specs, read_prejoin_file
from stratafold.sources.store import Store
from stratafold.spec import MIN_ROW, STRATIFIED, UNIFORM, PrejoinSpec, QuerySpec, SampleSpec
from stratafold.workloads import tpch
from stratafold.workloads.star import money

FLAGS = ["l_returnflag", "l_linestatus"]
FLAG_ROWS = 500
NATION_ROWS = 200
JOINED_ROWS = 100
UNIFORM_RATIO = 0.1
ORDER_ROWS = 2
# strata above this average get a uniform sample where the advice is to reach it at every scale
UNIFORM_ABOVE = 100
CHANNEL_QCS = ["c_nationkey", "o_year"]
CHANNEL_YEAR = 1999
# means of errors in steps of 1e-5: fewer digits could fall on a tie
ERROR_DIGITS = 8


# -- shared steps ----------------------------------------------------------------


def _options(fact: str) -> dict:
    return dict(key=tpch.KEYS[fact], order=tpch.ORDERS.get(fact, ()))


def _source(tables, query: QuerySpec) -> DataFrame:
    return joins.star_join(query.fact, tables, query.dims, query.pairs)


def _stored_source(tables, query: QuerySpec) -> DataFrame:
    """The fact, or its join stored once with the strata: sizes, cut-offs and rows all read it."""
    fact = tables[query.fact]
    if not query.dims:
        return fact
    columns = dict.fromkeys([*fact.columns, *query.qcs])
    return pin(_source(tables, query).select(*columns), "prejoin")


def _sizes(source: DataFrame, qcs) -> DataFrame:
    return pin(strata.stratum_sizes(source, qcs), "sizes")


def _sampled(tables, query: QuerySpec, **more) -> tuple[DataFrame, DataFrame]:
    """A stored stratified sample for a query, and the sizes of its strata."""
    source = _stored_source(tables, query)
    sizes = _sizes(source, query.qcs)
    sample = sampling.stratified_sample(
        source,
        query.qcs,
        sizes=sizes,
        columns=tables[query.fact].columns,
        **_options(query.fact),
        **more,
    )
    return pin(compact(sample), "sample"), sizes


def _rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def _flag_answers(tables) -> tuple[QuerySpec, DataFrame, DataFrame, DataFrame]:
    query = tpch.revenue_by_flag()
    sample, sizes = _sampled(tables, query)
    return query, query.template(tables["lineitem"], tables), sample, sizes


def _engine(spark: SparkSession, tables) -> Engine:
    store = Store(spark, scratch_path(spark, "store"), "shop")
    return Engine(tables, store, tpch.KEYS, tpch.ORDERS)


# -- stratum statistics ----------------------------------------------------------


def stratum_sizes(spark, folder):
    lineitem = tpch.load(spark, folder)["lineitem"]
    return strata.stratum_sizes(lineitem, [*FLAGS, "l_suppkey"])


def stratum_targets(spark, folder):
    orders = tpch.load(spark, folder)["orders"]
    sizes = strata.stratum_sizes(orders, ["o_orderstatus", "o_orderpriority"])
    return _rounded(strata.with_targets(sizes), 6)


def stratum_summary(spark, folder):
    source = _source(tpch.load(spark, folder), tpch.sales_by_type())
    stats = strata.with_targets(strata.stratum_sizes(source, ["p_type", "o_orderstatus"]))
    return _rounded(strata.summarise(stats), 4)


def window_groupsize(spark, folder):
    lineitem = tpch.load(spark, folder)["lineitem"]
    rows = strata.with_group_size(lineitem, _sizes(lineitem, FLAGS), FLAGS)
    return rows.select(*tpch.KEYS["lineitem"], *FLAGS, "groupsize")


# -- samples ---------------------------------------------------------------------


def uniform_sample(spark, folder):
    lineitem = tpch.load(spark, folder)["lineitem"]
    return sampling.uniform_sample(lineitem, UNIFORM_RATIO, tpch.KEYS["lineitem"])


def stratified_sample(spark, folder):
    lineitem = tpch.load(spark, folder)["lineitem"]
    return sampling.stratified_sample(lineitem, FLAGS, tail=False, **_options("lineitem"))


def stratified_sample_tail(spark, folder):
    tables = tpch.load(spark, folder)
    query = tpch.sales_by_type()
    return sampling.stratified_sample(
        _stored_source(tables, query),
        query.qcs,
        columns=tables["lineitem"].columns,
        **_options("lineitem"),
    )


def min_row_sample(spark, folder):
    lineitem = tpch.load(spark, folder)["lineitem"]
    return sampling.min_row_sample(lineitem, FLAGS, FLAG_ROWS, tail=False, **_options("lineitem"))


def min_row_sample_tail(spark, folder):
    tables = tpch.load(spark, folder)
    return sampling.min_row_sample(
        _stored_source(tables, tpch.sales_by_weekday()),
        ["n_name"],
        NATION_ROWS,
        columns=tables["lineitem"].columns,
        **_options("lineitem"),
    )


def min_row_sample_orders(spark, folder):
    """As many strata as orders, most of them of a few rows."""
    lineitem = tpch.load(spark, folder)["lineitem"]
    return sampling.min_row_sample(
        lineitem, ["l_orderkey"], ORDER_ROWS, tail=False, **_options("lineitem")
    )


def sample_roundtrip(spark, folder):
    """Created, skipped because it exists, overwritten, and read back from the store."""
    engine = _engine(spark, tpch.load(spark, folder))
    spec = engine.create_min_row_sample(["lineitem"], FLAGS, FLAG_ROWS)
    engine.create_sample(spec)
    engine.create_sample(spec, ["flag"], overwrite=True)
    return engine.sample_rows(spec)


# -- advice ----------------------------------------------------------------------


def advise_one(spark, folder):
    lineitem = tpch.load(spark, folder)["lineitem"]
    stats = strata.with_targets(strata.stratum_sizes(lineitem, FLAGS))
    return _rounded(advisor.decide(strata.summarise(stats)), 4)


def advise_workload(spark, folder):
    tables = tpch.load(spark, folder)
    return _rounded(advisor.advise(tpch.workload(), lambda q: _source(tables, q)), 4)


def advised_uniform_sample(spark, folder):
    """The sample that is advised for large strata, at the advised rate."""
    tables, query = tpch.load(spark, folder), tpch.revenue_by_flag()
    advice = advisor.advise([query], lambda q: tables[q.fact], uniform_above=UNIFORM_ABOVE)
    made = advisor.samples_to_create([query], advice)
    rate = next((s.ratio for s in made if s.kind == UNIFORM), 0.0)
    return sampling.uniform_sample(tables[query.fact], rate, tpch.KEYS[query.fact])


# -- prejoins --------------------------------------------------------------------


def prejoin_star(spark, folder):
    tables = tpch.load(spark, folder)
    return joins.star_join(
        "lineitem",
        tables,
        ["orders", "part", "supplier"],
        PrejoinSpec("shop", "lineitem", (), [tpch.ORDER, tpch.PART, tpch.SUPPLIER]).pairs,
    )


def prejoin_snowflake(spark, folder):
    tables = tpch.load(spark, folder)
    pairs = [tpch.ORDER, tpch.CUSTOMER, "c_nationkey = n_nationkey", "n_regionkey = r_regionkey"]
    dims = ["orders", "customer", "nation", "region"]
    return joins.star_join(
        "lineitem", tables, dims, PrejoinSpec("shop", "lineitem", dims, pairs).pairs
    )


def _per_prejoin(tables, specs: list[PrejoinSpec], columns) -> DataFrame:
    """One row per prejoin: what ``columns(spec)`` computes over the joined rows."""
    rows = [
        joins.star_join(p.fact, tables, p.tables - {p.fact}, p.pairs).agg(*columns(p))
        for p in specs
    ]
    return reduce(DataFrame.unionByName, rows)


def prejoin_cover(spark, folder):
    """The prejoins the workload needs, the queries each covers, and its rows."""
    tables, workload = tpch.load(spark, folder), tpch.workload()
    chosen = prejoins.prejoins_to_build(workload, database="shop")
    covers = prejoins.coverage(workload, chosen)
    return _per_prejoin(
        tables,
        chosen,
        lambda p: [
            F.lit(",".join(sorted(p.tables))).alias("tables"),
            F.lit(",".join(sorted(covers[p.name]))).alias("covers"),
            F.count("*").alias("row_count"),
            F.sum(money("l_extendedprice")).cast("double").alias("sum_price"),
        ],
    )


def prejoin_best_match(spark, folder):
    """For each query the smallest prejoin that serves it, used to add up the fact."""
    tables = tpch.load(spark, folder)
    queries = [q for q in tpch.workload() if q.dims]
    available = prejoins.prejoins_to_build(queries, database="shop")
    available.append(PrejoinSpec.of("shop", tpch.sales_by_type()))
    match = {q.id: prejoins.best_prejoin(q, available) for q in queries}
    used = [p for p in available if p in match.values()]
    totals = _per_prejoin(
        tables,
        used,
        lambda p: [
            F.lit(",".join(sorted(p.tables))).alias("tables"),
            F.array(*(F.lit(i) for i, m in match.items() if m == p)).alias("ids"),
            F.sum(money("l_quantity")).cast("double").alias("sum_qty"),
        ],
    )
    return totals.select(F.explode("ids").alias("query_id"), "tables", "sum_qty")


def load_prejoin_file(spark, folder):
    """Prejoins described as text, parsed by Spark, and the rows each one holds."""
    tables = tpch.load(spark, folder)
    path = scratch_path(spark, "prejoins")
    described = ["dim;none;nation,region;n_regionkey = r_regionkey"] + [
        f"shop;pre_{q.id};{','.join(sorted(q.tables))};"
        + " AND ".join(f"{p.right} = {p.left}" for p in sorted(q.pairs))
        for q in (tpch.sales_by_type(), tpch.sales_by_weekday())
    ]
    literal_rows(
        spark, [(line,) for line in described], StructType.fromDDL("value string")
    ).write.text(path)
    specs = prejoin_specs(read_prejoin_file(spark, path, list(tpch.KEYS)))
    return _per_prejoin(
        tables,
        specs,
        lambda p: [
            F.lit(p.name).alias("name"),
            F.lit(" AND ".join(map(str, sorted(p.pairs)))).alias("pairs"),
            F.count("*").alias("row_count"),
        ],
    )


def semi_join_filter(spark, folder):
    tables = tpch.load(spark, folder)
    return (
        tpch.active_segments(tables)
        .groupBy("c_nationkey", "c_mktsegment")
        .agg(F.count("*").alias("customers"))
    )


def semi_join_buyers(spark, folder):
    """An IN subquery that removes customers at every scale."""
    buyers = tpch.buyers(tpch.load(spark, folder), CHANNEL_YEAR)
    return buyers.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("customers"))


def null_strata(spark, folder):
    """Strata of a left join, and among them those with IS NULL: customers without an order."""
    joined = tpch.customers_with_orders(tpch.load(spark, folder), CHANNEL_YEAR)
    sizes = strata.stratum_sizes(joined, ["c_mktsegment", "o_orderstatus"])
    return sizes.withColumn("without_order", F.col("o_orderstatus").isNull())


# -- exact answers ---------------------------------------------------------------


def _exact(query: QuerySpec):
    def run(spark, folder):
        tables = tpch.load(spark, folder)
        return _rounded(query().template(tables[query().fact], tables))

    return run


exact_sum_by_group = _exact(tpch.sales_by_segment_quarter)
exact_sum_filtered = _exact(tpch.sales_by_type)
exact_count_having_filters = _exact(tpch.baskets_by_customer)
exact_weekday_pivot = _exact(tpch.sales_by_weekday)


def exact_union_channels(spark, folder):
    tables = tpch.load(spark, folder)
    condition = {"line": F.col("l_returnflag") == "R", "order": F.col("o_orderstatus") == "F"}
    return _rounded(tpch.labelled_channels(tables["lineitem"], tables["orders"], condition))


def exact_two_channels(spark, folder):
    tables = tpch.load(spark, folder)
    return _rounded(tpch.two_channels(tables["lineitem"], tables, CHANNEL_YEAR))


def exact_returns_by_customer(spark, folder):
    totals = tpch.value_by_customer(tpch.load(spark, folder))
    return _rounded(totals.withColumn("total", F.col("total").cast("double")))


def exact_above_group_avg(spark, folder):
    return _rounded(tpch.customers_above_average(tpch.load(spark, folder)))


# -- answers from samples --------------------------------------------------------


def sample_sum_by_group(spark, folder):
    """The exact template on a sample, not rescaled."""
    tables = tpch.load(spark, folder)
    query = tpch.revenue_by_flag()
    sample, _ = _sampled(tables, query)
    return _rounded(query.template(sample, tables))


def _made(query: QuerySpec) -> SampleSpec:
    return SampleSpec(STRATIFIED, query.fact, query.qcs, query.tables, query.pairs)


def _estimate(query: QuerySpec):
    def run(spark, folder):
        tables = tpch.load(spark, folder)
        spec = query()
        sample, sizes = _sampled(tables, spec)
        return _rounded(spec.sample_template(sample, tables, sizes, _made(spec)))

    return run


rescaled_flagship = _estimate(tpch.revenue_by_flag)
rescaled_sum = _estimate(tpch.sales_by_type)
rescaled_across_strata = _estimate(tpch.sales_by_segment_priority)
rescaled_pivot = _estimate(tpch.sales_by_weekday)


def rescaled_uniform(spark, folder):
    """A uniform sample of many tiny strata: those of which nothing was drawn count too."""
    tables = tpch.load(spark, folder)
    query = tpch.sales_by_flag_of_parts()
    made = SampleSpec(UNIFORM, query.fact, query.qcs, ratio=UNIFORM_RATIO)
    sample = sampling.uniform_sample(tables[query.fact], made.ratio, tpch.KEYS[query.fact])
    return _rounded(query.sample_template(sample, tables, None, made))


def rescaled_union(spark, folder):
    """Line items from a sample, orders exactly, added up per nation."""
    tables = tpch.load(spark, folder)
    pairs = PrejoinSpec("shop", "lineitem", (), [tpch.ORDER, tpch.CUSTOMER]).pairs
    query = QuerySpec("33", "lineitem", CHANNEL_QCS, {"orders", "customer"}, pairs)
    sample, sizes = _sampled(tables, query)
    merged = approx.rescaled_merge(
        tpch.lineitem_channel_rows(sample, tables),
        sizes,
        query.qcs,
        ["c_nationkey"],
        {"total_sales": money("l_extendedprice")},
        [tpch.orders_channel(tables, CHANNEL_YEAR)],
        pinned={"o_year": CHANNEL_YEAR},
    )
    return _rounded(merged)


def self_scaled_error(spark, folder):
    tables = tpch.load(spark, folder)
    query, exact, sample, _ = _flag_answers(tables)
    scaled = approx.self_scaled(
        exact, query.template(sample, tables), query.groups, query.aggs
    ).withColumnsRenamed({c: f"est_{c}" for c in query.aggs})
    both = joins.null_safe_join(exact.drop("groupsize"), scaled, query.groups)
    errors = {
        f"err_{c}": evaluate.truncated_error(F.col(f"est_{c}"), F.col(c)) for c in query.aggs
    }
    return _rounded(both.withColumns(errors), 5).select(
        *query.groups, *(F.round(f"est_{c}", 2).alias(f"est_{c}") for c in query.aggs), *errors
    )


# -- evaluation ------------------------------------------------------------------


def avg_pct_error(spark, folder):
    tables = tpch.load(spark, folder)
    query, exact, sample, _ = _flag_answers(tables)
    exact = pin(exact, "exact")
    scaled = approx.self_scaled(
        exact, query.template(sample, tables), query.groups, query.aggs
    )
    return _rounded(evaluate.avg_pct_error(exact, scaled, query.groups, query.aggs), ERROR_DIGITS)


def avg_pct_error_prescaled(spark, folder):
    tables = tpch.load(spark, folder)
    query = tpch.sales_by_type()
    sample, sizes = _sampled(tables, query)
    scaled = query.sample_template(sample, tables, sizes, _made(query))
    exact = query.template(tables["lineitem"], tables)
    return _rounded(evaluate.compare_answers(exact, scaled, query.groups, query.aggs), ERROR_DIGITS)


def missing_group_ratio(spark, folder):
    """Groups that a uniform sample loses: baskets per customer, year and part size."""
    tables = tpch.load(spark, folder)
    query = tpch.baskets_by_customer()
    sample = sampling.uniform_sample(
        tables["lineitem"], UNIFORM_RATIO, tpch.KEYS["lineitem"]
    )
    exact, seen = (query.template(rows, tables) for rows in (tables["lineitem"], sample))
    return _rounded(evaluate.missing_group_ratio(exact, seen), ERROR_DIGITS)


REPORT = [
    "query_id",
    "exact_groups",
    "sample_groups",
    "skipped_groups",
    "missing_group_ratio",
    "avg_pct_error",
    "avg_rel_error",
    "self_scaled_error",
]


def evaluate_all(spark, folder):
    """Advise and create the workload's samples, then evaluate every one of them.

    Min-row samples are added, so that there is something to evaluate at every
    scale, also where the advisor finds no sample worthwhile.
    """
    engine = _engine(spark, tpch.load(spark, folder))
    workload = [tpch.revenue_by_flag(), tpch.value_by_status(), tpch.events_by_type()]
    engine.create_advised(workload)
    engine.create_samples([(_min_rows(q, FLAG_ROWS), [q.id]) for q in workload])
    return _labelled(engine.evaluate_all(workload))


def _labelled(report: DataFrame) -> DataFrame:
    # the readable part of the sample's name, without its digest
    label = F.regexp_replace("sample", "__[0-9a-f]{10}$", "").alias("sample")
    return _rounded(report.select(label, *REPORT), ERROR_DIGITS)


def evaluate_joined(spark, folder):
    """Queries that join: prejoins are stored, samples made from them, and all evaluated."""
    engine = _engine(spark, tpch.load(spark, folder))
    workload = [tpch.sales_by_segment_quarter(), tpch.sales_by_segment_priority()]
    engine.build_prejoins(workload)
    engine.create_samples([(_min_rows(q, JOINED_ROWS), [q.id]) for q in workload])
    return _labelled(engine.evaluate_all(workload))


def evaluate_workload(spark, folder):
    """Every query of the workload that has an answer, over stored prejoins: each on a min-row
    sample of its own strata."""
    engine = _engine(spark, tpch.load(spark, folder))
    workload = [q for q in tpch.workload() if q.template is not None]
    engine.build_prejoins(workload)
    engine.create_samples([(_min_rows(q, JOINED_ROWS), [q.id]) for q in workload])
    return _labelled(engine.evaluate_all(workload))


def _min_rows(q: QuerySpec, rows: int) -> SampleSpec:
    return SampleSpec(MIN_ROW, q.fact, q.qcs, q.tables, q.pairs, min_rows=rows)


def evaluate_sample(spark, folder):
    """One min-row sample against the query it suits and one whose groups cut its strata."""
    engine = _engine(spark, tpch.load(spark, folder))
    spec = engine.create_min_row_sample(["lineitem"], FLAGS, FLAG_ROWS)
    report = engine.evaluate_sample(spec.label, ["flag", "59"], tpch.workload())
    return _rounded(report.select(*REPORT), ERROR_DIGITS)


# -- metadata log ----------------------------------------------------------------


def _event_log(spark, folder) -> DataFrame:
    """The event stream as a log: the user is the key, low values are tombstones."""
    return tpch.load(spark, folder)["events"].select(
        F.col("event_type").alias("type"),
        F.col("user_id").cast("string").alias("key"),
        F.when(F.col("value") < 5.0, F.lit(DELETED)).otherwise(F.col("props")).alias("value"),
        "ts",
    )


def meta_latest(spark, folder):
    return latest(_event_log(spark, folder))


def meta_list(spark, folder):
    entries = live_entries(_event_log(spark, folder), "purchase")
    parsed = F.from_json("value", "k int")
    return entries.select("key", parsed["k"].alias("k"), "ts")


# -- flagship --------------------------------------------------------------------


def flagship(spark, folder):
    """Sales by flag from a stratified sample, next to the exact answer."""
    tables = tpch.load(spark, folder)
    query, exact, sample, sizes = _flag_answers(tables)
    estimate = query.sample_template(sample, tables, sizes, _made(query))
    renamed = estimate.withColumnsRenamed({c: f"est_{c}" for c in query.aggs})
    return _rounded(joins.null_safe_join(exact, renamed, query.groups))


QUERIES = {
    "stratum_sizes": stratum_sizes,
    "stratum_targets": stratum_targets,
    "stratum_summary": stratum_summary,
    "window_groupsize": window_groupsize,
    "uniform_sample": uniform_sample,
    "stratified_sample": stratified_sample,
    "stratified_sample_tail": stratified_sample_tail,
    "min_row_sample": min_row_sample,
    "min_row_sample_tail": min_row_sample_tail,
    "min_row_sample_orders": min_row_sample_orders,
    "sample_roundtrip": sample_roundtrip,
    "advise_one": advise_one,
    "advise_workload": advise_workload,
    "advised_uniform_sample": advised_uniform_sample,
    "prejoin_star": prejoin_star,
    "prejoin_snowflake": prejoin_snowflake,
    "prejoin_cover": prejoin_cover,
    "prejoin_best_match": prejoin_best_match,
    "load_prejoin_file": load_prejoin_file,
    "semi_join_filter": semi_join_filter,
    "semi_join_buyers": semi_join_buyers,
    "null_strata": null_strata,
    "exact_sum_by_group": exact_sum_by_group,
    "exact_sum_filtered": exact_sum_filtered,
    "exact_count_having_filters": exact_count_having_filters,
    "exact_weekday_pivot": exact_weekday_pivot,
    "exact_union_channels": exact_union_channels,
    "exact_two_channels": exact_two_channels,
    "exact_returns_by_customer": exact_returns_by_customer,
    "exact_above_group_avg": exact_above_group_avg,
    "sample_sum_by_group": sample_sum_by_group,
    "rescaled_flagship": rescaled_flagship,
    "rescaled_sum": rescaled_sum,
    "rescaled_across_strata": rescaled_across_strata,
    "rescaled_pivot": rescaled_pivot,
    "rescaled_uniform": rescaled_uniform,
    "rescaled_union": rescaled_union,
    "self_scaled_error": self_scaled_error,
    "avg_pct_error": avg_pct_error,
    "avg_pct_error_prescaled": avg_pct_error_prescaled,
    "missing_group_ratio": missing_group_ratio,
    "evaluate_all": evaluate_all,
    "evaluate_sample": evaluate_sample,
    "evaluate_joined": evaluate_joined,
    "evaluate_workload": evaluate_workload,
    "meta_latest": meta_latest,
    "meta_list": meta_list,
}
