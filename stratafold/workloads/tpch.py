"""A small star-schema workload over the given order tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.operators.joins import all_of, star_join
from stratafold.spec import JoinPair, QuerySpec
from stratafold.workloads.star import aggregate, money, star_query

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
KEYS = {
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    "orders": ("o_orderkey",),
    "events": ("event_id",),
}
ORDERS = {"lineitem": ("l_extendedprice",)}

ORDER = "l_orderkey = o_orderkey"
CUSTOMER = "o_custkey = c_custkey"
PART = "l_partkey = p_partkey"
SUPPLIER = "l_suppkey = s_suppkey"
SUPPLIER_NATION = "s_nationkey = n_nationkey"

# Sunday first, as numbered by dayofweek
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")


class Tables(Mapping):
    """The tables of a folder, each opened when it is first asked for.

    ``orders`` has the year and quarter of its date as columns.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise KeyError(name)
        if name not in self._open:
            table = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
            if name == "orders":
                table = table.withColumns(
                    {"o_year": F.year("o_orderdate"), "o_quarter": F.quarter("o_orderdate")}
                )
            self._open[name] = table
        return self._open[name]

    def __iter__(self):
        return iter(NAMES)

    def __len__(self) -> int:
        return len(NAMES)


def load(spark: SparkSession, folder: str) -> Tables:
    return Tables(spark, folder)


def revenue_by_flag() -> QuerySpec:
    return star_query(
        "flag",
        "lineitem",
        [],
        [],
        qcs=["l_returnflag", "l_linestatus"],
        groups=["l_returnflag", "l_linestatus"],
        sums={"sum_price": money("l_extendedprice"), "sum_qty": money("l_quantity")},
        counts=["cnt"],
    )


def sales_by_segment_quarter() -> QuerySpec:
    keys = ["c_mktsegment", "o_quarter", "o_year"]
    return star_query(
        "31",
        "lineitem",
        [ORDER, CUSTOMER],
        ["orders", "customer"],
        qcs=keys,
        groups=keys,
        sums={"sales": money("l_extendedprice")},
    )


def baskets_by_customer() -> QuerySpec:
    size, quantity = F.col("p_size"), F.col("l_quantity")
    return star_query(
        "34",
        "lineitem",
        [ORDER, PART],
        ["orders", "part"],
        qcs=["o_custkey", "o_year", "p_size"],
        groups=["o_custkey"],
        counts=["cnt"],
        where=all_of(
            [
                size.between(1, 10) | size.between(25, 40),
                (F.col("p_type") == "ECONOMY") | (F.col("p_type") == "PROMO"),
                quantity > 0,
                F.when(quantity > 0, size / quantity).otherwise(F.lit(None)) > 1.2,
                F.col("o_year").isin(1998, 1998 + 1, 1998 + 2),
            ]
        ),
    )


def sales_by_type() -> QuerySpec:
    return star_query(
        "42",
        "lineitem",
        [ORDER, PART],
        ["orders", "part"],
        qcs=["p_type", "o_orderstatus"],
        groups=["p_type", "o_orderstatus"],
        sums={"sum_price": money("l_extendedprice")},
        pinned={"o_orderstatus": "F"},
    )


def sales_by_weekday() -> QuerySpec:
    day = F.dayofweek("l_shipdate")
    return star_query(
        "43",
        "lineitem",
        [SUPPLIER, SUPPLIER_NATION],
        ["supplier", "nation"],
        qcs=["n_name", "n_regionkey"],
        groups=["n_name"],
        sums={
            f"{name}_sales": F.when(day == i, money("l_extendedprice"))
            for i, name in enumerate(WEEKDAYS, start=1)
        },
        pinned={"n_regionkey": 1},
    )


def sales_by_segment_priority() -> QuerySpec:
    return star_query(
        "47",
        "lineitem",
        [ORDER, CUSTOMER],
        ["orders", "customer"],
        qcs=["c_mktsegment", "o_orderpriority"],
        groups=["c_mktsegment"],
        sums={"sum_price": money("l_extendedprice")},
        counts=["cnt"],
    )


def returns_by_flag_supplier() -> QuerySpec:
    return star_query(
        "59",
        "lineitem",
        [],
        [],
        qcs=["l_suppkey"],
        groups=["l_suppkey"],
        sums={"sum_price": money("l_extendedprice")},
    )


def sales_by_flag_of_parts() -> QuerySpec:
    """Strata of a few rows each, far more than output groups."""
    return star_query(
        "flag_parts",
        "lineitem",
        [],
        [],
        qcs=["l_partkey"],
        groups=["l_returnflag"],
        sums={"sum_price": money("l_extendedprice")},
        counts=["cnt"],
    )


def value_by_status() -> QuerySpec:
    return star_query(
        "65",
        "orders",
        [],
        [],
        qcs=["o_orderstatus"],
        groups=["o_orderstatus"],
        sums={"sum_total": money("o_totalprice")},
    )


def events_by_type() -> QuerySpec:
    return star_query(
        "88",
        "events",
        [],
        [],
        qcs=["event_type"],
        groups=["event_type"],
        sums={"sum_value": money("value")},
        counts=["cnt"],
    )


def wide_profile() -> QuerySpec:
    """No template: a column set worth profiling over the widest join."""
    return QuerySpec(
        "91",
        "lineitem",
        ("p_type",),
        frozenset({"orders", "customer", "part", "supplier"}),
        frozenset({ORDER, CUSTOMER, PART, SUPPLIER}),
    )


def workload() -> list[QuerySpec]:
    return [
        revenue_by_flag(),
        sales_by_segment_quarter(),
        baskets_by_customer(),
        sales_by_type(),
        sales_by_weekday(),
        sales_by_segment_priority(),
        returns_by_flag_supplier(),
        value_by_status(),
        events_by_type(),
        wide_profile(),
    ]


# -- templates that are more than one aggregate over a star ---------------------


def active_segments(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Customers of nations with a customer in the BUILDING segment (an IN subquery)."""
    customer = tables["customer"]
    nations = customer.where(F.col("c_mktsegment") == "BUILDING").select("c_nationkey").distinct()
    return customer.join(nations, "c_nationkey", "left_semi")


def buyers(tables: Mapping[str, DataFrame], year: int) -> DataFrame:
    """Customers with a finished order in a year (an IN subquery that leaves many out)."""
    finished = (F.col("o_year") == year) & (F.col("o_orderstatus") == "F")
    bought = tables["orders"].where(finished).select("o_custkey")
    return tables["customer"].join(bought, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


def customers_with_orders(tables: Mapping[str, DataFrame], year: int) -> DataFrame:
    """Every customer with the orders of a year; order columns are NULL without any."""
    orders = tables["orders"].where(F.col("o_year") == year)
    return tables["customer"].join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")


def orders_channel(tables: Mapping[str, DataFrame], year: int) -> DataFrame:
    """Order value per nation, the branch that is always computed exactly."""
    rows = (
        tables["orders"]
        .where(F.col("o_year") == year)
        .join(active_segments(tables), F.col("o_custkey") == F.col("c_custkey"))
    )
    return rows.groupBy("c_nationkey").agg(
        F.sum(money("o_totalprice")).alias("total_sales"), F.count("*").alias("gs")
    )


def lineitem_channel_rows(lineitem: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    chosen = {"lineitem": lineitem, "orders": tables["orders"], "customer": active_segments(tables)}
    pairs = [JoinPair.parse(ORDER), JoinPair.parse(CUSTOMER)]
    return star_join("lineitem", chosen, ["orders", "customer"], pairs)


def two_channels(lineitem: DataFrame, tables: Mapping[str, DataFrame], year: int = 1999):
    """Sales per nation over line items and orders, added up across channels."""
    lines = (
        lineitem_channel_rows(lineitem, tables)
        .where(F.col("o_year") == year)
        .groupBy("c_nationkey")
        .agg(F.sum(money("l_extendedprice")).alias("total_sales"), F.count("*").alias("gs"))
    )
    both = lines.unionByName(orders_channel(tables, year))
    return both.groupBy("c_nationkey").agg(
        F.sum("total_sales").cast("double").alias("total_sales"), F.sum("gs").alias("groupsize")
    )


def labelled_channels(
    lineitem: DataFrame, orders: DataFrame, condition: Mapping[str, object]
) -> DataFrame:
    """Rows per channel, column and year; literals tell the branches of the union apart."""
    lines = lineitem.where(condition["line"]).select(
        F.lit("line").alias("channel"),
        F.lit("l_returnflag").alias("col_name"),
        F.year("l_shipdate").alias("year"),
        money("l_extendedprice").alias("price"),
    )
    order = orders.where(condition["order"]).select(
        F.lit("order").alias("channel"),
        F.lit("o_orderstatus").alias("col_name"),
        F.year("o_orderdate").alias("year"),
        money("o_totalprice").alias("price"),
    )
    keys = ["channel", "col_name", "year"]
    return aggregate(
        lines.unionByName(order), keys, {"sales_amt": F.col("price")}, ["sales_cnt"]
    )


def value_by_customer(tables: Mapping[str, DataFrame], year: int = 2000) -> DataFrame:
    rows = (
        tables["orders"]
        .where(F.col("o_year") == year)
        .join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
    )
    return rows.groupBy("c_custkey", "c_nationkey").agg(
        F.sum(money("o_totalprice")).alias("total")
    )


def customers_above_average(tables: Mapping[str, DataFrame], top: int = 100) -> DataFrame:
    """Customers above 1.2 times the average total of their nation, first ``top`` by key.

    The average per nation is an aggregate joined back, not a window: a window
    would put all customers of a nation into one task.
    """
    totals = value_by_customer(tables)
    average = totals.groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.avg("total").alias("average")
    )
    return (
        totals.join(average, F.col("c_nationkey") == F.col("nation"))
        .where(F.col("total").cast("double") > F.col("average").cast("double") * 1.2)
        .select("c_custkey", "c_nationkey", F.col("total").cast("double").alias("total"))
        .orderBy("c_custkey")
        .limit(top)
    )
