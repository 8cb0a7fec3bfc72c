"""The decision-support workload: 59 described queries, eight of them with answers."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators.approx import rescaled, rescaled_merge
from stratafold.operators.joins import all_of, star_join
from stratafold.spec import UNIFORM, QuerySpec, SampleSpec
from stratafold.workloads.star import aggregate, star_query, swap

# Facts with their column prefix and the columns that identify a row.
FACTS = {
    "store_sales": ("ss", ("ss_item_sk", "ss_ticket_number")),
    "store_returns": ("sr", ("sr_item_sk", "sr_ticket_number")),
    "catalog_sales": ("cs", ("cs_item_sk", "cs_order_number")),
    "catalog_returns": ("cr", ("cr_item_sk", "cr_order_number")),
    "web_sales": ("ws", ("ws_item_sk", "ws_order_number")),
    "web_returns": ("wr", ("wr_item_sk", "wr_order_number")),
    "inventory": ("inv", ("inv_date_sk", "inv_item_sk", "inv_warehouse_sk")),
}
KEYS = {fact: key for fact, (_, key) in FACTS.items()}

# Primary keys of the dimensions.
PRIMARY_KEYS = {
    "call_center": "cc_call_center_sk",
    "customer": "c_customer_sk",
    "customer_address": "ca_address_sk",
    "customer_demographics": "cd_demo_sk",
    "date_dim": "d_date_sk",
    "household_demographics": "hd_demo_sk",
    "item": "i_item_sk",
    "promotion": "p_promo_sk",
    "ship_mode": "sm_ship_mode_sk",
    "store": "s_store_sk",
    "time_dim": "t_time_sk",
    "warehouse": "w_warehouse_sk",
    "web_page": "wp_web_page_sk",
    "web_site": "web_site_sk",
}

# Fact columns that the profile without prejoins leaves out.
LEFT_OUT = {
    "13": ("ss_store_sk",),
    "15": ("cs_sales_price",),
    "34": ("ss_customer_sk", "ss_ticket_number"),
    "48": ("ss_store_sk",),
    "53": ("ss_store_sk",),
    "63": ("ss_store_sk",),
}

# Filters of single queries.
COUNTIES = ("Fairfield County", "Williamson County")
COUNTIES_NJ = (
    "Kittitas County",
    "Adams County",
    "Richland County",
    "Furnas County",
    "Orange County",
    "Appanoose County",
    "Franklin Parish",
    "Tehama County",
)
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def described() -> list[QuerySpec]:
    """The 59 descriptions with their joins."""
    text = files("stratafold.workloads").joinpath("tpcds.txt").read_text()
    specs = []
    for line in text.splitlines():
        if not line or line.startswith("#"):
            continue
        head, links, columns = line.split("|")
        id, fact = (part.strip() for part in head.split(":"))
        foreign = dict(link.split("=") for link in links.split())
        pairs = [(key, PRIMARY_KEYS[dim]) for dim, key in foreign.items()]
        specs.append(QuerySpec(id, fact, tuple(columns.split()), frozenset(foreign), pairs))
    return specs


def on_fact_only(query: QuerySpec) -> QuerySpec:
    """The description without joins: foreign keys stand in for dimension columns."""
    prefix = FACTS[query.fact][0] + "_"
    keys = {side for p in query.pairs for side in (p.left, p.right)}
    own = {c for c in {*keys, *query.qcs} if c.startswith(prefix)}
    return QuerySpec(query.id + "_nj", query.fact, tuple(own - {*LEFT_OUT.get(query.id, ())}))


def workload(prejoin: bool = True) -> list[QuerySpec]:
    """All queries, on prejoins or on bare facts; those with answers carry templates."""
    answered = _answered(prejoin)
    specs = described() if prejoin else [on_fact_only(q) for q in described()]
    return [answered.get(q.id, q) for q in specs]


def _answered(prejoin: bool) -> dict[str, QuerySpec]:
    by_id = {q.id: q for q in described()}
    if not prejoin:
        plain = on_fact_only(by_id["34"])
        full = _frequent_baskets(by_id["34"], COUNTIES_NJ)
        return {
            plain.id: replace(
                plain,
                groups=full.groups,
                aggs=full.aggs,
                template=full.template,
                sample_template=full.sample_template,
            )
        }
    return {
        "31_1": _sales_by_county(by_id["31_1"], "store_sales", "ss_ext_sales_price"),
        "31_2": _sales_by_county(by_id["31_2"], "web_sales", "ws_ext_sales_price"),
        "33_1": _books_in_all_channels(by_id),
        "34": _frequent_baskets(by_id["34"], COUNTIES),
        "42": _holiday_categories(by_id["42"]),
        "43": _store_weekdays(by_id["43"]),
        "76_2": _rows_without_key(by_id),
    }


def _star(spec: QuerySpec, **details) -> QuerySpec:
    return star_query(spec.id, spec.fact, spec.pairs, spec.dims, spec.qcs, **details)


def _sales_by_county(spec: QuerySpec, name: str, price: str) -> QuerySpec:
    return _star(spec, groups=["ca_county", "d_qoy", "d_year"], sums={name: F.col(price)})


def _frequent_baskets(spec: QuerySpec, counties: tuple[str, ...]) -> QuerySpec:
    day, vehicles, potential = F.col("d_dom"), F.col("hd_vehicle_count"), F.col("hd_buy_potential")
    per_vehicle = F.when(vehicles > 0, F.col("hd_dep_count") / vehicles).otherwise(F.lit(None))
    conditions = [
        day.between(1, 3) | day.between(25, 28),
        (potential == "1001-5000") | (potential == "5001-10000"),
        vehicles > 0,
        per_vehicle > 1.2,
        F.col("d_year").isin(1998, 1998 + 1, 1998 + 2),
        F.col("s_county").isin(*counties),
    ]
    return _star(
        spec,
        groups=["ss_ticket_number", "ss_customer_sk"],
        counts=["cnt"],
        where=all_of(conditions),
    )


def _holiday_categories(spec: QuerySpec) -> QuerySpec:
    return _star(
        spec,
        groups=["d_year", "i_category_id", "i_category"],
        sums={"sum_price": F.col("ss_ext_sales_price")},
        pinned={"i_manager_id": 1, "d_moy": 12, "d_year": 1998},
    )


def _store_weekdays(spec: QuerySpec) -> QuerySpec:
    return _star(
        spec,
        groups=["s_store_name", "s_store_id"],
        sums={
            f"{day[:3].lower()}_sales": F.when(F.col("d_day_name") == day, F.col("ss_sales_price"))
            for day in WEEKDAYS
        },
        pinned={"s_gmt_offset": -6, "d_year": 1998},
    )


def _books_in_all_channels(by_id: Mapping[str, QuerySpec]) -> QuerySpec:
    """Sales of makers of books, from a sample of one channel and all of two others."""
    spec, others = by_id["33_1"], (by_id["33_2"], by_id["33_3"])
    groups, pinned = ["i_manufact_id"], {"d_year": 1999, "d_moy": 3, "ca_gmt_offset": -6}

    def rows(query: QuerySpec, tables: Mapping[str, DataFrame]) -> DataFrame:
        item = tables["item"]
        makers = item.where(F.col("i_category").isin("Books")).select("i_manufact_id").distinct()
        chosen = item.join(makers, "i_manufact_id", "left_semi")
        return star_join(query.fact, swap(tables, "item", chosen), query.dims, query.pairs)

    def price(query: QuerySpec) -> Column:
        return F.col(f"{FACTS[query.fact][0]}_ext_sales_price")

    def channel(query: QuerySpec, tables: Mapping[str, DataFrame]) -> DataFrame:
        fixed = all_of(F.col(c) == F.lit(v) for c, v in pinned.items())
        return aggregate(rows(query, tables).where(fixed), groups, {"total_sales": price(query)})

    def exact(fact_rows: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
        branches = [channel(spec, swap(tables, spec.fact, fact_rows))]
        branches += [channel(q, tables) for q in others]
        return (
            reduce(DataFrame.unionByName, branches)
            .groupBy(*groups)
            .agg(
                F.sum("total_sales").alias("total_sales"), F.sum("groupsize").alias("groupsize")
            )
        )

    def estimate(
        sample: DataFrame, tables: Mapping[str, DataFrame], sizes: DataFrame, made: SampleSpec
    ) -> DataFrame:
        if set(made.qcs) != set(spec.qcs):
            raise ValueError(f"query {spec.id} needs a sample of its own query columns")
        return rescaled_merge(
            rows(spec, swap(tables, spec.fact, sample)),
            sizes,
            spec.qcs,
            groups,
            {"total_sales": price(spec)},
            [channel(q, tables) for q in others],
            pinned=pinned,
        )

    return replace(
        spec,
        groups=tuple(groups),
        aggs=("total_sales",),
        template=exact,
        sample_template=estimate,
    )


def _rows_without_key(by_id: Mapping[str, QuerySpec]) -> QuerySpec:
    """Sales whose foreign key is NULL, per channel; the catalog channel may be sampled."""
    spec = by_id["76_2"]
    keys = ["channel", "col_name", "d_year", "d_qoy", "i_category"]
    branches = {
        "store": (by_id["76_1"], "ss_addr_sk", "ss_ext_sales_price"),
        "web": (by_id["76_3"], "ws_web_page_sk", "ws_ext_sales_price"),
        "catalog": (spec, "cs_warehouse_sk", "cs_ext_sales_price"),
    }

    def labelled(channel: str, tables: Mapping[str, DataFrame]) -> DataFrame:
        query, column, price = branches[channel]
        rows = star_join(query.fact, tables, query.dims, query.pairs)
        return rows.withColumns(
            {
                "channel": F.lit(channel),
                "col_name": F.lit(column),
                "ext_sales_price": F.col(price),
            }
        )

    def unkeyed(channel: str, tables: Mapping[str, DataFrame]) -> DataFrame:
        rows = labelled(channel, tables).where(F.col(branches[channel][1]).isNull())
        return aggregate(rows, keys, {"sales_amt": F.col("ext_sales_price")}, ["sales_cnt"])

    def exact(fact_rows: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
        sampled = swap(tables, spec.fact, fact_rows)
        return reduce(
            DataFrame.unionByName,
            [unkeyed("store", tables), unkeyed("web", tables), unkeyed("catalog", sampled)],
        )

    def estimate(
        sample: DataFrame, tables: Mapping[str, DataFrame], sizes: DataFrame, made: SampleSpec
    ) -> DataFrame:
        if set(made.qcs) != set(spec.qcs):
            raise ValueError(f"query {spec.id} needs a sample of its own query columns")
        catalog = rescaled(
            labelled("catalog", swap(tables, spec.fact, sample)),
            sizes,
            spec.qcs,
            keys,
            {"sales_amt": F.col("ext_sales_price")},
            ["sales_cnt"],
            pinned={"cs_warehouse_sk": None},
            ratio=made.ratio if made.kind == UNIFORM else None,
        )
        rest = unkeyed("store", tables).unionByName(unkeyed("web", tables))
        return catalog.unionByName(rest.select(*catalog.columns))

    return replace(
        spec,
        groups=tuple(keys),
        aggs=("sales_amt", "sales_cnt"),
        template=exact,
        sample_template=estimate,
    )
