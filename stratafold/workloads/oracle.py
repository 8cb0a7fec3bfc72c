"""The same queries as SQL, for comparison with another engine on the same tables."""

from __future__ import annotations

S0 = "(pow(2.576, 2) * 0.25 / pow(0.01, 2))"
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINE_COLUMNS = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
    "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
)
ORDERS = (
    "(SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_year, "
    "CAST(quarter(o_orderdate) AS INTEGER) AS o_quarter FROM orders)"
)
O_JOIN = f"JOIN {ORDERS} o ON l_orderkey = o_orderkey"
C_JOIN = "JOIN customer ON o_custkey = c_custkey"
P_JOIN = "JOIN part ON l_partkey = p_partkey"
S_JOIN = "JOIN supplier ON l_suppkey = s_suppkey"
N_JOIN = "JOIN nation ON s_nationkey = n_nationkey"
FLAGS = ("l_returnflag", "l_linestatus")
TYPE_QCS = ("o_orderstatus", "p_type")
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def money(column: str) -> str:
    return f"CAST({column} AS DECIMAL(18,2))"


def total(value: str) -> str:
    return f"CAST(sum({value}) AS DOUBLE)"


def digest(key: tuple[str, ...]) -> str:
    parts = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '~')" for k in key)
    return f"md5(concat_ws('|', '0', {parts}))"


def draw(text: str, first: int) -> str:
    return f"(CAST('0x' || substr({text}, {first}, 13) AS BIGINT) / 4503599627370496.0)"


def targets(source: str, qcs: tuple[str, ...], target: str) -> str:
    columns = ", ".join(qcs)
    return (
        f"SELECT *, {target} AS target FROM "
        f"(SELECT {columns}, count(*) AS groupsize FROM {source} GROUP BY {columns}) g"
    )


COCHRAN = f"groupsize * {S0} / (groupsize + {S0} - 1)"


def sample(
    source: str,
    qcs: tuple[str, ...],
    target: str = COCHRAN,
    tail: bool = True,
    key: tuple[str, ...] = LINE_KEY,
    order: str = ", l_extendedprice",
    columns: str = LINE_COLUMNS,
) -> str:
    """The first rows of each stratum by digest, and the tail."""
    match = " AND ".join(f"r.{c} IS NOT DISTINCT FROM t.{c}" for c in qcs)
    names = ", ".join(qcs)
    beyond = f" OR {draw('h', 14)} < target / 20 / groupsize" if tail else ""
    picked = ", ".join(f"r.{c.strip()}" for c in columns.split(","))
    return f"""
      SELECT {picked}
      FROM (SELECT *, row_number() OVER (PARTITION BY {names} ORDER BY h{order}) AS rn
            FROM (SELECT *, {digest(key)} AS h FROM {source}) d) r
      JOIN ({targets(source, qcs, target)}) t ON {match}
      WHERE rn <= floor(round(target, 6)){beyond}"""


TYPE_SOURCE = f"lineitem {O_JOIN} {P_JOIN}"
NATION_SOURCE = f"lineitem {S_JOIN} {N_JOIN}"
SEGMENT_SOURCE = f"lineitem {O_JOIN} {C_JOIN}"
TYPE_FROM_FACT = f"(SELECT * FROM {TYPE_SOURCE})"


def on_sample(rows: str, joins: str) -> str:
    return f"({rows}) s {joins}"


def estimate(
    rows: str,
    joins: str,
    source: str,
    qcs: tuple[str, ...],
    groups: tuple[str, ...],
    sums: dict[str, str],
    counts: tuple[str, ...] = (),
    where: str = "true",
    seen: str = "",
) -> str:
    """Per stratum scaled by its size over its sampled rows, then added up per group.

    ``where`` must be on stratum columns, or on none; ``seen`` is any filter: rows that fail it
    still count as sampled.
    """
    keys = tuple(dict.fromkeys((*qcs, *groups)))
    match = " AND ".join(f"a.{c} IS NOT DISTINCT FROM t.{c}" for c in qcs)
    if seen:
        sums = {n: f"CASE WHEN {seen} THEN {v} END" for n, v in sums.items()}
    inner = "".join(f", {total(v)} AS {n}" for n, v in sums.items())
    hits = f"count(CASE WHEN {seen or 'true'} THEN 1 END)"
    sampled = f"sum(count(*)) OVER (PARTITION BY {', '.join(qcs)})"
    outer = ", ".join(
        [f"round(sum(a.{n} / sampled * groupsize), 2) AS {n}" for n in sums]
        + [f"round(sum(hits / sampled * groupsize), 2) AS {n}" for n in counts]
    )
    grouped = ", ".join(f"a.{g}" for g in groups)
    return f"""
      SELECT {grouped}, {outer}
      FROM (SELECT {', '.join(keys)}, {hits} AS hits, {sampled} AS sampled{inner}
            FROM {on_sample(rows, joins)} WHERE {where} GROUP BY {', '.join(keys)}) a
      JOIN ({targets(source, qcs, '1')}) t ON {match}
      WHERE hits > 0 GROUP BY {grouped}"""


def whole(value: str) -> str:
    return f"CAST(trunc(round({value}, 4)) AS HUGEINT)"


def truncated(est: str, truth: str) -> str:
    return (
        f"abs(CAST({whole(f'({est} - {truth}) * 100000')} // nullif({whole(truth)}, 0) AS DOUBLE)"
        " / 100000)"
    )


def relative(est: str, truth: str) -> str:
    return f"(abs({est} - {truth}) / abs(nullif({truth}, 0)))"


def decide(summary: str, extra: str = "") -> str:
    ratio = (
        "(CASE WHEN avg_group_size > 100000 THEN 100000 / avg_group_size "
        "ELSE target_sample_size / population_size END)"
    )
    useful = f"{ratio} <= 2.0::DOUBLE / 3.0::DOUBLE"
    return f"""
      SELECT {extra} group_count, population_size,
        round(target_sample_size, 4) AS target_sample_size,
        round(avg_group_size, 4) AS avg_group_size, min_group_size, max_group_size,
        round({ratio}, 4) AS ratio,
        CASE WHEN NOT {useful} THEN 'none' WHEN avg_group_size > 100000 THEN 'uniform'
             ELSE 'stratified' END AS advice,
        CASE WHEN {useful} THEN 'ok' WHEN avg_group_size > 100000 THEN 'uniform sample too large'
             ELSE 'stratified sample too large' END AS reason
      FROM ({summary}) z"""


def summary(source: str, qcs: tuple[str, ...]) -> str:
    return f"""
      SELECT count(*) AS group_count, CAST(sum(groupsize) AS BIGINT) AS population_size,
        sum(target) AS target_sample_size, avg(groupsize) AS avg_group_size,
        min(groupsize) AS min_group_size, max(groupsize) AS max_group_size
      FROM ({targets(source, qcs, COCHRAN)}) t"""


PROFILES = {
    "flag": ("lineitem", FLAGS),
    "31": (SEGMENT_SOURCE, ("c_mktsegment", "o_quarter", "o_year")),
    "34": (TYPE_SOURCE, ("o_custkey", "o_year", "p_size")),
    "42": (TYPE_SOURCE, TYPE_QCS),
    "43": (NATION_SOURCE, ("n_name", "n_regionkey")),
    "47": (SEGMENT_SOURCE, ("c_mktsegment", "o_orderpriority")),
    "59": ("lineitem", ("l_suppkey",)),
    "65": ("orders", ("o_orderstatus",)),
    "88": ("events", ("event_type",)),
    "91": (f"lineitem {O_JOIN} {C_JOIN} {P_JOIN} {S_JOIN}", ("p_type",)),
}

FLAG_SAMPLE = sample("lineitem", FLAGS)
FLAG_MIN_ROWS = sample("lineitem", FLAGS, target="500.0")
TYPE_SAMPLE = sample(TYPE_SOURCE, TYPE_QCS)
FLAG_SUMS = {"sum_price": money("l_extendedprice"), "sum_qty": money("l_quantity")}
FLAG_AGGS = ("sum_price", "sum_qty", "cnt")


def flag_answer(rows: str) -> str:
    return f"""
      SELECT l_returnflag, l_linestatus, {total(money('l_extendedprice'))} AS sum_price,
        {total(money('l_quantity'))} AS sum_qty, count(*) AS cnt, count(*) AS groupsize
      FROM {rows} GROUP BY l_returnflag, l_linestatus"""


def self_scaled(rows: str, columns: str) -> str:
    """Exact (o) and self-scaled sample (s) answers by flag, side by side."""
    scaled = ", ".join(f"s.{a} * (o.groupsize / s.groupsize) AS est_{a}" for a in FLAG_AGGS)
    truth = ", ".join(f"o.{a}" for a in FLAG_AGGS)
    return f"""
      SELECT {columns} FROM (
        SELECT o.l_returnflag, o.l_linestatus, {truth}, {scaled}
        FROM ({flag_answer('lineitem')}) o JOIN ({flag_answer(f'({rows}) x')}) s
          USING (l_returnflag, l_linestatus)) b"""


def mean_error(error, aggs) -> str:
    terms = " + ".join(error(f"est_{a}", a) for a in aggs)
    return f"avg({terms}) / {len(aggs)}"


WEEKDAY_SUMS = {
    f"{d[:3].lower()}_sales": (
        f"CASE WHEN dayname(l_shipdate) = '{d}' THEN {money('l_extendedprice')} END"
    )
    for d in WEEKDAYS
}
BASKET_FILTER = (
    "(p_size BETWEEN 1 AND 10 OR p_size BETWEEN 25 AND 40) "
    "AND (p_type = 'ECONOMY' OR p_type = 'PROMO') AND l_quantity > 0 "
    "AND (CASE WHEN l_quantity > 0 THEN p_size / l_quantity ELSE NULL END) > 1.2 "
    "AND o_year IN (1998, 1998+1, 1998+2)"
)
ACTIVE = (
    "(SELECT * FROM customer WHERE c_nationkey IN "
    "(SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'))"
)
ORDERS_CHANNEL = f"""
  SELECT c_nationkey, sum({money('o_totalprice')}) AS total_sales, count(*) AS gs
  FROM {ORDERS} o JOIN {ACTIVE} c ON o_custkey = c_custkey WHERE o_year = 1999
  GROUP BY c_nationkey"""
CUSTOMER_TOTALS = f"""
  SELECT c_custkey, c_nationkey, sum({money('o_totalprice')}) AS total
  FROM {ORDERS} o JOIN customer ON o_custkey = c_custkey WHERE o_year = 2000
  GROUP BY c_custkey, c_nationkey"""
EVENT_LOG = """
  SELECT event_type AS type, CAST(user_id AS VARCHAR) AS key,
    CASE WHEN value < 5.0 THEN 'DELETED' ELSE props END AS value, ts FROM events"""
LATEST = f"""
  SELECT type, key, value, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY type, key ORDER BY ts DESC, value DESC) AS rn
    FROM ({EVENT_LOG}) e) v
  WHERE rn = 1 AND value <> 'DELETED'"""
CHANNEL_QCS = ("c_nationkey", "o_year")


EVENT_KEY = ("event_id",)
EVENT_COLUMNS = "event_id, ts, user_id, event_type, value, props"
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

SEGMENT_JOINS = f"{O_JOIN} {C_JOIN}"
# equality filters on strata, and any other filters, per query
PINNED = {"42": "o_orderstatus = 'F'", "43": "n_regionkey = 1"}
FILTERED = {"34": BASKET_FILTER}
# per query: fact, group columns, sums, counts, joins
REPORTED = {
    "flag": ("lineitem", FLAGS, FLAG_SUMS, ("cnt",), ""),
    "59": ("lineitem", ("l_suppkey",), {"sum_price": money("l_extendedprice")}, (), ""),
    "65": ("orders", ("o_orderstatus",), {"sum_total": money("o_totalprice")}, (), ""),
    "88": ("events", ("event_type",), {"sum_value": money("value")}, ("cnt",), ""),
    "31": (
        "lineitem",
        ("c_mktsegment", "o_quarter", "o_year"),
        {"sales": money("l_extendedprice")},
        (),
        SEGMENT_JOINS,
    ),
    "47": (
        "lineitem",
        ("c_mktsegment",),
        {"sum_price": money("l_extendedprice")},
        ("cnt",),
        SEGMENT_JOINS,
    ),
    "34": ("lineitem", ("o_custkey",), {}, ("cnt",), f"{O_JOIN} {P_JOIN}"),
    "42": (
        "lineitem",
        ("p_type", "o_orderstatus"),
        {"sum_price": money("l_extendedprice")},
        (),
        f"{O_JOIN} {P_JOIN}",
    ),
    "43": ("lineitem", ("n_name",), WEEKDAY_SUMS, (), f"{S_JOIN} {N_JOIN}"),
}


def report(query: str, rows: str, qcs: tuple[str, ...]) -> str:
    """The evaluation of one query on one sample with strata ``qcs``."""
    fact, groups, sums, counts, joins = REPORTED[query]
    aggs = (*sums, *counts)
    keys = ", ".join(groups)
    measures = ", ".join(
        [f"{total(v)} AS {n}" for n, v in sums.items()] + [f"count(*) AS {n}" for n in counts]
    )

    pinned, seen = PINNED.get(query, "true"), FILTERED.get(query, "")

    def answer(source: str) -> str:
        return (
            f"SELECT {keys}, {measures}, count(*) AS groupsize FROM {source} "
            f"WHERE {pinned} AND ({seen or 'true'}) GROUP BY {keys}"
        )

    # the report uses unrounded estimates
    est = estimate(rows, joins, f"{fact} {joins}", qcs, groups, sums, counts, pinned, seen)
    est = est.replace("round(sum(", "(sum(").replace("groupsize), 2)", "groupsize))")
    truth = ", ".join(f"o.{a}" for a in aggs)
    guess = ", ".join(f"e.{a} AS est_{a}" for a in aggs)
    own = ", ".join(f"p.{a} * (o.groupsize / p.groupsize) AS self_{a}" for a in aggs)
    skipped = " OR ".join(f"{whole(a)} = 0" for a in aggs)
    self_terms = " + ".join(truncated(f"self_{a}", a) for a in aggs)
    return f"""
      SELECT '{query}' AS query_id, count(*) AS exact_groups, count(seen) AS sample_groups,
        count(CASE WHEN seen IS NOT NULL AND ({skipped}) THEN 1 END) AS skipped_groups,
        round((count(*) - count(seen)) / count(*), 8) AS missing_group_ratio,
        round({mean_error(truncated, aggs)}, 8) AS avg_pct_error,
        round({mean_error(relative, aggs)}, 8) AS avg_rel_error,
        round(avg({self_terms}) / {len(aggs)}, 8) AS self_scaled_error
      FROM (SELECT {truth}, {guess}, {own}, p.groupsize AS seen
            FROM ({answer(f'{fact} {joins}')}) o LEFT JOIN ({est}) e USING ({keys})
            LEFT JOIN ({answer(f'({rows}) x {joins}')}) p USING ({keys})) b"""


def _evaluate_all() -> str:
    """Min-row samples always; stratified ones where the advisor asks for them."""
    shapes = {
        "flag": dict(key=LINE_KEY, order=", l_extendedprice", columns=LINE_COLUMNS),
        "65": dict(key=("o_orderkey",), order="", columns=ORDER_COLUMNS),
        "88": dict(key=EVENT_KEY, order="", columns=EVENT_COLUMNS),
    }
    parts = []
    for query, shape in shapes.items():
        fact, qcs = REPORTED[query][:2]
        names = "_".join(sorted(qcs))
        advised = f"SELECT advice FROM ({decide(summary(fact, qcs))}) d"
        few = report(query, sample(fact, qcs, target="500.0", **shape), qcs)
        many = report(query, sample(fact, qcs, **shape), qcs)
        parts.append(f"SELECT '{fact}__st2_500__{names}' AS sample, * FROM ({few}) r")
        parts.append(
            f"SELECT '{fact}__st_2_5760_0_0100__{names}' AS sample, * FROM ({many}) r "
            f"WHERE ({advised}) = 'stratified'"
        )
    return " UNION ALL ".join(parts)


def _evaluate_joined() -> str:
    parts = []
    for query in ("31", "47"):
        qcs = PROFILES[query][1]
        rows = report(query, sample(SEGMENT_SOURCE, qcs, target="100.0"), qcs)
        parts.append(f"SELECT 'lineitem__st2_100__{'_'.join(sorted(qcs))}' AS sample, * FROM ({rows}) r")
    return " UNION ALL ".join(parts)


def _evaluate_workload() -> str:
    """Every query of the workload that has an answer, each on a min-row sample of its strata."""
    shapes = {
        "orders": dict(key=("o_orderkey",), order="", columns=ORDER_COLUMNS),
        "events": dict(key=EVENT_KEY, order="", columns=EVENT_COLUMNS),
    }
    parts = []
    for query, (fact, _, _, _, joins) in REPORTED.items():
        qcs = PROFILES[query][1]
        drawn = sample(f"{fact} {joins}", qcs, target="100.0", **shapes.get(fact, {}))
        name = f"{fact}__st2_100__{'_'.join(sorted(qcs))}"
        parts.append(f"SELECT '{name}' AS sample, * FROM ({report(query, drawn, qcs)}) r")
    return " UNION ALL ".join(parts)


ORACLE = {
    "stratum_sizes": """
      SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS groupsize
      FROM lineitem GROUP BY ALL""",
    "stratum_targets": f"""
      SELECT o_orderstatus, o_orderpriority, groupsize,
        round(target, 6) AS target_group_sample_size
      FROM ({targets('orders', ('o_orderstatus', 'o_orderpriority'), COCHRAN)}) t""",
    "stratum_summary": f"""
      SELECT group_count, population_size, round(target_sample_size, 4) AS target_sample_size,
        round(avg_group_size, 4) AS avg_group_size, min_group_size, max_group_size
      FROM ({summary(TYPE_SOURCE, TYPE_QCS)}) z""",
    "window_groupsize": """
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
        count(*) OVER (PARTITION BY l_returnflag, l_linestatus
                       ORDER BY l_returnflag, l_linestatus) AS groupsize
      FROM lineitem""",
    "uniform_sample": f"""
      SELECT * FROM lineitem WHERE {draw(digest(LINE_KEY), 1)} < 0.1""",
    "stratified_sample": sample("lineitem", FLAGS, tail=False),
    "stratified_sample_tail": TYPE_SAMPLE,
    "min_row_sample": sample("lineitem", FLAGS, target="500.0", tail=False),
    "min_row_sample_tail": sample(NATION_SOURCE, ("n_name",), target="200.0"),
    "min_row_sample_orders": sample("lineitem", ("l_orderkey",), target="2.0", tail=False),
    "sample_roundtrip": FLAG_MIN_ROWS,
    "advise_one": decide(summary("lineitem", FLAGS)),
    "advise_workload": " UNION ALL ".join(
        decide(summary(*profile), f"'{q}' AS query_id,") for q, profile in PROFILES.items()
    ),
    "advised_uniform_sample": f"""
      SELECT * FROM lineitem WHERE {draw(digest(LINE_KEY), 1)} < (
        SELECT CASE WHEN avg_group_size > 100 AND 100 / avg_group_size <= 2.0::DOUBLE / 3.0::DOUBLE
          THEN 100 / avg_group_size ELSE 0 END FROM ({summary('lineitem', FLAGS)}) z)""",
    "prejoin_star": f"SELECT * FROM lineitem {O_JOIN} {P_JOIN} {S_JOIN}",
    "prejoin_snowflake": f"""
      SELECT * FROM lineitem {O_JOIN} {C_JOIN} JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "prejoin_cover": f"""
      SELECT 'customer,lineitem,orders,part,supplier' AS tables, '31,34,42,47,91' AS covers,
        count(*) AS row_count, {total(money('l_extendedprice'))} AS sum_price
      FROM lineitem {O_JOIN} {C_JOIN} {P_JOIN} {S_JOIN}
      UNION ALL
      SELECT 'lineitem,nation,supplier', '43', count(*), {total(money('l_extendedprice'))}
      FROM lineitem {S_JOIN} {N_JOIN}""",
    "prejoin_best_match": f"""
      SELECT unnest(['31', '47', '91']) AS query_id,
        'customer,lineitem,orders,part,supplier' AS tables, sum_qty
      FROM (SELECT {total(money('l_quantity'))} AS sum_qty
            FROM lineitem {O_JOIN} {C_JOIN} {P_JOIN} {S_JOIN}) a
      UNION ALL
      SELECT unnest(['34', '42']), 'lineitem,orders,part', sum_qty
      FROM (SELECT {total(money('l_quantity'))} AS sum_qty FROM {TYPE_SOURCE}) b
      UNION ALL
      SELECT '43', 'lineitem,nation,supplier', {total(money('l_quantity'))}
      FROM {NATION_SOURCE}""",
    "load_prejoin_file": f"""
      SELECT 'pre_42' AS name,
        'l_orderkey = o_orderkey AND l_partkey = p_partkey' AS pairs, count(*) AS row_count
      FROM {TYPE_SOURCE}
      UNION ALL
      SELECT 'pre_43', 'l_suppkey = s_suppkey AND n_nationkey = s_nationkey', count(*)
      FROM {NATION_SOURCE}""",
    "semi_join_filter": f"""
      SELECT c_nationkey, c_mktsegment, count(*) AS customers FROM {ACTIVE} c GROUP BY ALL""",
    "semi_join_buyers": f"""
      SELECT c_nationkey, c_mktsegment, count(*) AS customers FROM customer
      WHERE c_custkey IN (SELECT o_custkey FROM {ORDERS} WHERE o_year = 1999 AND o_orderstatus = 'F')
      GROUP BY c_nationkey, c_mktsegment""",
    "null_strata": f"""
      SELECT c_mktsegment, o_orderstatus, count(*) AS groupsize,
        o_orderstatus IS NULL AS without_order
      FROM customer LEFT JOIN (SELECT * FROM {ORDERS} WHERE o_year = 1999) o
        ON c_custkey = o_custkey
      GROUP BY c_mktsegment, o_orderstatus""",
    "exact_sum_by_group": f"""
      SELECT c_mktsegment, o_quarter, o_year,
        round({total(money('l_extendedprice'))}, 2) AS sales, count(*) AS groupsize
      FROM {SEGMENT_SOURCE} GROUP BY c_mktsegment, o_quarter, o_year""",
    "exact_sum_filtered": f"""
      SELECT p_type, o_orderstatus, round({total(money('l_extendedprice'))}, 2) AS sum_price,
        count(*) AS groupsize
      FROM {TYPE_SOURCE} WHERE o_orderstatus = 'F' GROUP BY p_type, o_orderstatus""",
    "exact_count_having_filters": f"""
      SELECT o_custkey, count(*) AS cnt, count(*) AS groupsize
      FROM {TYPE_SOURCE} WHERE {BASKET_FILTER} GROUP BY o_custkey""",
    "exact_weekday_pivot": f"""
      SELECT n_name, {', '.join(f'round({total(v)}, 2) AS {n}' for n, v in WEEKDAY_SUMS.items())},
        count(*) AS groupsize
      FROM {NATION_SOURCE} WHERE n_regionkey = 1 GROUP BY n_name""",
    "exact_union_channels": f"""
      SELECT channel, col_name, CAST(year AS INTEGER) AS year, round({total('price')}, 2) AS sales_amt,
        count(*) AS sales_cnt, count(*) AS groupsize
      FROM (SELECT 'line' AS channel, 'l_returnflag' AS col_name, year(l_shipdate) AS year,
              {money('l_extendedprice')} AS price FROM lineitem WHERE l_returnflag = 'R'
            UNION ALL
            SELECT 'order', 'o_orderstatus', year(o_orderdate), {money('o_totalprice')}
            FROM orders WHERE o_orderstatus = 'F') u
      GROUP BY channel, col_name, year""",
    "exact_two_channels": f"""
      SELECT c_nationkey, round({total('total_sales')}, 2) AS total_sales,
        CAST(sum(gs) AS BIGINT) AS groupsize
      FROM (SELECT c_nationkey, sum({money('l_extendedprice')}) AS total_sales, count(*) AS gs
            FROM lineitem {O_JOIN} JOIN {ACTIVE} c ON o_custkey = c_custkey
            WHERE o_year = 1999 GROUP BY c_nationkey
            UNION ALL {ORDERS_CHANNEL}) u
      GROUP BY c_nationkey""",
    "exact_returns_by_customer": f"""
      SELECT c_custkey, c_nationkey, round(CAST(total AS DOUBLE), 2) AS total
      FROM ({CUSTOMER_TOTALS}) t""",
    "exact_above_group_avg": f"""
      WITH t AS ({CUSTOMER_TOTALS})
      SELECT c_custkey, c_nationkey, round(CAST(total AS DOUBLE), 2) AS total FROM t
      WHERE CAST(total AS DOUBLE) > (SELECT avg(CAST(total AS DOUBLE)) * 1.2 FROM t t2
                                     WHERE t2.c_nationkey = t.c_nationkey)
      ORDER BY c_custkey LIMIT 100""",
    "sample_sum_by_group": f"""
      SELECT l_returnflag, l_linestatus, round(sum_price, 2) AS sum_price,
        round(sum_qty, 2) AS sum_qty, cnt, groupsize
      FROM ({flag_answer(f'({FLAG_SAMPLE}) x')}) a""",
    "rescaled_flagship": estimate(
        FLAG_SAMPLE, "", "lineitem", FLAGS, FLAGS, FLAG_SUMS, ("cnt",)
    ),
    "rescaled_sum": estimate(
        TYPE_SAMPLE,
        f"{O_JOIN} {P_JOIN}",
        TYPE_SOURCE,
        TYPE_QCS,
        ("p_type", "o_orderstatus"),
        {"sum_price": money("l_extendedprice")},
        where="o_orderstatus = 'F'",
    ),
    "rescaled_across_strata": estimate(
        sample(SEGMENT_SOURCE, ("c_mktsegment", "o_orderpriority")),
        f"{O_JOIN} {C_JOIN}",
        SEGMENT_SOURCE,
        ("c_mktsegment", "o_orderpriority"),
        ("c_mktsegment",),
        {"sum_price": money("l_extendedprice")},
        ("cnt",),
    ),
    "rescaled_pivot": estimate(
        sample(NATION_SOURCE, ("n_name", "n_regionkey")),
        f"{S_JOIN} {N_JOIN}",
        NATION_SOURCE,
        ("n_name", "n_regionkey"),
        ("n_name",),
        WEEKDAY_SUMS,
        where="n_regionkey = 1",
    ),
    "rescaled_uniform": f"""
      SELECT l_returnflag, round({total(money('l_extendedprice'))} / 0.1::DOUBLE, 2) AS sum_price,
        round(count(*) / 0.1::DOUBLE, 2) AS cnt
      FROM lineitem WHERE {draw(digest(LINE_KEY), 1)} < 0.1 GROUP BY l_returnflag""",
    "rescaled_union": f"""
      SELECT c_nationkey, round(sum(total_sales), 2) AS total_sales
      FROM (SELECT a.c_nationkey, a.total / sampled * groupsize AS total_sales
            FROM (SELECT c_nationkey, o_year, {total(money('l_extendedprice'))} AS total,
                    count(*) AS sampled
                  FROM ({sample(SEGMENT_SOURCE, CHANNEL_QCS)}) s {O_JOIN}
                  JOIN {ACTIVE} c ON o_custkey = c_custkey
                  WHERE o_year = 1999 GROUP BY c_nationkey, o_year) a
            JOIN ({targets(SEGMENT_SOURCE, CHANNEL_QCS, '1')}) t
              ON a.c_nationkey = t.c_nationkey AND a.o_year = t.o_year
            UNION ALL
            SELECT c_nationkey, CAST(total_sales AS DOUBLE) FROM ({ORDERS_CHANNEL}) x) u
      GROUP BY c_nationkey""",
    "self_scaled_error": self_scaled(
        FLAG_SAMPLE,
        "l_returnflag, l_linestatus, "
        + ", ".join(f"round(est_{a}, 2) AS est_{a}" for a in FLAG_AGGS)
        + ", "
        + ", ".join(f"round({truncated(f'est_{a}', a)}, 5) AS err_{a}" for a in FLAG_AGGS),
    ),
    "avg_pct_error": self_scaled(
        FLAG_SAMPLE, f"round({mean_error(truncated, FLAG_AGGS)}, 8) AS avg_pct_error"
    ),
    "avg_pct_error_prescaled": f"""
      SELECT count(*) AS exact_groups, count(est_sum_price) AS sample_groups,
        count(CASE WHEN est_sum_price IS NOT NULL AND {whole('sum_price')} = 0 THEN 1 END)
          AS skipped_groups,
        round((count(*) - count(est_sum_price)) / count(*), 8) AS missing_group_ratio,
        round({mean_error(truncated, ('sum_price',))}, 8) AS avg_pct_error,
        round({mean_error(relative, ('sum_price',))}, 8) AS avg_rel_error
      FROM (SELECT o.p_type, o.sum_price, e.est_sum_price
            FROM (SELECT p_type, {total(money('l_extendedprice'))} AS sum_price
                  FROM {TYPE_SOURCE} WHERE o_orderstatus = 'F' GROUP BY p_type) o
            LEFT JOIN (SELECT a.p_type, a.total / sampled * groupsize AS est_sum_price
                  FROM (SELECT p_type, {total(money('l_extendedprice'))} AS total,
                          count(*) AS sampled
                        FROM {on_sample(TYPE_SAMPLE, f'{O_JOIN} {P_JOIN}')}
                        WHERE o_orderstatus = 'F' GROUP BY p_type) a
                  JOIN (SELECT p_type, count(*) AS groupsize FROM {TYPE_SOURCE}
                        WHERE o_orderstatus = 'F' GROUP BY p_type) t USING (p_type)) e
              USING (p_type)) b""",
    "missing_group_ratio": f"""
      SELECT exact_groups, sample_groups,
        round((exact_groups - sample_groups) / exact_groups, 8) AS missing_group_ratio
      FROM (SELECT count(DISTINCT o_custkey) AS exact_groups,
              count(DISTINCT CASE WHEN u < 0.1 THEN o_custkey END) AS sample_groups
            FROM (SELECT *, {draw(digest(LINE_KEY), 1)} AS u FROM {TYPE_SOURCE}) x
            WHERE {BASKET_FILTER}) y""",
    "evaluate_all": _evaluate_all(),
    "evaluate_sample": " UNION ALL ".join(report(q, FLAG_MIN_ROWS, FLAGS) for q in ("flag", "59")),
    "evaluate_joined": _evaluate_joined(),
    "evaluate_workload": _evaluate_workload(),
    "meta_latest": LATEST,
    "meta_list": f"""
      SELECT key, CAST(json_extract(value, '$.k') AS INTEGER) AS k, ts
      FROM ({LATEST}) l WHERE type = 'purchase'""",
}
