"""Joins: star and snowflake, null-safe, and the checks a prejoin has to pass."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.spec import JoinPair


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def null_safe_join(
    left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on ``columns`` with NULL equal to NULL, keeping one copy of each column."""
    if not columns:
        raise ValueError("a join needs columns")
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in columns})
    condition = all_of(F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns)
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*(f"_r_{c}" for c in columns))


def join_order(
    fact: str, tables: Mapping[str, DataFrame], dims: Iterable[str], pairs: Iterable[JoinPair]
) -> list[tuple[str, list[JoinPair]]]:
    """Dimensions in an order in which each one connects to what is joined already.

    Raises if a pair names an unknown column, if a dimension is not connected,
    or if two tables share a column name (columns are referred to by bare name).
    """
    owner: dict[str, str] = {}
    for table in [fact, *sorted(dims)]:
        for column in tables[table].columns:
            if column in owner:
                raise ValueError(f"column {column} is in both {owner[column]} and {table}")
            owner[column] = table
    open_pairs = sorted(pairs)
    for pair in open_pairs:
        for side in (pair.left, pair.right):
            if side not in owner:
                raise ValueError(f"join pair {pair}: no joined table has column {side}")
    joined, waiting, order = {fact}, sorted(dims), []
    while waiting:
        for dim in waiting:
            links = [
                p
                for p in open_pairs
                if dim in (owner[p.left], owner[p.right])
                and {owner[p.left], owner[p.right]} <= joined | {dim}
            ]
            if links:
                break
        else:
            raise ValueError(f"no join pair connects {waiting} to {sorted(joined)}")
        waiting.remove(dim)
        joined.add(dim)
        open_pairs = [p for p in open_pairs if p not in links]
        order.append((dim, links))
    return order


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst's size estimate is below the session's broadcast limit.

    Read from the session's own plan, as no public API tells it; it picks a plan, never a result.
    """
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def star_join(
    fact: str,
    tables: Mapping[str, DataFrame],
    dims: Iterable[str],
    pairs: Iterable[JoinPair],
) -> DataFrame:
    """Inner equi-join of a fact with its dimensions, direct or through each other.

    There is no broadcast hint: Catalyst broadcasts a dimension when its files
    are small enough and shuffles it otherwise, so a dimension may grow. A
    dimension too large to broadcast first takes in the dimensions behind it, so
    the fact is shuffled for that branch once and not once per table.
    """
    order = join_order(fact, tables, dims, pairs)
    owner = {c: t for t in [fact, *(d for d, _ in order)] for c in tables[t].columns}
    parents = {
        dim: {owner[c] for p in links for c in (p.left, p.right)} - {dim} for dim, links in order
    }
    branch = {dim: tables[dim] for dim, _ in order}
    result, direct = tables[fact], []
    # leaves first: a dimension moves below its only parent if that is a large dimension
    for dim, links in reversed(order):
        above = next(iter(parents[dim]))
        condition = all_of(F.col(p.left) == F.col(p.right) for p in links)
        if len(parents[dim]) == 1 and above != fact and not fits_broadcast(tables[above]):
            branch[above] = branch[above].join(branch[dim], condition, "inner")
        else:
            direct.append((dim, condition))
    for dim, condition in reversed(direct):
        result = result.join(branch[dim], condition, "inner")
    return result


def join_losses(
    fact: str,
    tables: Mapping[str, DataFrame],
    dims: Iterable[str],
    pairs: Iterable[JoinPair],
) -> DataFrame:
    """Per dimension, rows its inner join would drop and rows it would multiply.

    Rows are counted per foreign key value first (combined on the mapper, so a
    hot or NULL key is one row afterwards) and only these counts are joined. A
    dimension behind another one is weighted with the rows that reach it. Each
    step reads one column of the fact. Both numbers are NULL, for unknown, where
    a dimension hangs on several tables at once.
    """
    order = join_order(fact, tables, dims, pairs)
    owner = {c: t for t in [fact, *(d for d, _ in order)] for c in tables[t].columns}
    flows = {fact: tables[fact].withColumn("_rows", F.lit(1).cast("bigint"))}
    checks = []
    for dim, links in order:
        sides = [(p.left, p.right) if owner[p.right] == dim else (p.right, p.left) for p in links]
        outer, own = [s[0] for s in sides], [s[1] for s in sides]
        parents = {owner[c] for c in outer}
        parent = flows.get(parents.pop()) if len(parents) == 1 else None
        if parent is None:
            unknown = F.lit(None).cast("bigint")
            checks.append(
                tables[fact]
                .sparkSession.range(1)
                .select(
                    F.lit(dim).alias("dim"),
                    unknown.alias("dropped_rows"),
                    unknown.alias("multiplied_rows"),
                )
            )
            continue
        reached = parent.groupBy(*outer).agg(F.sum("_rows").alias("_rows"))
        link = all_of(F.col(o) == F.col(c) for o, c in sides)
        flows[dim] = tables[dim].join(reached, link).drop(*outer)
        keys = tables[dim].groupBy(*own).agg(F.count("*").alias("_copies"))
        checks.append(
            reached.join(keys, link, "left").agg(
                F.lit(dim).alias("dim"),
                _rows_where(F.col("_copies").isNull()).alias("dropped_rows"),
                _rows_where(F.col("_copies") > 1).alias("multiplied_rows"),
            )
        )
    return reduce(DataFrame.unionByName, checks)


def _rows_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("_rows"))), F.lit(0).cast("bigint"))
