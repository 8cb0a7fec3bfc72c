"""Aggregate queries over a star, given once and answered from the fact or a sample."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators.approx import rescaled
from stratafold.operators.joins import all_of, star_join
from stratafold.spec import UNIFORM, QuerySpec, SampleSpec


def swap(tables: Mapping[str, DataFrame], name: str, rows: DataFrame) -> Mapping[str, DataFrame]:
    """``tables`` with ``rows`` in place of one of them; the others are not touched."""
    return ChainMap({name: rows}, tables)


def money(column: str) -> Column:
    """Two exact decimals, so a sum does not depend on the order of rows."""
    return F.col(column).cast("decimal(18,2)")


def aggregate(
    rows: DataFrame, groups: Sequence[str], sums: Mapping[str, Column], counts: Sequence[str] = ()
) -> DataFrame:
    """Sums and counts per group, with the number of rows as ``groupsize``."""
    return rows.groupBy(*groups).agg(
        *(F.sum(v).cast("double").alias(n) for n, v in sums.items()),
        *(F.count("*").alias(n) for n in counts),
        F.count("*").alias("groupsize"),
    )


def star_query(
    id: str,
    fact: str,
    pairs: Sequence[str],
    dims: Sequence[str],
    qcs: Sequence[str],
    groups: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    counts: Sequence[str] = (),
    pinned: Mapping[str, Any] | None = None,
    where: Column | None = None,
) -> QuerySpec:
    """A query spec whose exact and rescaled answers follow from one description."""
    sums, pinned = dict(sums or {}), dict(pinned or {})
    fixed = [F.col(c) == F.lit(v) for c, v in pinned.items()]
    conditions = fixed + ([where] if where is not None else [])

    def exact(fact_rows: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
        return joined(star_join(fact, swap(tables, fact, fact_rows), spec.dims, spec.pairs))

    def joined(rows: DataFrame) -> DataFrame:
        if conditions:
            rows = rows.where(all_of(conditions))
        return aggregate(rows, groups, sums, counts)

    def estimate(
        sample: DataFrame, tables: Mapping[str, DataFrame], sizes: DataFrame, made: SampleSpec
    ) -> DataFrame:
        # the strata are those the sample was made with, which may need joins of their own
        dims_needed = spec.dims | (made.tables - {fact})
        rows = star_join(fact, swap(tables, fact, sample), dims_needed, spec.pairs | made.pairs)
        strata = {c: v for c, v in pinned.items() if c in made.qcs}
        rest = [F.col(c) == F.lit(v) for c, v in pinned.items() if c not in made.qcs]
        rest += [where] if where is not None else []
        return rescaled(
            rows,
            sizes,
            made.qcs,
            groups,
            sums,
            counts,
            pinned=strata,
            where=all_of(rest) if rest else None,
            ratio=made.ratio if made.kind == UNIFORM else None,
            # the sample's own joins lose no stratum, further ones may
            whole_strata=dims_needed == made.tables - {fact},
        )

    spec = QuerySpec(
        id,
        fact,
        tuple(qcs),
        frozenset(dims),
        frozenset(pairs),
        tuple(groups),
        (*sums, *counts),
        exact,
        estimate,
        joined,
    )
    return spec


def sql_template(text: str):
    """A template from SQL text with ``{fact}`` and table names in braces.

    >>> sql_template("SELECT k, sum(v) AS v, count(*) AS groupsize FROM {fact} GROUP BY k")
    """

    def template(fact_rows: DataFrame, tables: Mapping[str, DataFrame], **more) -> DataFrame:
        known = ChainMap(more, tables)
        frames = {name: known[name] for name in known if f"{{{name}}}" in text}
        return fact_rows.sparkSession.sql(text, fact=fact_rows, **frames)

    return template
