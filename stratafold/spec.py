"""Descriptions of queries, samples and prejoins. Plain frozen values, no data."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

UNIFORM = "uniform"
STRATIFIED = "stratified"
MIN_ROW = "min_row"

Z_99 = 2.576
E_1PCT = 0.01


def _digest(*parts: Any) -> str:
    return hashlib.md5("\x1f".join(map(str, parts)).encode()).hexdigest()[:10]


def _number(x: float) -> str:
    return f"{x:.4f}".replace(".", "_")


@dataclass(frozen=True, order=True)
class JoinPair:
    """An equality between two columns; the two sides are kept in sorted order."""

    left: str
    right: str

    def __post_init__(self):
        if self.right < self.left:
            low, high = self.right, self.left
            object.__setattr__(self, "left", low)
            object.__setattr__(self, "right", high)

    @classmethod
    def parse(cls, text: str) -> JoinPair:
        left, eq, right = (part.strip() for part in text.partition("="))
        if not (left and eq and right):
            raise ValueError(f"not a join pair: {text!r}")
        return cls(left, right)

    def __str__(self) -> str:
        return f"{self.left} = {self.right}"


def _pairs(pairs: Iterable) -> frozenset[JoinPair]:
    return frozenset(
        p if isinstance(p, JoinPair) else JoinPair.parse(p) if isinstance(p, str) else JoinPair(*p)
        for p in pairs
    )


@dataclass(frozen=True)
class QuerySpec:
    """What a query touches: its fact, dimensions, join pairs and query columns (QCS).

    ``template(fact, tables)`` builds the answer from a fact-shaped DataFrame, so
    the same template serves the fact and any sample of it. ``sample_template
    (sample, tables, sizes)`` is optional and returns an already rescaled answer, so is
    ``joined_template(rows)``, the answer of ``template`` from rows that are joined already.
    """

    id: str
    fact: str
    qcs: tuple[str, ...]
    dims: frozenset[str] = frozenset()
    pairs: frozenset[JoinPair] = frozenset()
    groups: tuple[str, ...] = ()
    aggs: tuple[str, ...] = ()
    template: Callable | None = field(default=None, compare=False, repr=False)
    sample_template: Callable | None = field(default=None, compare=False, repr=False)
    joined_template: Callable | None = field(default=None, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "qcs", tuple(sorted(set(self.qcs))))
        object.__setattr__(self, "dims", frozenset(self.dims) - {self.fact})
        object.__setattr__(self, "pairs", _pairs(self.pairs))
        if self.dims and not self.pairs:
            raise ValueError(f"query {self.id}: joined tables without join pairs")

    @property
    def tables(self) -> frozenset[str]:
        return self.dims | {self.fact}

    def stat_name(self, z: float = Z_99, e: float = E_1PCT) -> str:
        return f"q{self.id}__{_number(z)}__{_number(e)}"

    @property
    def profile_name(self) -> str:
        """Same source and same columns, same strata: shared by such queries."""
        return f"strata_{self.fact}_" + _digest(
            sorted(self.tables), sorted(map(str, self.pairs)), self.qcs
        )


@dataclass(frozen=True)
class PrejoinSpec:
    """A fact joined to dimensions. The name follows from the content."""

    database: str
    fact: str
    tables: frozenset[str]
    pairs: frozenset[JoinPair]
    name: str = ""

    def __post_init__(self):
        object.__setattr__(self, "tables", frozenset(self.tables) | {self.fact})
        object.__setattr__(self, "pairs", _pairs(self.pairs))
        if not self.name:
            digest = _digest(sorted(self.tables), sorted(map(str, self.pairs)))
            object.__setattr__(self, "name", f"prejoin_{self.database}_{digest}")

    @classmethod
    def of(cls, database: str, query: QuerySpec) -> PrejoinSpec:
        return cls(database, query.fact, query.tables, query.pairs)

    def contains(self, other: PrejoinSpec) -> bool:
        return (
            self.database == other.database
            and self.fact == other.fact
            and self.tables >= other.tables
            and self.pairs >= other.pairs
        )

    def supports(self, query: QuerySpec) -> bool:
        return self.contains(PrejoinSpec.of(self.database, query))


@dataclass(frozen=True)
class SampleSpec:
    """One sample of a fact. ``label`` is readable, ``name`` is unique.

    Two queries whose strata come from different joins may share a label but
    never a name, because the digest covers the tables and pairs too.
    """

    kind: str
    fact: str
    qcs: tuple[str, ...] = ()
    tables: frozenset[str] = frozenset()
    pairs: frozenset[JoinPair] = frozenset()
    ratio: float = 0.0
    z: float = Z_99
    e: float = E_1PCT
    min_rows: int = 0

    def __post_init__(self):
        if self.kind not in (UNIFORM, STRATIFIED, MIN_ROW):
            raise ValueError(f"unsupported sample type: {self.kind}")
        if self.kind != UNIFORM and not self.qcs:
            raise ValueError("a stratified sample needs columns")
        object.__setattr__(self, "qcs", tuple(sorted(set(self.qcs))))
        object.__setattr__(self, "tables", frozenset(self.tables) | {self.fact})
        object.__setattr__(self, "pairs", _pairs(self.pairs))

    @property
    def label(self) -> str:
        if self.kind == UNIFORM:
            return f"{self.fact}__uf_{_number(self.ratio)}"
        columns = "_".join(self.qcs)
        if self.kind == STRATIFIED:
            return f"{self.fact}__st_{_number(self.z)}_{_number(self.e)}__{columns}"
        return f"{self.fact}__st2_{self.min_rows}__{columns}"

    @property
    def name(self) -> str:
        prefix = self.label[:80]
        parts = (self.kind, self.fact, self.qcs, sorted(self.tables), sorted(map(str, self.pairs)))
        return f"{prefix}__{_digest(*parts, self.ratio, self.z, self.e, self.min_rows)}"

    def as_query(self) -> QuerySpec:
        """The part of a query the source of this sample has to support."""
        return QuerySpec(self.label, self.fact, self.qcs, self.tables - {self.fact}, self.pairs)
