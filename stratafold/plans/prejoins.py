"""Which joins to materialise for a workload, and which one serves a query."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from stratafold.spec import PrejoinSpec, QuerySpec


def prejoins_to_build(
    queries: Iterable[QuerySpec], existing: Iterable[PrejoinSpec] = (), database: str = "default"
) -> list[PrejoinSpec]:
    """Largest joins first; a join that an earlier one contains is not built."""
    wanted = [PrejoinSpec.of(database, q) for q in queries if q.dims]
    available, chosen = list(existing), []
    for candidate in sorted(wanted, key=lambda p: -len(p.tables)):
        if not any(p.contains(candidate) for p in available):
            available.append(candidate)
            chosen.append(candidate)
    return chosen


def serves(
    prejoin: PrejoinSpec, query: QuerySpec, lossy: Mapping[str, Sequence[str]] | None = None
) -> bool:
    """Containment, and no join beyond the query's own that changes the set of fact rows.

    ``lossy`` maps a prejoin's name to the tables whose join dropped or
    multiplied fact rows when it was built. A prejoin that joins such a table
    without the query asking for it would silently bias the answer.
    """
    harmful = set((lossy or {}).get(prejoin.name, ()))
    return prejoin.supports(query) and not harmful - query.tables


def best_prejoin(
    query: QuerySpec,
    prejoins: Iterable[PrejoinSpec],
    lossy: Mapping[str, Sequence[str]] | None = None,
) -> PrejoinSpec | None:
    """The serving prejoin with the fewest tables; the name breaks ties."""
    fitting = [p for p in prejoins if serves(p, query, lossy)]
    return min(fitting, key=lambda p: (len(p.tables), p.name), default=None)


def coverage(
    queries: Sequence[QuerySpec], prejoins: Iterable[PrejoinSpec]
) -> dict[str, list[str]]:
    """For each prejoin the ids of all queries it supports."""
    return {p.name: [q.id for q in queries if q.dims and p.supports(q)] for p in prejoins}
