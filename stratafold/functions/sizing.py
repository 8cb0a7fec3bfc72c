"""How many rows a stratum needs, as a function of its size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratafold.spec import E_1PCT, Z_99

SizeRule = Callable[[Column], Column]


def cochran(z: float = Z_99, e: float = E_1PCT) -> SizeRule:
    """Sample size for a proportion of 1/2 with the finite population correction."""
    unlimited = (z**2 * 0.25) / e**2

    def rule(groupsize: Column) -> Column:
        return (groupsize * F.lit(unlimited)) / (groupsize + F.lit(unlimited) - F.lit(1))

    return rule


def at_least(rows: int) -> SizeRule:
    """The same number of rows for every stratum."""

    def rule(groupsize: Column) -> Column:
        return F.lit(float(rows))

    return rule


def whole_rows(target: Column) -> Column:
    """Rows kept for a fractional target. Rounding first keeps 0.9999999999 at 1."""
    return F.floor(F.round(target, 6))
