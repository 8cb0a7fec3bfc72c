"""Reproducible randomness: a digest per row, compared as text with hex thresholds.

``rand()`` depends on partitioning and on the order of rows, so a recomputed
task could draw other rows. A digest of the row's key does not. Its first 13 hex
digits are a uniform number in [0, 1) with 52 bits, its next 13 an independent
one. ``u < p`` is tested as ``digest < hex(p)``: text of equal width sorts like
the number it spells, so no row pays for a base conversion.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 13
SCALE = float(2 ** (4 * DIGITS))
EVERYTHING = "g"  # sorts after every hex digit
NOTHING = ""  # sorts before every digest
NULL_MARK = "~"
POSITION = ("_file", "_row")


def row_digest(key: Sequence[str], seed: int | str = 0) -> Column:
    """32 hex digits from the key columns; NULL is a value of its own."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit(NULL_MARK)) for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def second_draw(digest: Column) -> Column:
    """The part of the digest that is independent of its first 13 digits."""
    return F.substring(digest, DIGITS + 1, DIGITS)


def threshold(p: Column) -> Column:
    """Text T with ``digest < T`` exactly when the digest's number is below ``p``."""
    steps = F.ceil(F.greatest(p, F.lit(0.0)) * F.lit(SCALE)).cast("bigint")
    text = F.lower(F.lpad(F.hex(steps), DIGITS, "0"))
    return F.when(p >= 1.0, F.lit(EVERYTHING)).otherwise(text)


def literal_threshold(p: float) -> str:
    if p >= 1.0:
        return EVERYTHING
    return format(math.ceil(max(p, 0.0) * SCALE), f"0{DIGITS}x")


def with_position(df: DataFrame) -> DataFrame:
    """Add the file and row number of a Parquet scan, a key for tables without one.

    Unlike key columns it tells exact copies apart. ``df`` must be a plain scan.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(POSITION[0]),
        F.col("_metadata.row_index").alias(POSITION[1]),
    )
