"""What state a table is in: the same text as long as its rows are the same.

A frame that only computes rows from files is judged by those files and by what it computes. The
files are listed, never opened, so a state costs the same whatever the size of the table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTING = "path string, size bigint, modified timestamp"
_FILES = "org.apache.spark.sql.execution.datasources.HadoopFsRelation"
#: Plan nodes that make each row from one row of the files.
_ROW_WISE = {"Project", "Filter", "LogicalRelation", "SubqueryAlias", "View"}
#: What a plan's text does not tell apart: functions by their bodies, values by the time or draw.
_OPAQUE = re.compile(
    r"\b(\w*UDF\w*|\w*EvalPython\w*|MapIn\w+|MapPartitions\w*|MapElements|FlatMap\w+|"
    r"current_\w+|now|rand|randn|random|uuid|shuffle|input_file_name)\("
    r"|^[ :|+-]*(\w*EvalPython\w*|MapIn\w+|MapPartitions\w*|FlatMap\w+|Sample|GlobalLimit)\b",
    re.MULTILINE,
)


def _plan(df: DataFrame):
    """The analysed plan. No public API tells a scan from a computed frame, so this reads the
    session's own plan; nothing of it is changed."""
    return df._jdf.queryExecution().analyzed()


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _nodes(plan) -> Iterator[str]:
    yield plan.getClass().getSimpleName()
    for child in _items(plan.children()):
        yield from _nodes(child)


def _roots(plan) -> list[str] | None:
    """The folders each scan reads, in the order of the plan; None if some leaf reads no files."""
    roots = []
    for leaf in _items(plan.collectLeaves()):
        if leaf.getClass().getSimpleName() != "LogicalRelation":
            return None
        relation = leaf.relation()
        if relation.getClass().getName() != _FILES:
            return None
        roots.append(relation.location().rootPaths().mkString(","))
    return roots


def _computed(df: DataFrame) -> str | None:
    """What a frame over files computes, as text; None if that does not say it all."""
    plan = _plan(df)
    roots = _roots(plan)
    text = plan.canonicalized().treeString(True, False, 2**31 - 1, False, False)
    optimised = df._jdf.queryExecution().optimizedPlan().toString()
    if roots is None or _OPAQUE.search(text) or _OPAQUE.search(optimised):
        return None
    return f"{text}\n{roots}"


def is_row_wise(df: DataFrame) -> bool:
    """Whether every row of ``df`` comes from one row of one file, so that added files add rows."""
    return _computed(df) is not None and set(_nodes(_plan(df))) <= _ROW_WISE


def files_of(df: DataFrame) -> DataFrame:
    """Path, size and time of change of the files behind a frame, one row each."""
    paths = [unquote(path) for path in df.inputFiles()]
    spark = df.sparkSession
    if not paths:
        return spark.range(0).selectExpr("'' AS path", "id AS size", "timestamp(null) AS modified")
    listed = spark.read.format("binaryFile").load(paths)
    return listed.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def state_of(df: DataFrame) -> str:
    """A digest of the files behind a frame, by path, size and time of change, and of what it
    computes from them.

    For a frame over files it reads ``computation-files``, two digests, and the files are only
    listed. A frame whose rows its plan does not determine (rows from the driver,
    Python functions, random values, samples and limits) is digested by its rows: their number and
    the sum of their hashes, in one pass.
    """
    computed = _computed(df)
    rows = df if computed is None else files_of(df)
    digest = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    number, total = rows.agg(F.count(F.lit(1)), F.sum(digest)).first()
    content = _md5(f"{number}:{total}")
    return _md5(f"{df.dtypes}:{content}") if computed is None else f"{computation(df)}-{content}"


def computation(df: DataFrame) -> str | None:
    """A digest of what a frame computes from files, whichever they are; None if unknown."""
    computed = _computed(df)
    return None if computed is None else _md5(f"{df.dtypes}:{computed}")


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def appended(was: DataFrame, now: DataFrame) -> list[str] | None:
    """Paths that ``now`` lists beyond ``was``; None if a listed file is gone or has changed.

    The paths become a filter of a scan, so they come to the driver: as many as were added.
    """
    old = was.select("path", F.struct("size", "modified").alias("old"))
    both = old.join(now.select("path", F.struct("size", "modified").alias("new")), "path", "full")
    touched = both.where(F.col("old").isNull() | F.col("new").isNull() | (F.col("old") != F.col("new")))
    paths = []
    for row in touched.select("path", F.col("old").isNull().alias("added")).collect():
        if not row.added:
            return None
        paths.append(row.path)
    return sorted(paths)


def rows_of(df: DataFrame, paths: list[str]) -> DataFrame:
    """The rows of a row-wise frame that come from some of its files; the others are not read."""
    return df.where(F.col("_metadata.file_path").isin(paths))
