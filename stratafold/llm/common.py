"""Steps that several operators share: tables, row numbers without a single task, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafold.operators.joins import fits_broadcast
from stratafold.session import pin

#: Bytes of an Arrow batch of whole texts. Spark's own limit is 64 MB, and a task's buffers, which lie
#: outside the heap, hold that several times over.
BATCH_BYTES = 4 << 20
#: Words of 64 marks that the filter before a shuffle has: 2 MB.
MARKED = 1 << 18
#: Rows that one window partition numbers, about.
NUMBERED_TOGETHER = 20_000
#: Window partitions at least, so that small tables also spread over tasks.
LEAST_BUCKETS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """CRC32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // NUMBERED_TOGETHER))


def numbered(
    df: DataFrame, within: list[str], spread: Column, order: list[Column], buckets: int, name: str
) -> DataFrame:
    """Gapless row numbers from 0 within groups of any size.

    Rows are spread over ``buckets`` by a hash of ``spread``; each bucket of a group is
    numbered by itself and starts where the ones before it end. No task sees a whole group.
    ``df`` is read twice and has to be a stored table.
    """
    spread_out = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)))
    group = [*within, "_bucket"]
    counts = spread_out.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group).orderBy(*order)
    rows = spread_out.withColumn("_rank", F.row_number().over(inside) - 1)
    return rows.join(starts, group).withColumn(
        name, (F.col("_start") + F.col("_rank")).cast("long")
    ).drop("_bucket", "_rank", "_start")


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that are run in here hand texts to Python in Arrow batches of about BATCH_BYTES, or less
    if the session says so; a longer text is a batch of its own. The session's limit comes back
    afterwards. What is returned without having been run has the session's own batches.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    limit = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if not 0 < limit <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_rows(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict[str, list]]]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` over whole batches; ``make`` runs once per task and may load a model."""
    types = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if work is None:
                work = make()
            for columns in work(batch):
                arrays = [_array(columns[f.name], f.type) for f in types]
                yield pa.RecordBatch.from_arrays(arrays, schema=types)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def may_match(column: str, wanted: DataFrame) -> Column | None:
    """Whether a row's ``column`` may equal one of ``wanted``, NULL equal to NULL; None where
    ``wanted``, a stored table, is small enough to broadcast.

    Beyond that a join would shuffle all rows. The wanted values, hashed, are marked in a list of
    MARKED words, whatever their number, a value of the plan: rows without a mark match nothing
    and can stay where they are. With many more values than 64 * MARKED it tells less and less.
    """
    if fits_broadcast(wanted):
        return None
    place = F.pmod(F.xxhash64(column), F.lit(64 * MARKED))
    word, bit = F.shiftright(place, 6), (place % 64).cast("int")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    marks = wanted.groupBy(word.alias("id")).agg(F.bit_or(mark).alias("marks"))
    listed = wanted.sparkSession.range(MARKED).join(marks, "id", "left")
    entry = F.struct("id", F.coalesce("marks", F.lit(0).cast("long")).alias("marks"))
    entries = F.sort_array(F.collect_list(entry)).getField("marks")
    held = pin(listed.agg(entries.alias("l")), "marks").scalar()
    return F.getbit(F.get(held, word.cast("int")), bit) == 1


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): nodes share a root iff links connect them.

    Each round every node points at its smallest neighbour, or itself, and the edges move to
    what their ends point at; loops and repeats go. Nodes that are smaller than all their
    neighbours are the only ones left, so at least half of them go in each round. Pointers are
    stored per round and followed backwards at the end. Nothing is gathered on the driver, and
    a hub costs a partial minimum. Null ends are not allowed. No edges give no rows.
    """
    rounds = []
    left = pin(edges.select("a", "b").where("a <> b").distinct(), label)
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        points = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.first("a")).alias("root")
        )
        points = pin(points, label)
        rounds.append(points)
        ends = [points.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")) for x in "ab"]
        moved = left.join(ends[0], "a").join(ends[1], "b")
        moved = moved.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b")
        left = pin(
            moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            label,
        )
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds.pop()
    while rounds:
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("_root"))
        roots = rounds.pop().join(later, "root", "left")
        roots = roots.select("node", F.coalesce("_root", "root").alias("root"))
    return pin(roots, label)
