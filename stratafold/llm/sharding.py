"""Sharding by longest processing time: equal texts stay together, shards get equal bytes."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import buckets_for, numbered
from stratafold.session import pin

#: Group sizes are told apart to this many leading bits: exact below 16 kB, to 1/8192 above.
SIZE_BITS = 14
SCHEMA = "class long, upto array<long>"


def longest_first(classes: list[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """Per size class, the number of its groups that go to each shard, summed up over shards.

    ``classes`` holds (class, groups, bytes). Groups are dealt from the largest to the smallest,
    each to the shard with the least bytes, by a heap; ties go to the smaller shard number.
    Groups of a class weigh the same, so as many as lift a shard to the next one's load go at
    once, and whole rounds when all shards are level. Bounded by the number of classes.
    """
    heap = [(0.0, s) for s in range(shards)]
    plan = {}
    for size, groups, total in sorted(classes, reverse=True):
        weight, taken = total / groups, [0] * shards
        while groups:
            load, shard = heapq.heappop(heap)
            if groups >= shards and max(heap, default=(load, 0))[0] - load <= weight:
                each = groups // shards
                heap = [(x + each * weight, s) for x, s in [*heap, (load, shard)]]
                heapq.heapify(heap)
                taken = [n + each for n in taken]
                groups -= each * shards
                continue
            gap = heap[0][0] - load if heap else groups * weight
            some = min(groups, max(1, int(gap / weight)))
            taken[shard] += some
            groups -= some
            heapq.heappush(heap, (load + some * weight, shard))
        upto, seen = [], 0
        for n in taken:
            seen += n
            upto.append(seen)
        plan[size] = upto
    return plan


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    Law ``bytes``: the shards' sums of size (UTF-8 bytes of the text plus 1) are nearly equal;
    groups of equal texts are never parted. ``slot`` numbers a shard's rows without gaps from 0;
    ``grown_shard`` is null, as one more shard would move rows between the others.

    A null text counts as empty (size 1, CRC 0) and shares the empty texts' group. A null or
    repeated doc_id is kept like any other row. An empty table gives no rows. Other columns are
    ignored, whatever their names. More shards than groups leave the last shards empty.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pin(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    surplus = F.greatest(F.length(F.bin("bytes")) - SIZE_BITS, F.lit(0))
    groups = groups.withColumn("_cut", surplus)
    size_class = F.expr("shiftleft(shiftright(bytes, _cut), _cut)")
    groups = pin(groups.select("key", "bytes", size_class.alias("class")), "shard-groups")

    histogram = groups.groupBy("class").agg(F.count(F.lit(1)), F.sum("bytes")).collect()
    plan = longest_first([tuple(r) for r in histogram], shards)
    deal = spark.createDataFrame(list(plan.items()), SCHEMA) if plan else spark.createDataFrame(
        [], SCHEMA
    )
    total = sum(r[1] for r in histogram)
    ranked = numbered(
        groups, ["class"], F.col("key"), [F.col("key")], buckets_for(total), "_place"
    )
    placed = ranked.join(deal, "class").select(
        "key", F.expr("size(filter(upto, x -> x <= _place))").alias("shard")
    )
    sharded = pin(rows.join(placed, "key"), "sharded")
    slots = numbered(
        sharded,
        ["shard"],
        F.struct("doc_id", "key"),
        [F.col("doc_id"), F.col("key")],
        buckets_for(sharded.count() // shards),
        "slot",
    )
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
