"""MinHash near duplicates by an inverted join over signature coordinates.

Documents are posted under every (coordinate, value) of their signature. Pairs with at least
m equal coordinates (``matches``) share one among the COORDINATES - m + 1 rarest of each, so only
that prefix is posted (prefix merging), and documents whose prefix no other shares are passed over
(skip merging). Documents connected by such pairs are a family; within families links are
confirmed on the full shingle sets. All pairs are compared, but only links that connect go on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import arrow_rows, bounded_batches, components, may_match
from stratafold.session import pin

SHINGLE = 5
#: Coordinates of a signature, and the share of pairs at the threshold that may collide too rarely.
COORDINATES, MISSED = 32, 2e-5
#: Percent of the union that the intersection holds at least, if no other threshold is given.
PERCENT = 85
#: Nodes of a list, and of a family, that one block holds, about.
LIST_BLOCK, FAMILY_BLOCK = 512, 128
#: Groups that families of one block are gathered into, and shingles that are compared at once.
BINS, SLICE = 1024, 8192
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORDS_CACHED = 100_000


def matches(percent: int) -> int:
    """Equal coordinates that all but MISSED of the pairs at the threshold have at least."""
    p, fewer = percent / 100, 0.0
    for m in range(COORDINATES):
        fewer += math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if fewer > MISSED:
            return max(1, m)
    return COORDINATES


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit digests of all runs of five words; of the whole if there are fewer."""
    if len(cache) > _WORDS_CACHED:
        cache.clear()
    digests = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        digests.append(h)
    each = np.array(digests, np.uint64)
    if not len(each):
        return each
    size = min(SHINGLE, len(each))
    runs = np.full(len(each) - size + 1, np.uint64(size))
    for i in range(size):
        runs = runs * _ODD + each[i : len(each) - size + 1 + i]
    return np.unique(_mixed(runs))


def _seeds() -> np.ndarray:
    return np.random.default_rng(8).integers(1, 2**63, COORDINATES, dtype=np.uint64)


def signature(sets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The smallest 32-bit digest of the set under every seed."""
    out = np.empty(len(seeds), np.uint32)
    for i, seed in enumerate(seeds):
        h = (sets ^ seed) * _ODD
        out[i] = (h >> np.uint64(32)).min()
    return out


def _md5(column: str) -> Column:
    return F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary"))


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n_shingles, signature, text_md5); node is a digest of all words, null
    without any."""

    def make():
        cache: dict[bytes, int] = {}
        seeds = _seeds()

        def work(batch):
            nodes, sizes, found = [], [], []
            for text in batch["text"]:
                words = tokens(text.as_py())
                sets = shingles(words, cache)
                sizes.append(len(sets))
                nodes.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                found.append(signature(sets, seeds).tobytes() if words else None)
            yield {
                "doc_id": batch["doc_id"].to_pylist(),
                "node": nodes,
                "n_shingles": sizes,
                "signature": found,
                "text_md5": batch["text_md5"],
            }

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, node binary, n_shingles long, signature binary, text_md5 string"
    return arrow_rows(docs.select("doc_id", "text", _md5("text").alias("text_md5")), make, schema)


def _postings(classes: DataFrame, least: int) -> DataFrame:
    """(token, node): each node under the rarest coordinates of its signature that others share."""

    def make():
        def work(batch):
            raw = b"".join(batch["signature"].to_pylist())
            values = np.frombuffer(raw, np.uint32).reshape(-1, COORDINATES).astype(np.int64)
            numbers = (np.arange(COORDINATES, dtype=np.int64) << 32)[None, :] | values
            nodes = batch["node"].to_pylist()
            yield {
                "token": numbers.ravel(),
                "node": [n for n in nodes for _ in range(COORDINATES)],
            }

        return work

    posted = arrow_rows(classes.select("node", "signature"), make, "token long, node binary")
    posted = pin(posted, "minhash-tokens")
    common = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = posted.join(common, "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("n", "token"))).alias("lists")
    )
    # coordinates that no one shares are the rarest: they take up places of the prefix
    places = F.greatest(F.lit(0), F.size("lists") - (least - 1))
    kept = shared.withColumn("kept", F.slice("lists", F.lit(1), places))
    return kept.select("node", F.explode("kept.token").alias("token"))


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with this symmetric adjacency matrix."""
    out, left = [], np.ones(len(near), bool)
    for start in range(len(near)):
        if not left[start]:
            continue
        left[start] = False
        stack = [start]
        while stack:
            x = stack.pop()
            met = np.flatnonzero(near[x] & left)
            left[met] = False
            out += [(x, int(y)) for y in met]
            stack += met.tolist()
    return out


def _block_pairs(df: DataFrame, size: Column, together: int) -> DataFrame:
    """Rows of a group of ``size`` rows dealt to pairs of blocks (i, j), so that every two rows
    of the group meet in one of them and no task holds more than two blocks."""
    blocks = F.ceil(size / together)
    dealt = df.withColumns(
        {"_of": blocks, "_own": F.pmod(F.xxhash64("node"), blocks)}
    ).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)))
    return dealt.withColumns(
        {"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")}
    ).drop("_own", "_other", "_of")


def _alike(lists: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """(a, b): links that connect all nodes of a list whose signatures collide in ``least`` or more.

    Lists are merged in pairs of blocks; of the collisions found there only a spanning forest
    goes on, so the output is no longer than the postings.
    """
    sizes = lists.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = lists.join(sizes.where("n > 1"), "token").join(
        classes.select("node", "signature"), "node"
    )
    merged = _block_pairs(posted, F.col("n"), LIST_BLOCK).groupBy("token", "i", "j").agg(
        F.collect_list("node").alias("nodes"), F.collect_list("signature").alias("signatures")
    )

    def make():
        def work(batch):
            a, b = [], []
            for nodes, raw in zip(batch["nodes"].to_pylist(), batch["signatures"].to_pylist()):
                found = np.frombuffer(b"".join(raw), np.uint32).reshape(-1, COORDINATES)
                same = np.zeros((len(nodes), len(nodes)), np.uint8)
                for column in found.T:
                    same += column[:, None] == column[None, :]
                for x, y in _forest(same >= least):
                    a.append(min(nodes[x], nodes[y]))
                    b.append(max(nodes[x], nodes[y]))
            yield {"a": a, "b": b}

        return work

    return arrow_rows(merged.select("nodes", "signatures"), make, "a binary, b binary").distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, over slices of the shingles that occur."""
    every = np.unique(np.concatenate(sets))
    out = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, len(every), SLICE):
        some = every[at : at + SLICE]
        held = np.zeros((len(sets), len(some)), np.float32)
        for i, one in enumerate(sets):
            low = np.searchsorted(one, some[0], side="left")
            high = np.searchsorted(one, some[-1], side="right")
            held[i, np.searchsorted(some, one[low:high])] = 1
        out += held @ held.T
    return out


def _confirmed(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what full sets link within (family, node, shingles)."""
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    small = F.concat(F.lit("small"), F.pmod(F.xxhash64("family"), F.lit(BINS))).cast("binary")
    dealt = _block_pairs(members.join(sizes, "family"), F.col("n"), FAMILY_BLOCK)
    # families of one block share tasks' groups; larger ones have groups of their own
    dealt = dealt.withColumn("bin", F.when(F.col("n") <= FAMILY_BLOCK, small).otherwise(F.col("family")))

    def confirm(group: pa.Table) -> pa.Table:
        a, b = [], []
        families: dict[bytes, list[int]] = {}
        for row, family in enumerate(group["family"].to_pylist()):
            families.setdefault(family, []).append(row)
        for rows_ in families.values():
            part = group.take(rows_)
            nodes = part["node"].to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in part["shingles"].to_pylist()]
            both = _overlaps(sets)
            counts = np.array([len(x) for x in sets], np.float64)
            union = counts[:, None] + counts[None, :] - both
            for x, y in _forest(100 * both >= percent * union):
                a.append(min(nodes[x], nodes[y]))
                b.append(max(nodes[x], nodes[y]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    groups = dealt.select("bin", "i", "j", "family", "node", "shingles").groupBy("bin", "i", "j")
    return groups.applyInArrow(confirm, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted (node, doc_id), each from a document that has its words.

    The wanted are stored first: while they are few they are broadcast, beyond that the texts of
    other documents are held back, so that no shuffle takes all texts.
    """
    wanted = pin(wanted, "minhash-wanted")

    def make():
        cache: dict[bytes, int] = {}

        def work(batch):
            nodes, found = [], []
            for node, text in zip(batch["node"].to_pylist(), batch["text"]):
                words = tokens(text.as_py())
                if xxhash.xxh3_128_digest(b" ".join(words)) == node:
                    nodes.append(node)
                    found.append(shingles(words, cache).tobytes())
            yield {"node": nodes, "shingles": found}

        return work

    likely = may_match("doc_id", wanted)
    given = docs if likely is None else docs.where(likely)
    given = given.select("doc_id", "text").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    texts = given.join(wanted.alias("w"), same).select("w.node", "d.text")
    made = arrow_rows(texts, make, "node binary, shingles binary")
    return made.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _linked(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The stored rows of ``_signatures``, and (node, least, root): nodes share a root iff links
    connect them."""
    with bounded_batches(docs.sparkSession):
        rows = pin(_signatures(docs), "minhash-rows")
    classes = pin(
        rows.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("least"),
            F.first("signature").alias("signature"),
        ),
        "minhash-classes",
    )
    least = matches(percent)
    lists = pin(_postings(classes, least), "minhash-lists")
    with bounded_batches(docs.sparkSession):
        families = components(_alike(lists, classes, least), "minhash-families")
    named = classes.select("node", F.col("least").alias("doc_id")).join(families, "node", "left_semi")
    members = _sets(docs, named).join(
        families.select("node", F.col("root").alias("family")), "node"
    )
    with bounded_batches(docs.sparkSession):
        members = pin(members, "minhash-members")
        roots = components(_confirmed(members, percent), "minhash-components")
    nodes = classes.select("node", "least").join(roots, "node", "left")
    return rows, nodes.withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Linked are documents whose sets of distinct five-word shingles overlap in ``percent`` of their
    union or more; a document of fewer words is one shingle. ``component_id`` is the smallest
    doc_id reachable by links. Documents with the same words are one node and never paired up.

    A null text, an empty one and one without words have no shingles and link with nothing; their
    component is their own doc_id. Rows that repeat a doc_id are documents of their own under
    that id. A null doc_id takes part but is no one's smallest id unless there is no other.
    An empty table gives no rows. Other columns are ignored.
    """
    rows, nodes = _linked(docs, percent)
    smallest = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(smallest, "root").select("node", "component_id")
    component = F.coalesce("component_id", "doc_id")
    return rows.join(nodes, "node", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without near duplicates: of each component one row stays, one with its smallest
    doc_id, of several the one whose text has the smallest digest. A row without a doc_id stays
    only where no row of its component has one. Rows are told apart by doc_id and text, so a row
    that shares its id with a duplicate is judged by its own text. Rows without shingles stay.
    """
    rows, nodes = _linked(docs, percent)
    named = rows.select("doc_id", "text_md5", "node").join(nodes.select("node", "root"), "node")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_md5")
    counted = named.groupBy("root", "doc_id", "text_md5").agg(F.count(F.lit(1)).alias("n"))
    counted = pin(counted.select("root", "n", order.alias("at")), "minhash-counted")
    first = counted.groupBy("root").agg(F.min("at").alias("first"))
    judged = counted.join(first, "root").where("at <> first OR n > 1")
    judged = judged.select(
        F.col("at.doc_id").alias("doc_id"),
        F.col("at.text_md5").alias("text_md5"),
        (F.col("at") == F.col("first")).alias("repeated"),
    )
    judged = pin(judged, "minhash-judged")

    def same(given: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(given["doc_id"]) & (
            F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")) == given["text_md5"]
        )

    likely = may_match("doc_id", judged)
    given = docs if likely is None else docs.where(likely)
    alone = given.join(judged, same(judged), "left_anti")
    if likely is not None:
        alone = docs.where(~likely).unionByName(alone)
    repeated = judged.where("repeated")
    if repeated.isEmpty():
        return alone
    once = given.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return alone.unionByName(once)
