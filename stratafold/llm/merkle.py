"""A Merkle manifest of a corpus by time-forward processing.

Every row is a leaf; leaves of a language form a tree, the languages' subroots another. Nodes are
labelled so that children come before their parent. An upward sweep visits the labels in order: a
priority queue delivers child digests to their parent. A second sweep in reversed order delivers
to every child its siblings' digests and what its parent was given: the proof of a leaf.

The queue is external: blocks of ``2 ** BLOCK_BITS`` neighbours are swept by themselves, with a heap
that never holds more than a message per level, and what leaves a block travels through Spark's
sorted shuffle to the block above, one row per block and sweep. A tree of n leaves takes
log(n) / BLOCK_BITS rounds, whatever share of the rows one language has.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import buckets_for
from stratafold.session import pin

#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a block as a power of two; bounds what a task holds.
BLOCK_BITS = 12
#: Digests to the left and right of a node on its way to the root, a step per level; a node that
#: goes up alone has neither.
PROOF = "array<struct<left: string, right: string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])

Label = tuple[int, int]  # last leaf below a node, its level


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 in hex of the fields, each as ``-`` if null, else its UTF-8 bytes, ``:`` and text."""
    texts = [field.cast("string") for field in fields]
    parts = [
        F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        for text in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``proof`` leads to from ``leaf``."""
    return F.aggregate(
        proof, leaf, lambda below, step: F.sha2(F.concat(step.left, below, step.right), 256)
    )


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf to the root, as one text."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step.left, step.right)), "")


# -- sweeps over a block ------------------------------------------------------------------------


def _hash(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _label(level: int, position: int, leaves: int) -> Label:
    return min((position + 1) << level, leaves) - 1, level


def sweep_up(digests: Sequence[str], levels: int) -> tuple[str, list[tuple[Label, list[str]]]]:
    """The top after ``levels`` levels, and all inner nodes with their children in label order."""
    queue: list[tuple[int, int, int, str]] = []
    nodes = []
    top = digests[0]
    for position, digest in enumerate(digests):
        if levels:
            heapq.heappush(
                queue, (*_label(1, position >> 1, len(digests)), position, digest)
            )
        while queue and queue[0][0] <= position:
            label = queue[0][:2]
            children = []
            while queue and queue[0][:2] == label:
                *_, child, below = heapq.heappop(queue)
                children.append(below)
            nodes.append((label, children))
            top, level, own = _hash(children), label[1], child >> 1
            if level < levels:
                parent = _label(level + 1, own >> 1, len(digests))
                heapq.heappush(queue, (*parent, own, top))
    return top, nodes


def sweep_down(
    nodes: Sequence[tuple[Label, list[str]]], leaves: int, given: tuple
) -> list[tuple[tuple[str, str], ...]]:
    """The proof of every leaf of a block whose top was given the proof ``given``."""
    if not nodes:
        return [given] * leaves
    proofs: list = [given] * leaves
    last = nodes[-1][0]
    queue = [(-last[0], -last[1], given)]
    for (end, level), children in reversed(nodes):
        *_, proof = heapq.heappop(queue)  # the queue's first message is for this node
        first = end >> level << 1  # position of its first child
        for i, _ in enumerate(children):
            step = ("".join(children[:i]), "".join(children[i + 1 :]))
            below = _label(level - 1, first + i, leaves)
            if level == 1:
                proofs[below[0]] = (step, *proof)
            else:
                heapq.heappush(queue, (-below[0], -below[1], (step, *proof)))
    return proofs


def _levels(leaves: int, bits: int) -> int:
    """Levels that a block of a tree of ``leaves`` nodes climbs in one round."""
    return min(bits, (leaves - 1).bit_length())


# -- trees over tables --------------------------------------------------------------------------


def in_order(rows: DataFrame, within: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``idx``, the gapless position from 0 within a group, and its size ``n``.

    Rows are dealt by ranges of the whole order, so a group of any size spreads over tasks; a
    range numbers its own rows and starts where the ranges before it end. ``order`` has to
    tell rows apart, ``within`` must not be null.
    """
    ranged = rows.repartitionByRange(buckets_for(rows.count()), within, *order)
    ranged = pin(ranged.withColumn("_range", F.spark_partition_id()), "merkle-ranges")
    counts = ranged.groupBy(within, "_range").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(within)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        within,
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(group).alias("n"),
    )
    inside = Window.partitionBy(within, "_range").orderBy(*order)
    numbered = ranged.withColumn("_rank", F.row_number().over(inside) - 1)
    return numbered.join(starts, [within, "_range"]).select(
        *rows.columns, (F.col("_start") + F.col("_rank")).alias("idx"), "n"
    )


class Forest:
    """Trees over ``nodes``: ``grp``, ``idx`` from 0, ``n`` nodes of the group, ``digest``; more
    columns pass through. ``tops`` has a row (grp, digest) per tree."""

    def __init__(self, nodes: DataFrame, bits: int = BLOCK_BITS):
        self.bits = bits
        self.rounds = [pin(nodes, "merkle-nodes")]
        largest = self.rounds[0].agg(F.max("n")).first()[0] or 1
        tops = []
        while True:
            raised = pin(self._raised(self.rounds[-1]), "merkle-raised")
            tops.append(raised.where("n = 1"))
            largest = -(-largest >> bits) if largest > 1 << bits else 1
            if largest == 1:
                break
            self.rounds.append(raised.where("n > 1"))
        self._tops = tops
        self.tops = tops[0]
        for more in tops[1:]:
            self.tops = self.tops.unionByName(more)

    def _blocks(self, nodes: DataFrame):
        return nodes.withColumn("block", F.shiftright("idx", self.bits)).groupBy("grp", "block")

    def _raised(self, nodes: DataFrame) -> DataFrame:
        bits = self.bits

        def climb(block: pa.Table) -> pa.Table:
            block = block.sort_by("idx")
            n = block["n"][0].as_py()
            top, _ = sweep_up(block["digest"].to_pylist(), _levels(n, bits))
            return pa.table(
                {
                    "grp": block["grp"][:1],
                    "idx": block["block"][:1],
                    "n": pa.array([-(-n >> bits)], pa.int64()),
                    "digest": pa.array([top]),
                }
            )

        narrow = nodes.select("grp", "idx", "n", "digest")
        return self._blocks(narrow).applyInArrow(
            climb, "grp string, idx long, n long, digest string"
        )

    def proofs(self, given: DataFrame) -> DataFrame:
        """``nodes`` with ``proof``. ``given`` has a row per tree: grp, the proof of its top, and
        columns that all its nodes get."""
        extra = [c for c in given.columns if c not in ("grp", "proof")]
        messages = None
        for nodes, tops in zip(reversed(self.rounds), reversed(self._tops)):
            entering = tops.select("grp", F.col("idx").alias("block")).join(given, "grp")
            messages = entering if messages is None else messages.unionByName(entering)
            lowered = self._lowered(nodes, messages, extra)
            if nodes is self.rounds[0]:
                return lowered
            lowered = lowered.select("grp", F.col("idx").alias("block"), "proof", *extra)
            messages = pin(lowered, "merkle-lowered")

    def _lowered(self, nodes: DataFrame, messages: DataFrame, extra: list[str]) -> DataFrame:
        bits = self.bits
        out = ", ".join(
            [f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema]
            + [f"`{c}` {messages.schema[c].dataType.simpleString()}" for c in extra]
            + [f"proof {PROOF}"]
        )

        def hand_down(block: pa.Table, message: pa.Table) -> pa.Table:
            block = block.sort_by("idx")
            digests = block["digest"].to_pylist()
            given = tuple((s["left"], s["right"]) for s in message["proof"][0].as_py())
            _, inner = sweep_up(digests, _levels(block["n"][0].as_py(), bits))
            proofs = sweep_down(inner, len(digests), given)
            steps = [step for proof in proofs for step in proof]
            flat = pa.StructArray.from_arrays(
                [pa.array([s[side] for s in steps], pa.string()) for side in (0, 1)],
                fields=list(_STEP),
            )
            ends = [0]
            for proof in proofs:
                ends.append(ends[-1] + len(proof))
            block = block.drop_columns(["block"])
            for name in extra:
                value = message[name].combine_chunks()
                block = block.append_column(name, value.take(pa.array([0] * len(digests))))
            return block.append_column("proof", pa.ListArray.from_arrays(ends, flat))

        return (
            self._blocks(nodes)
            .cogroup(messages.groupBy("grp", "block"))
            .applyInArrow(hand_down, out)
        )


# -- the manifest -------------------------------------------------------------------------------


def manifest(
    docs: DataFrame, carried: dict[str, Column] | None = None, bits: int = BLOCK_BITS
) -> DataFrame:
    """A row per document: doc_id, lang, ``leaf``, ``subroot`` of its language, ``root``, ``idx``
    within the language and ``proof``; ``carried`` adds columns computed from ``docs``.

    Leaves of a language ascend by doc_id, null first, then by leaf digest; rows that agree in
    both are equal in all FIELDS, and it doesn't matter which comes first. A null language is a
    tree of its own and comes first, before that of an empty one. Null fields are leaves' fields
    like others. A single row is its own subroot and root, with an empty proof. An empty table
    gives no rows. Columns other than FIELDS are neither hashed nor returned.
    """
    carried = carried or {}
    leaves = docs.select(
        # sorts like the languages, null first
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"),
        "doc_id",
        "lang",
        leaf_digest([F.col(c) for c in FIELDS]).alias("digest"),
        *(column.alias(name) for name, column in carried.items()),
        F.monotonically_increasing_id().alias("_row"),
    )
    leaves = in_order(pin(leaves, "merkle-leaves"), "grp", ["doc_id", "digest", "_row"])
    languages = Forest(leaves.drop("_row"), bits)
    subroots = pin(
        languages.tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"),
        "merkle-subroots",
    )
    whole = Forest(in_order(subroots, "grp", ["name"]), bits)
    no_steps = F.array().cast(PROOF)
    root = whole.tops.select("grp", no_steps.alias("proof"), F.col("digest").alias("root"))
    given = whole.proofs(root).select(
        F.col("name").alias("grp"), "proof", F.col("digest").alias("subroot"), "root"
    )
    rows = languages.proofs(pin(given, "merkle-given"))
    return rows.select(
        "doc_id", "lang", F.col("digest").alias("leaf"), "subroot", "root", "idx", "proof", *carried
    )


def verified(docs: DataFrame, tampered: Column, bits: int = BLOCK_BITS) -> DataFrame:
    """The manifest's digests, checked for every document: rows where ``tampered`` holds are folded
    from a leaf whose n_chars is one more (a null one stays), by the proof of the original.

    A null ``tampered`` counts as false.
    """
    changed = F.when(F.coalesce(tampered, F.lit(False)), F.col("n_chars") + 1)
    seen = [
        F.coalesce(changed, F.col(c)) if c == "n_chars" else F.col(c) for c in FIELDS
    ]
    rows = manifest(docs, {"seen": leaf_digest(seen)}, bits)
    root = folded(F.col("seen"), F.col("proof"))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        root.alias("folded_root"),
        (root == F.col("root")).alias("verified"),
    )


def crc_divides(column: str = "doc_id", by: int = 7) -> Column:
    """Whether the CRC32 of an id in decimal is divisible; an id that is null is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by == 0


def oracle_sql() -> str:
    """The query in SQL: trees level by level, and proofs folded step by step."""

    def field(name: str) -> str:
        text = f"CAST({name} AS VARCHAR)"
        return f"coalesce(strlen({text}) || ':' || {text}, '-')"

    def leaf(n_chars: str) -> str:
        fields = [n_chars if name == "n_chars" else name for name in FIELDS]
        return f"sha256({' || '.join(field(f) for f in fields)})"

    bits = "[1, 2, 3, 4, 5, 6, 7, 8]"
    step = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    crc = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda s, c: list_reduce(list_prepend(xor(s, c), CAST({bits} AS BIGINT[])),
    lambda x, b: {step})), 4294967295)"""

    def tree(name: str, leaves: str) -> str:
        """Nodes (grp, level, idx, digest) of all trees over (grp, idx, digest)."""
        return f"""
{name} AS (
  SELECT grp, 0 AS level, idx, digest, count(*) OVER (PARTITION BY grp) AS n FROM {leaves}
  UNION ALL
  SELECT grp, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)),
    count(*) OVER (PARTITION BY grp)
  FROM {name} WHERE n > 1 GROUP BY grp, level, idx // 2)"""

    def steps(nodes: str, leaf_rows: str, first: str) -> str:
        """Per leaf and level the digests to its left and right."""
        return f"""SELECT l.id, {first} + p.level AS level,
    CASE WHEN (l.idx >> p.level) % 2 = 1 THEN s.digest ELSE '' END AS lft,
    CASE WHEN (l.idx >> p.level) % 2 = 0 THEN coalesce(s.digest, '') ELSE '' END AS rgt
  FROM {leaf_rows} l JOIN {nodes} p ON p.grp = l.grp AND p.idx = (l.idx >> p.level) AND p.n > 1
  LEFT JOIN {nodes} s ON s.grp = l.grp AND s.level = p.level AND s.idx = xor(p.idx, 1)"""

    return f"""
WITH RECURSIVE rows_ AS (SELECT row_number() OVER () AS id, doc_id, lang,
  coalesce('=' || lang, '') AS grp, {leaf('n_chars')} AS digest,
  {leaf(f"CASE WHEN {crc} % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS seen FROM documents),
leaves AS (SELECT *, row_number() OVER
  (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest, id) - 1 AS idx FROM rows_),{tree('nodes', 'leaves')},
subroots AS (SELECT '' AS grp, grp AS name, digest AS subroot, digest,
  row_number() OVER (ORDER BY grp) - 1 AS idx FROM nodes WHERE n = 1),{tree('upper', 'subroots')},
joined AS (SELECT l.id, s.grp, s.idx, s.subroot FROM leaves l JOIN subroots s ON l.grp = s.name),
steps AS ({steps('nodes', 'leaves', '0')}
  UNION ALL
  {steps('upper', 'joined', '1000')}),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS step FROM steps),
fold AS (SELECT id, 0 AS step, seen AS digest FROM leaves
  UNION ALL
  SELECT f.id, p.step, sha256(p.lft || f.digest || p.rgt)
  FROM fold f JOIN placed p ON p.id = f.id AND p.step = f.step + 1),
proof AS (SELECT id, string_agg(lft || rgt, '' ORDER BY step) AS proof FROM placed GROUP BY id)
SELECT l.doc_id, l.digest AS leaf, j.subroot, r.digest AS root,
  sha256(coalesce(p.proof, '')) AS proof_sha256, f.digest AS folded_root,
  f.digest = r.digest AS verified
FROM leaves l JOIN joined j USING (id) CROSS JOIN (SELECT digest FROM upper WHERE n = 1) r
LEFT JOIN proof p USING (id)
JOIN (SELECT id, max_by(digest, step) AS digest FROM fold GROUP BY id) f USING (id)
"""
