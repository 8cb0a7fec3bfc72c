"""Benchmark decontamination over a positional inverted index of the training documents."""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm.common import arrow_rows, bounded_batches
from stratafold.session import pin

#: Words of a window, and how many words more a proximity match may stretch to either side.
WINDOW, SLOP = 13, 3
#: UTF-8 bytes of benchmark texts that are searched for at once; more take more rounds.
BLOCK_BYTES = 8_000_000
#: Tasks that the documents of one term are spread over; documents that are compared at once.
SALT, TOGETHER = 16, 512
_KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Words of a text: letters, digits and all that isn't ASCII; A to Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split()


@dataclass(frozen=True)
class Items:
    """One block of benchmark items, bounded by BLOCK_BYTES: names, and words as term numbers."""

    terms: dict[bytes, int]
    names: list[str]
    texts: list[np.ndarray]

    @staticmethod
    def of(rows) -> Items:
        names, split = [], []
        for name, text in rows:
            found = words(text)
            if found:
                names.append("" if name is None else str(name))
                split.append(found)
        # numbers follow the words' order, so that ties don't depend on the order of rows
        terms = {w: i for i, w in enumerate(sorted({w for found in split for w in found}))}
        texts = [np.array([terms[w] for w in found], np.int32) for found in split]
        return Items(terms, names, texts)

    def windows(self):
        """(item, first word, its terms) of every window."""
        for item, text in enumerate(self.texts):
            size = min(WINDOW, len(text))
            for first in range(len(text) - size + 1):
                yield item, first, text[first : first + size]


def _frequencies(docs: DataFrame, items: Items) -> np.ndarray:
    """How often each benchmark term occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items.terms)

    def make():
        known = shared.value

        def work(batch):
            found = Counter()
            for text in batch["text"]:
                found.update(w for w in words(text.as_py()) if w in known)
            yield {"term": [known[w] for w in found], "n": list(found.values())}

        return work

    counts = arrow_rows(docs.select("text"), make, "term int, n long")
    out = np.zeros(len(items.terms), np.int64)
    with bounded_batches(docs.sparkSession):
        totals = counts.groupBy("term").agg(F.sum("n")).collect()
    for term, n in totals:
        out[term] = n
    return out


def rarest(items: Items, frequency: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Term to the (item, position) where it is the rarest of some window.

    A window with a term that no document holds can't occur and needs no posting.
    """
    at: dict[int, set[tuple[int, int]]] = {}
    for item, first, terms in items.windows():
        counts = frequency[terms]
        if counts.min() > 0:
            offset = int(np.lexsort((terms, counts))[0])
            at.setdefault(int(terms[offset]), set()).add((item, first + offset))
    return {term: sorted(places) for term, places in at.items()}


def index(docs: DataFrame, items: Items, rare: dict, reach: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words) and the stored postings (term, row, positions).

    Postings are kept of all benchmark terms that stand within ``reach`` words of a window's
    rarest term: no match lies outside. They are clustered by term, a frequent one over several
    tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast((items.terms, np.array(sorted(rare), int)))

    def make():
        known, anchors = shared.value
        is_anchor = np.zeros(len(known) + 1, bool)
        is_anchor[anchors] = True

        def work(batch):
            sizes, postings = [], []
            for text in batch["text"]:
                found = words(text.as_py())
                sizes.append(len(found))
                get = known.get
                numbers = np.array([get(w, -1) for w in found], np.int32)
                near = np.flatnonzero(is_anchor[numbers])
                if not len(near):
                    postings.append([])
                    continue
                edge = np.zeros(len(found) + 1, np.int32)
                np.add.at(edge, np.maximum(near - reach, 0), 1)
                np.add.at(edge, np.minimum(near + reach + 1, len(found)), -1)
                at = np.flatnonzero((edge.cumsum()[:-1] > 0) & (numbers >= 0))
                order = at[np.argsort(numbers[at], kind="stable")]
                terms, starts = np.unique(numbers[order], return_index=True)
                lists = np.split(order, starts[1:])
                postings.append(
                    [{"term": int(t), "positions": p} for t, p in zip(terms, lists)]
                )
            yield {
                "row": batch["row"].to_pylist(),
                "doc_id": batch["doc_id"].to_pylist(),
                "n_words": sizes,
                "postings": postings,
            }

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = (
        f"row long, doc_id {kind}, n_words long, "
        "postings array<struct<term int, positions array<int>>>"
    )
    with bounded_batches(docs.sparkSession):
        rows = pin(arrow_rows(given, make, schema), "decon-docs")
    postings = rows.select("row", F.explode("postings").alias("p")).select(
        F.col("p.term").alias("term"), "row", F.col("p.positions").alias("positions")
    )
    salt = F.pmod(F.xxhash64("row"), F.lit(SALT))
    return rows.select("row", "doc_id", "n_words"), pin(
        postings.repartition("term", salt), "decon-postings"
    )


def _matches(postings: DataFrame, items: Items, rare: dict, frequency: np.ndarray) -> DataFrame:
    """(row, hits, found, near): hit positions and items, by intersecting posting lists.

    The rarest terms' lists come first: moved back by the term's place in the item they give the
    alignments of a document and an item that are left; the other terms' lists are then met only
    in those documents. A window occurs where all its terms have the alignment in common.
    """
    spark = postings.sparkSession
    places = [(t, i, p) for t, where in rare.items() for i, p in where]
    # bounded by the words of one block
    anchors = F.broadcast(spark.createDataFrame(places, "term int, item int, place int"))
    aligned = (
        postings.join(anchors, "term")
        .select("row", "item", F.explode("positions").alias("position"), "place")
        .groupBy("row", "item")
        .agg(F.collect_set(F.col("position") - F.col("place")).alias("starts"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("item", "starts")).alias("aligned"))
    )
    lists = postings.groupBy("row").agg(
        F.collect_list(F.struct("term", "positions")).alias("lists")
    )
    shared = spark.sparkContext.broadcast((items, frequency, rare))

    def make():
        block, counts, anchors = shared.value
        places = {(i, p) for where in anchors.values() for i, p in where}
        spans: dict[int, dict[int, list[frozenset[int]]]] = {}
        for item, first, terms in block.windows():
            offset = int(np.lexsort((terms, counts[terms]))[0])
            if (item, first + offset) in places:
                middle = int(terms[offset])
                others = frozenset(terms.tolist()) - {middle}
                spans.setdefault(item, {}).setdefault(middle, []).append(others)

        def work(batch):
            for at in range(0, batch.num_rows, TOGETHER):
                yield compared(batch.slice(at, TOGETHER))

        def compared(batch):
            out = {"row": batch["row"].to_pylist(), "hits": [], "found": [], "near": []}
            for lists, aligned in zip(batch["lists"].to_pylist(), batch["aligned"].to_pylist()):
                at = {x["term"]: np.sort(np.array(x["positions"])) for x in lists}
                where = np.concatenate([*at.values()])
                order = np.argsort(where)
                where = where[order]
                which = np.repeat(list(at), [len(x) for x in at.values()])[order]
                hits, found, near = set(), set(), set()
                for entry in aligned:
                    item = entry["item"]
                    starts = np.sort(np.array(entry["starts"]))
                    exact = _phrases(block.texts[item], starts, where, which)
                    if exact:
                        found.add(block.names[item])
                        hits.update(exact)
                    if exact or _close(spans.get(item, {}), at):
                        near.add(block.names[item])
                out["hits"].append(sorted(hits))
                out["found"].append(sorted(found))
                out["near"].append(sorted(near))
            return out

        return work

    schema = "row long, hits array<int>, found array<string>, near array<string>"
    return arrow_rows(lists.join(aligned, "row"), make, schema)


def _phrases(text, starts, where, which) -> set[int]:
    """Document positions inside occurrences of the item's windows.

    ``starts`` are the alignments that the rarest terms' lists leave; ``where`` and ``which``
    are the positions and terms of all lists of the document.
    """
    size, hits = min(WINDOW, len(text)), set()
    wanted = starts[:, None] + np.arange(len(text))
    at = np.minimum(np.searchsorted(where, wanted), len(where) - 1)
    matched = (where[at] == wanted) & (which[at] == text)
    if matched.sum(1).max() < size:
        return hits
    sums = np.cumsum(np.pad(matched, ((0, 0), (1, 0))), axis=1)
    for s, first in zip(*np.nonzero(sums[:, size:] - sums[:, :-size] == size)):
        begin = int(starts[s] + first)
        hits.update(range(begin, begin + size))
    return hits


def _close(spans: dict[int, list[frozenset[int]]], at: dict[int, np.ndarray]) -> bool:
    """Whether all terms of a window stand within WINDOW - 1 + SLOP words of its rarest term."""
    reach = WINDOW - 1 + SLOP
    for middle, windows in spans.items():
        if middle not in at:
            continue
        for others in windows:
            if not others <= at.keys():
                continue
            near = np.ones(len(at[middle]), bool)
            for term in others:
                low = np.searchsorted(at[term], at[middle] - reach)
                near &= np.searchsorted(at[term], at[middle] + reach, side="right") > low
            if near.any():
                return True
    return False


def _blocks(benchmark: DataFrame):
    """The items in blocks of about BLOCK_BYTES, all rows of an item in one block."""
    given = benchmark.select("item_id", "text")
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id"), F.lit(count))
    for number in range(count):
        part = given if count == 1 else given.where(block == number)
        yield Items.of(part.collect())


def _digest(names: list[str] | None) -> str:
    return hashlib.sha256(",".join(names or []).encode()).hexdigest()


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, hits, found, near) for every row of ``docs``.

    ``hits`` are the positions of words inside an occurrence of a window, ``found`` the items
    with occurring windows, ``near`` those whose windows occur or have all their terms within
    12 + SLOP words of their rarest one, in any order.

    Rows that share an item_id are one item; a null item_id is named by the empty text. Items
    without words have no window. A null text has no words. A null or repeated doc_id is kept
    like any other row. An empty benchmark gives no hits, an empty table no rows. Other columns
    are ignored.
    """
    rows, parts = None, []
    for items in _blocks(benchmark):
        frequency = _frequencies(docs, items)
        rare = rarest(items, frequency)
        sizes, postings = index(docs, items, rare, WINDOW - 1 + SLOP)
        rows = rows if rows is not None else sizes
        if rare:
            parts.append(_matches(postings, items, rare, frequency))
    if not parts:
        nothing = {"hits": "array<int>", "found": "array<string>", "near": "array<string>"}
        return rows.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    met = parts[0]
    for part in parts[1:]:
        met = met.union(part)
    if len(parts) > 1:
        gathered = [
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
            for c in ("hits", "found", "near")
        ]
        met = met.groupBy("row").agg(*gathered)
    return rows.join(met, "row", "left")


def _size(column: str) -> Column:
    return F.coalesce(F.size(F.col(column)), F.lit(0)).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts and verdict per row of ``search``: contaminated where hits are a twentieth or more."""
    found = search(docs, benchmark)
    names = F.coalesce(F.array_sort("found"), F.array().cast("array<string>"))
    hit = F.when(F.col("hits").isNull(), F.lit(0)).otherwise(F.size("hits")).cast("long")
    return found.withColumn("n_hit", hit).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.when(F.col("near").isNull(), F.lit(0)).otherwise(F.size("near")).cast("long").alias("n_near"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones. Rows that share a doc_id go or stay together."""
    bad = contamination(docs, benchmark).where("contaminated").select("doc_id").distinct()
    with bounded_batches(docs.sparkSession):
        bad = pin(bad, "contaminated")
    same = docs["doc_id"].eqNullSafe(bad["doc_id"])
    return docs.join(bad, same, "left_anti")


def oracle_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = "regexp_extract_all(" + lower.format("coalesce(text, '')") + f", '{word}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {found} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS size,
  list_slice(w, s, s + least({WINDOW}, len(w)) - 1) AS g
  FROM (SELECT *, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s FROM i WHERE len(w) > 0) AS t),
sizes AS (SELECT DISTINCT size FROM win),
heads AS (SELECT DISTINCT size, g[1] AS head FROM win),
tok AS (SELECT r, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
cand AS (SELECT r, p, size, list_slice(w, p, p + size - 1) AS g
  FROM tok JOIN heads ON word = head WHERE p + size - 1 <= len(w)),
occ AS (SELECT r, p, cand.size, item FROM cand JOIN win ON cand.g = win.g),
hit AS (SELECT r, count(DISTINCT q) AS n_hit
  FROM (SELECT r, unnest(range(p, p + size)) AS q FROM occ) AS t GROUP BY r),
freq AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
mids AS (SELECT item, g, arg_min(u, coalesce(lpad(CAST(n AS VARCHAR), 12, '0'), '') || u) AS mid
  FROM (SELECT item, g, unnest(g) AS u FROM win) AS t LEFT JOIN freq ON word = u GROUP BY item, g),
nearby AS (SELECT r, count(DISTINCT item) AS n_near FROM tok JOIN mids ON word = mid
  WHERE list_has_all(list_slice(w, greatest(1, p - {WINDOW - 1 + SLOP}), p + {WINDOW - 1 + SLOP}), g)
  GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM occ) AS t GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN nearby USING (r)
"""
