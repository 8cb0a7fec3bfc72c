"""Phrase collocations, counted in quotient filters.

1. Texts are read once. Each task cuts them into chunks of about CHUNK words and stores a chunk as
   numbers of its own small dictionary, which lists each of its words once, with its count.
2. The dictionaries add up to exact counts of words. Words that are frequent enough to be part of a
   phrase get a number from 1; every chunk is told the numbers of its own words only.
3. A chunk's n-grams are packed word numbers. An invertible permutation spreads them evenly; the top
   bits of the result are the quotient, all others the remainder, so nothing is lost. Sorted
   remainders, the length of each quotient's run and a counter per entry are the chunk's filter.
4. Filters are sorted by quotient, so filters of all chunks merge range by range: a task takes one
   range of quotients, adds the counters up and turns the frequent entries back into words.

The permutation makes the ranges equal however often a word, phrase or language occurs, and a chunk
has one entry per n-gram, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import buckets_for, numbered
from stratafold.session import pin

LEAST = 10  # occurrences of a candidate
TOP = 2000  # phrases reported per language
SCALE = 1_000_000
ENCLOSED = 50  # percent of a phrase's occurrences inside a longer one that drop it
NO_LANGUAGE = "und"
#: Parts of a language's phrases that are ranked by themselves first.
PARTS = 16
#: Words of a chunk, about; entries that one merging task takes, about.
CHUNK, MERGED = 2_000_000, 2_000_000

_LOWER = bytes.maketrans(
    bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" "
)
_BREAK = 0  # a piece ends; also the number of words that are too rare


# -- chunks -------------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers words from 1 as they come; the empty one, between two blanks, is -1."""

    def __init__(self, words: list[tuple[str, bytes]], lang: str):
        super().__init__({b"": -1, b"\n": _BREAK})
        self.words, self.lang = words, lang

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = len(self.words)
        return len(self.words)


class _Chunk:
    def __init__(self):
        self.words: list[tuple[str, bytes]] = []
        self.numbers: dict[str, _Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.numbers:
            self.numbers[lang] = _Numbers(self.words, lang)
        number = self.numbers[lang]
        found = np.array([number[w] for w in text.split(b" ")], np.int32)
        found = found[found >= 0]
        self.parts += [found, np.zeros(1, np.int32)]
        self.size += len(found)

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """The words as numbers, then the dictionary."""
        tokens = np.concatenate(self.parts)
        counts = np.bincount(tokens, minlength=len(self.words) + 1)[1:]
        yield _chunk_batch([chunk], [None], [None], [None], [None], [tokens.tobytes()])
        for at in range(0, len(self.words), 50_000):
            words = self.words[at : at + 50_000]
            n = len(words)
            yield _chunk_batch(
                [chunk] * n,
                [lang for lang, _ in words],
                [word for _, word in words],
                range(at + 1, at + n + 1),
                counts[at : at + n],
                [None] * n,
            )


_CHUNKS = pa.schema(
    [
        ("chunk", pa.int64()),
        ("lang", pa.string()),
        ("word", pa.binary()),
        ("local", pa.int32()),
        ("count", pa.int64()),
        ("tokens", pa.binary()),
    ]
)


def _chunk_batch(*columns) -> pa.RecordBatch:
    arrays = [pa.array(c, field.type) for c, field in zip(columns, _CHUNKS)]
    return pa.RecordBatch.from_arrays(arrays, schema=_CHUNKS)


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A text in lower case, with line feeds as words where a piece ends; about ``size`` bytes at a
    time, never split inside a piece."""
    text = text.translate(_LOWER)
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(b"\n", b" \n ")
        at = end + 1


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows of two kinds: a chunk's ``tokens``, and per word of its dictionary lang, word, the number
    in the chunk and how often it occurs there."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, open_ = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                for part in pieces(text.as_py() or b"", 8 * size):
                    open_.add(NO_LANGUAGE if lang is None else lang, part)
                    if open_.size >= size:
                        yield from open_.rows(chunk)
                        chunk, open_ = chunk + 1, _Chunk()
        if open_.parts:
            yield from open_.rows(chunk)

    given = docs.select(F.col("lang").cast("string"), F.col("text").cast("binary"))
    return given.mapInArrow(
        read, "chunk long, lang string, word binary, local int, count long, tokens binary"
    )


# -- quotient filters ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Permutation:
    """An invertible mixing of n-grams of ``bits`` bits a word into (hi, lo): all of two words, and the
    third (0 without one)."""

    bits: int

    MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)  # odd

    def __post_init__(self):
        if self.bits > 32:
            raise ValueError("more than 2 ** 32 frequent words")

    @property
    def width(self) -> int:
        return 2 * self.bits

    def _mix(self, x: np.ndarray) -> np.ndarray:
        mask, half = np.uint64((1 << self.width) - 1), np.uint64(self.bits)
        for odd in self.MULTIPLIERS:
            x = (x * np.uint64(odd)) & mask
            x = x ^ (x >> half)
        return x

    def _unmix(self, x: np.ndarray) -> np.ndarray:
        mask, half = np.uint64((1 << self.width) - 1), np.uint64(self.bits)
        for odd in reversed(self.MULTIPLIERS):
            x = x ^ (x >> half)
            x = (x * np.uint64(pow(odd, -1, 1 << self.width))) & mask
        return x

    def forward(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.width) - 1)
        hi = self._mix((words[0].astype(np.uint64) << np.uint64(self.bits)) | words[1].astype(np.uint64))
        if len(words) == 2:
            return hi, np.zeros(len(hi), np.uint64)
        lo = words[2].astype(np.uint64) ^ (self._mix(hi) & np.uint64((1 << self.bits) - 1))
        return (hi + self._mix(lo)) & mask, lo  # the third word moves the quotient too

    def inverse(self, hi: np.ndarray, lo: np.ndarray, words: int) -> list[np.ndarray]:
        mask, low = np.uint64((1 << self.width) - 1), np.uint64((1 << self.bits) - 1)
        third = []
        if words == 3:
            hi = (hi - self._mix(lo)) & mask
            third = [lo ^ (self._mix(hi) & low)]
        pair = self._unmix(hi)
        return [pair >> np.uint64(self.bits), pair & low, *third]


def _added(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray):
    """Sorted distinct entries with the sums of their counters. Sorted runs merge in linear time."""
    if not len(hi):
        return hi, lo, counts
    order = np.argsort(hi, kind="stable") if not lo.any() else np.lexsort((lo, hi))
    hi, lo, counts = hi[order], lo[order], counts[order]
    first = np.ones(len(hi), bool)
    first[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    at = np.flatnonzero(first)
    return hi[at], lo[at], np.add.reduceat(counts, at)


def _small(values: np.ndarray) -> bytes:
    """Counters as a byte each; those from 255 on follow whole."""
    large = values[values >= 255]
    return np.minimum(values, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes()


def _unsmall(raw: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    values[values == 255] = np.frombuffer(raw, "<i8", offset=n)
    return values


def _packed(values: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` of every number in whole bytes."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, : (bits + 7) // 8]).tobytes()


def _unpacked(raw: bytes, bits: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    width = (bits + 7) // 8
    if width:
        out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    return out.view("<u8").reshape(n)


@dataclass(frozen=True)
class Filter:
    """A counting quotient filter of one range of quotients: entries (hi, lo), sorted, below a
    common prefix of ``hi`` of ``prefix_bits`` bits."""

    prefix_bits: int
    hi: np.ndarray
    lo: np.ndarray
    counts: np.ndarray

    def dump(self, perm: Permutation, words: int) -> bytes:
        below = perm.width - self.prefix_bits
        n = len(self.hi)
        quotient_bits = min(below, max(0, n.bit_length() - 1))
        rest_bits = below - quotient_bits
        rest = self.hi & np.uint64((1 << rest_bits) - 1)
        quotient = (self.hi >> np.uint64(rest_bits)) & np.uint64((1 << quotient_bits) - 1)
        runs = np.bincount(quotient.astype(np.int64), minlength=1 << quotient_bits)
        parts = [
            _small(runs),
            _packed(rest, rest_bits),
            _packed(self.lo, perm.bits) if words == 3 else b"",
            _small(self.counts),
        ]
        head = np.array([n, quotient_bits, *map(len, parts)], "<i8").tobytes()
        return head + b"".join(parts)

    @classmethod
    def load(cls, raw: bytes, perm: Permutation, words: int, prefix: int, prefix_bits: int):
        head = np.frombuffer(raw, "<i8", 6)
        n, quotient_bits = int(head[0]), int(head[1])
        parts, at = [], 48
        for size in head[2:].tolist():
            parts.append(raw[at : at + size])
            at += size
        rest_bits = perm.width - prefix_bits - quotient_bits
        runs = _unsmall(parts[0], 1 << quotient_bits)
        quotient = np.repeat(np.arange(len(runs), dtype=np.uint64), runs)
        quotient |= np.uint64(prefix << quotient_bits)
        hi = (quotient << np.uint64(rest_bits)) | _unpacked(parts[1], rest_bits, n)
        lo = _unpacked(parts[2], perm.bits, n) if words == 3 else np.zeros(n, np.uint64)
        return cls(prefix_bits, hi, lo, _unsmall(parts[3], n))


def filters_of(tokens: np.ndarray, perm: Permutation, words: int, prefix_bits: int):
    """(prefix, filter) of the n-grams of a chunk; none spans a break."""
    columns = [tokens[i : len(tokens) - words + 1 + i] for i in range(words)]
    whole = np.all([c != _BREAK for c in columns], axis=0)
    hi, lo = perm.forward([c[whole] for c in columns])
    hi, lo, counts = _added(hi, lo, np.ones(len(hi), np.int64))
    prefixes = hi >> np.uint64(perm.width - prefix_bits)
    starts = np.flatnonzero(np.r_[True, prefixes[1:] != prefixes[:-1]]) if len(hi) else []
    for start, end in zip(starts, [*starts[1:], len(hi)]):
        cut = slice(start, end)
        yield int(prefixes[start]), Filter(prefix_bits, hi[cut], lo[cut], counts[cut])


# -- counting -----------------------------------------------------------------------------------


def vocabulary(stored: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, word, f, id) of all words with ``least`` occurrences, ids from 1, and (lang, n)."""
    words = stored.where("word is not null").groupBy("lang", "word").agg(F.sum("count").alias("f"))
    words = pin(words, "collocation-words")
    frequent = pin(words.where(F.col("f") >= least), "collocation-frequent")
    spread = F.struct("lang", "word")
    ids = numbered(
        frequent, [], spread, [F.col("lang"), F.col("word")], buckets_for(frequent.count()), "id"
    )
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return (
        pin(ids.withColumn("id", F.col("id") + 1), "collocation-ids"),
        pin(sizes, "collocation-sizes"),
    )


def phrase_counts(
    stored: DataFrame, ids: DataFrame, least: int = LEAST, merged: int = MERGED
) -> DataFrame:
    """(w1, w2, w3, a): word numbers of all phrases of two (w3 is 0) and three words that occur
    ``least`` times or more."""
    n_words, tokens = ids.agg(F.max("id")).first()[0], stored.agg(F.sum("count")).first()[0]
    perm = Permutation((n_words or 1).bit_length())
    prefix_bits = min(perm.width, max(4, (int(tokens or 0) // merged).bit_length()))

    told = stored.where("word is not null").select("chunk", "lang", "word", "local")
    told = told.join(ids.select("lang", "word", "id"), ["lang", "word"])
    texts = stored.where("tokens is not null").select("chunk", "tokens")

    def count(chunk: pa.Table, names: pa.Table) -> pa.Table:
        rows = {"words": [], "prefix": [], "filter": []}
        for raw in chunk["tokens"]:
            local = np.frombuffer(raw.as_py(), np.int32)
            number = np.zeros(int(local.max(initial=0)) + 1, np.int64)
            number[names["local"].to_numpy()] = names["id"].to_numpy()
            for words in (2, 3):
                for prefix, found in filters_of(number[local], perm, words, prefix_bits):
                    rows["words"].append(words)
                    rows["prefix"].append(prefix)
                    rows["filter"].append(found.dump(perm, words))
        return pa.table(
            {
                "words": pa.array(rows["words"], pa.int32()),
                "prefix": pa.array(rows["prefix"], pa.int64()),
                "filter": pa.array(rows["filter"], pa.binary()),
            }
        )

    filters = (
        texts.groupBy("chunk")
        .cogroup(told.select(F.col("chunk").alias("of"), "local", "id").groupBy("of"))
        .applyInArrow(count, "words int, prefix long, filter binary")
    )

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        words, prefix = key[0].as_py(), key[1].as_py()
        found = [
            Filter.load(raw.as_py(), perm, words, prefix, prefix_bits) for raw in group["filter"]
        ]
        hi, lo, counts = _added(
            *(np.concatenate([getattr(f, part) for f in found]) for part in ("hi", "lo", "counts"))
        )
        often = counts >= least
        numbers = perm.inverse(hi[often], lo[often], words)
        numbers += [np.zeros(int(often.sum()), np.uint64)] * (3 - words)
        names = {f"w{i + 1}": pa.array(w.astype(np.int64)) for i, w in enumerate(numbers)}
        return pa.table({**names, "a": pa.array(counts[often])})

    return filters.groupBy("words", "prefix").applyInArrow(
        merge, "w1 long, w2 long, w3 long, a long"
    )


# -- phrases ------------------------------------------------------------------------------------


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)) in integers of up to 38 digits."""
    a, left, right = (f"cast({x} as decimal(18,0))" for x in (a, left, right))
    return F.expr(f"(cast({SCALE} as decimal(7,0)) * ({a} * {a})) div ({left} * {right})")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, enclosed: int = ENCLOSED, size: int = CHUNK
) -> DataFrame:
    """The ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Everything is counted per lang over whole texts; a null lang counts as ``und``. Texts that are
    null, empty or without words add nothing, a table without frequent phrases gives no rows.
    Repeated rows count each time. Ties go to the greater a, then to the phrase that sorts first by
    its UTF-8 bytes. doc_id and further columns are not read.
    """
    stored = pin(chunks(docs, size), "collocation-chunks")
    ids, sizes = vocabulary(stored, least)
    found = pin(phrase_counts(stored, ids, least), "collocation-phrases")
    return ranked(found, ids, sizes, top, enclosed)


def ranked(
    found: DataFrame, ids: DataFrame, sizes: DataFrame, top: int = TOP, enclosed: int = ENCLOSED
) -> DataFrame:
    pairs, triples = found.where("w3 = 0"), found.where("w3 > 0")

    def named(df: DataFrame, column: str) -> DataFrame:
        word = ids.select(
            F.col("id").alias(column),
            F.col("word").alias(f"{column}_word"),
            F.col("f").alias(f"{column}_f"),
            F.col("lang").alias(f"{column}_lang"),
        )
        return df.join(word, column)

    # a pair goes where a longer candidate holds most of its occurrences
    around = triples.select("w1", "w2", "a").union(triples.select("w2", "w3", "a"))
    around = around.toDF("w1", "w2", "around").groupBy("w1", "w2").agg(F.max("around").alias("around"))
    alone = pairs.join(around, ["w1", "w2"], "left").where(
        F.col("around").isNull() | (100 * F.col("around") < F.lit(enclosed) * F.col("a"))
    )
    two = named(named(alone.select("w1", "w2", "a"), "w1"), "w2").select(
        F.col("w1_lang").alias("lang"),
        F.concat_ws(" ", *(F.col(f"w{i}_word").cast("string") for i in (1, 2))).alias("phrase"),
        "a",
        F.col("w1_f").alias("l"),
        F.col("w2_f").alias("r"),
        _score("a", "w1_f", "w2_f").alias("score"),
    )

    parts = pairs.select("w1", "w2", F.col("a").alias("f"))
    three = triples.join(parts.toDF("w1", "w2", "head"), ["w1", "w2"]).join(
        parts.toDF("w2", "w3", "tail"), ["w2", "w3"]
    )
    for column in ("w1", "w2", "w3"):
        three = named(three, column)
    scores = {"first": _score("a", "w1_f", "tail"), "second": _score("a", "head", "w3_f")}
    cut_first = F.col("first") <= F.col("second")
    three = three.withColumns(scores).select(
        F.col("w1_lang").alias("lang"),
        F.concat_ws(" ", *(F.col(f"w{i}_word").cast("string") for i in (1, 2, 3))).alias("phrase"),
        "a",
        F.when(cut_first, F.col("w1_f")).otherwise(F.col("head")).alias("l"),
        F.when(cut_first, F.col("tail")).otherwise(F.col("w3_f")).alias("r"),
        F.least("first", "second").alias("score"),
    )
    best = two.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # a language's phrases are cut to its best in parts first, so its last task sorts few
    for group in (["lang", "part"], ["lang"]):
        best_first = Window.partitionBy(*group).orderBy(
            F.desc("score"), F.desc("a"), F.asc("phrase")
        )
        best = best.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")),
    )


def oracle_sql() -> str:
    """The query in SQL over lists of words."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH pieces AS (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang,
  unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM
  (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, range(1, 4) AS s(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS g
  FROM f WHERE k > 1 AND f >= {LEAST}),
split AS (SELECT *, array_to_string(g[1 : cut], ' ') AS head,
  array_to_string(g[cut + 1 : k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)),
cuts AS (SELECT c.lang, c.phrase, c.k, c.a, cut, x.f AS l, y.f AS r,
  CAST({SCALE} AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM split c JOIN f x ON x.lang = c.lang AND x.phrase = c.head
  JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
enclosed AS (SELECT lang, array_to_string(g[i : i + 1], ' ') AS phrase, max(a) AS around FROM
  (SELECT lang, g, a, unnest([1, 2]) AS i FROM cand WHERE k = 3) GROUP BY ALL),
placed AS (SELECT l.* FROM lowest l LEFT JOIN enclosed e ON e.lang = l.lang AND e.phrase = l.phrase
  WHERE e.around IS NULL OR 100 * e.around < {ENCLOSED} * l.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM placed JOIN sizes USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
