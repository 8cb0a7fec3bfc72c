"""Subword lattice likelihood: an existing vocabulary's pieces, all segmentations summed up.

A word's probability interpolates its discounted share of the training tokens with the lattice
over the vocabulary's pieces: the whole word is one more arc beside the paths of pieces. The
lattice is what words not seen, or seen seldom, get their probability from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import arrow_rows, id_crc
from stratafold.llm.lattice import Lattice
from stratafold.session import pin

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Commonest words that every task holds, at most; the others are joined.
HEAD_WORDS = 100_000
#: Words that a task counts before it hands them on.
COUNTED_TOGETHER = 400_000
#: Weight of the vocabulary's own scores, in pieces per piece of the vocabulary.
PRIOR = 0.05
#: Flattens the Zipf law by which an order of scores becomes probabilities.
ZIPF_SHIFT = 10.0
LN10 = math.log(10.0)


def held_out(column: str = "doc_id") -> Column:
    return id_crc(column) % 7 == 2


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A to Z in lower case: ``bytes`` leaves all other letters alone."""
    return (text or "").encode().lower().split()


def _counted(df: DataFrame) -> DataFrame:
    """(word, trained, n): occurrences, summed up per task before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def flushed():
            for trained, counter in enumerate(sums):
                words = list(counter)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(words, pa.binary()),
                        pa.array([bool(trained)] * len(words), pa.bool_()),
                        pa.array(list(counter.values()), pa.int64()),
                    ],
                    names=["word", "trained", "n"],
                )
                counter.clear()

        for batch in batches:
            for text, held in zip(batch["text"], batch["held_out"].to_pylist()):
                sums[not held].update(tokens(text.as_py()))
                if len(sums[0]) + len(sums[1]) > COUNTED_TOGETHER:
                    yield from flushed()
        yield from flushed()

    return df.mapInArrow(run, "word binary, trained boolean, n long")


@dataclass(frozen=True)
class Model:
    """Piece log probabilities (natural), and what words are discounted by."""

    pieces: Lattice
    end_piece: float
    train_tokens: int
    distinct: int
    ends: int
    discount: float

    def mixed(self, count: int, lattice: float) -> float:
        """log10 of a token's probability from its training count and its lattice's log."""
        if not self.train_tokens:
            return lattice / LN10
        seen = max(count - self.discount, 0.0) / self.train_tokens
        rest = self.discount * self.distinct / self.train_tokens
        if not seen:
            return (math.log(rest) + lattice) / LN10
        return math.log10(seen + rest * math.exp(lattice))

    def end(self) -> float:
        return self.mixed(self.ends, self.end_piece)

    def base(self, count: int) -> float:
        return math.log10((count + 1) / (self.train_tokens + self.distinct + 1))


def _vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _piece_counts(words: DataFrame, path: str) -> dict[int, int]:
    """How many distinct training words hold each piece, by the vocabulary's own segmentation."""

    def make():
        model = _vocabulary(path)

        def work(batch):
            found = Counter()
            for ids in model.encode([w.decode() for w in batch["word"].to_pylist()], num_threads=1):
                found.update(ids)
            yield {"piece": list(found), "n": list(found.values())}

        return work

    counted = arrow_rows(words.select("word"), make, "piece int, n long")
    return {r[0]: r[1] for r in counted.groupBy("piece").agg(F.sum("n")).collect()}


def fit(words: DataFrame, train_docs: int, vocabulary: str = VOCABULARY) -> Model:
    """Piece weights from the stored ``words`` (word, c): bounded by the size of the vocabulary.

    A piece weighs as many distinct training words as hold it, plus a prior from the order of
    the vocabulary's own scores. Without training words only the prior counts.
    """
    known = words.where("c > 0")
    stats = known.agg(
        F.count(F.lit(1)),
        F.sum("c"),
        F.sum((F.col("c") == 1).cast("long")),
        F.sum((F.col("c") == 2).cast("long")),
    ).first()
    distinct, occurrences, once, twice = (x or 0 for x in stats)
    model = _vocabulary(vocabulary)
    size = model.get_piece_size()
    found = _piece_counts(known, vocabulary)
    order = sorted(range(size), key=lambda i: (-model.get_score(i), i))
    zipf = {i: 1 / (rank + ZIPF_SHIFT) for rank, i in enumerate(order)}
    prior = PRIOR * size / sum(zipf.values())
    end = model.eos_id()
    found[end] = found.get(end, 0) + bool(train_docs)
    weight = {i: found.get(i, 0) + prior * zipf[i] for i in range(size)}
    total = sum(weight.values())
    logs = {model.id_to_piece(i): math.log(w / total) for i, w in weight.items()}
    special = {model.id_to_piece(i) for i in (model.unk_id(), model.bos_id(), end) if i >= 0}
    return Model(
        pieces=Lattice({p: x for p, x in logs.items() if p not in special}),
        end_piece=logs[model.id_to_piece(end)],
        train_tokens=occurrences + train_docs,
        distinct=distinct + bool(train_docs),
        ends=train_docs,
        discount=min(0.99, max(0.1, once / (once + 2 * twice) if once else 0.5)),
    )


def word_scores(words: DataFrame, model: Model) -> DataFrame:
    """(word, c, total, known, base, score) for the stored ``words``: one lattice a word."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def work(batch):
            found, counts = batch["word"].to_pylist(), batch["c"].to_pylist()
            paths = fitted.pieces.log_marginals([w.decode() for w in found]).tolist()
            yield {
                "word": found,
                "c": counts,
                "total": batch["total"].to_pylist(),
                "score": [fitted.mixed(c, x) for c, x in zip(counts, paths)],
                "base": [fitted.base(c) for c in counts],
            }

        return work

    return arrow_rows(words, make, "word binary, c long, total long, score double, base double")


def _common(scored: DataFrame, most: int) -> dict[bytes, tuple[float, float, bool]]:
    """Base, score and knownness of the commonest words, at most ``most`` of them.

    The least count that lets in no more is found on a histogram in steps of a sixteenth of a
    power of two, so no words are sorted.
    """
    step = F.floor(F.log2("total") * 16)
    histogram = scored.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, room = math.inf, most
    for r in sorted(histogram, reverse=True):
        if r.n > room:
            break
        least, room = r.step, room - r.n
    head = scored.where(step >= F.lit(least)).select("word", "base", "score", F.col("c") > 0)
    return {bytes(w): (b, s, known) for w, b, s, known in head.collect()}


def score(docs: DataFrame, vocabulary: str = VOCABULARY, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from rows whose CRC32 of doc_id modulo 7 is not 2. A text is its words and one end;
    ``score`` is the model's log10 probability of all of it, ``base_score`` the add-one unigram.

    A null or empty text is one end. A null doc_id counts as the empty text in the split;
    repeated rows are scored, and learned from, as often as they occur. A table without training
    rows is scored by the vocabulary's own scores alone. An empty table gives no rows. Words of
    any length go through the whole lattice. Other columns are ignored.
    """
    spark = docs.sparkSession
    given = docs.select("doc_id", "text", held_out().alias("held_out"))
    counted = _counted(given.select("text", "held_out")).groupBy("word")
    seen = F.sum(F.when(F.col("trained"), F.col("n")).otherwise(F.lit(0)))
    words = pin(counted.agg(seen.alias("c"), F.sum("n").alias("total")), "lm-words")
    model = fit(words, given.where("NOT held_out").count(), vocabulary)
    scored = pin(word_scores(words, model), "lm-scores")

    common = _common(scored, head_words)
    shared = spark.sparkContext.broadcast(common)
    end_base, end_score = model.base(model.ends), model.end()

    def make():
        common = shared.value

        def work(batch):
            out = {k: [] for k in ("n_tokens", "n_known", "base", "score", "words", "counts")}
            for text in batch["text"]:
                n, known, base, score, rare = 1, int(model_ends > 0), end_base, end_score, {}
                for word, k in Counter(tokens(text.as_py())).items():
                    n += k
                    if (x := common.get(word)) is None:
                        rare[word] = k
                    else:
                        base += k * x[0]
                        score += k * x[1]
                        known += k * x[2]
                row = (n, known, base, score, list(rare), list(rare.values()))
                for name, value in zip(out, row):
                    out[name].append(value)
            for name in ("row", "doc_id", "held_out"):
                out[name] = batch[name].to_pylist()
            yield out

        return work

    model_ends = model.ends
    del common
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = pin(
        arrow_rows(
            given.withColumn("row", F.monotonically_increasing_id()),
            make,
            f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, "
            "score double, words array<binary>, counts array<long>",
        ),
        "lm-rows",
    )
    rare = rows.select("row", F.explode(F.arrays_zip("words", "counts")).alias("r")).select(
        "row", F.col("r.words").alias("word"), F.col("r.counts").alias("n")
    )
    rest = (
        rare.join(scored.select("word", "c", "base", "score"), "word")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0))).alias("_known"),
            F.sum(F.col("n") * F.col("base")).alias("_base"),
            F.sum(F.col("n") * F.col("score")).alias("_score"),
        )
    )

    def plus(name: str, more: str) -> Column:
        return F.col(name) + F.coalesce(F.col(more), F.lit(0))

    return rows.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("n_known", "_known").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        plus("base", "_base").alias("base_score"),
        plus("score", "_score").alias("score"),
    )
