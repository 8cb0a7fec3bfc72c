"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import arrow_rows, id_crc

#: Half of the labelled rows that the vectors are learned from, at most.
LABELLED = 1500
#: Hashed terms, latent dimensions, neighbours that vote, documents compared at once.
TERMS, LATENT, NEIGHBOURS, BLOCK = 1024, 24, 15, 256
#: Cells of hashed words, and of runs of four bytes; length of their latent vector beside that of
#: the shapes; bytes that are counted at once.
CELLS, SEMANTIC, SLICE = 1024, 0.5, 1 << 20
#: Directions beside the axes, and powers, of the range finder.
SPARE, POWERS = 16, 10
REJECT_BELOW = 0.3
_SHAPES = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b
    for b in range(256)
)


def held_out(column: str = "doc_id") -> Column:
    return id_crc(column) % 5 == 0


def _collapsed(shape: bytes, cache: dict[bytes, bytes]) -> bytes:
    """Runs of one character as one: letters, digits and marks count by kind, not by number."""
    if shape not in cache:
        if len(cache) > 50_000:
            cache.clear()
        cache[shape] = bytes(b for i, b in enumerate(shape) if not i or shape[i - 1] != b)[:12]
    return cache[shape]


def _level(share: float) -> int:
    return min(9, int(share * 10))


def terms(text: str | None, cache: dict[bytes, bytes]) -> dict[str, float]:
    """Terms of a whole text: shapes of its words, and how it repeats words and lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    shapes = raw.translate(_SHAPES).split()
    n = len(shapes)
    if not n:
        return {}
    found: dict[str, float] = {}
    for shape, k in Counter(shapes).items():
        name = "s" + _collapsed(shape, cache).decode("ascii", "replace")
        found[name] = found.get(name, 0.0) + k
    found = {name: math.sqrt(k / n) for name, k in found.items()}
    words = Counter(raw.lower().split())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    top = words.most_common(1)[0][1]
    size = int(math.log2(n + 1))
    found[f"top{_level(top / n)}:{min(size, 4)}"] = 1.0
    found[f"distinct{_level(len(words) / n)}:{min(size, 6)}"] = 0.5
    found[f"lines{_level(len(set(lines)) / max(1, len(lines)))}"] = 0.3
    found[f"size{min(size, 6)}"] = 0.2
    return found


def cells(text: str | None) -> np.ndarray:
    """What a whole text says: its words, and its runs of four bytes in any language, hashed."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    out = np.zeros(2 * CELLS)
    found = Counter(raw.split())
    if not found:
        return out
    at = np.array([xxhash.xxh32_intdigest(w) % CELLS for w in found])
    n = sum(found.values())
    out[:CELLS] = np.bincount(at, np.sqrt(np.array([*found.values()]) / n), CELLS)
    counts = np.zeros(CELLS)
    for start in range(0, len(raw) - 3, SLICE):
        b = np.frombuffer(raw[start : start + SLICE + 3], np.uint8).astype(np.uint32)
        runs = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
        counts += np.bincount(runs * np.uint32(0x9E3779B1) >> np.uint32(22), minlength=CELLS)
    out[CELLS:] = np.sqrt(counts / max(1.0, counts.sum()))
    return out


def vectors(texts: Iterable[str | None], cache: dict[bytes, bytes]) -> np.ndarray:
    """Shapes (TERMS), then words and runs of bytes (2 * CELLS), one row a text."""
    rows = []
    for text in texts:
        row = np.zeros(TERMS)
        for name, weight in terms(text, cache).items():
            row[xxhash.xxh32_intdigest(name) % TERMS] += weight
        rows.append(np.concatenate([row, cells(text)]))
    return np.array(rows).reshape(-1, TERMS + 2 * CELLS).astype(np.float32)


def _unit(z: np.ndarray) -> np.ndarray:
    length = np.sqrt((z * z).sum(1, keepdims=True))
    return np.divide(z, length, out=np.zeros_like(z), where=length > 1e-12)


def _basis(x: np.ndarray) -> np.ndarray:
    """Term weights times the strongest axes of the weighted rows.

    A randomised range finder: a few more directions than axes are powered up, a block of rows at a
    time, so that neither a square matrix of all cells nor a second copy of the rows is held.
    """
    spread = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    axes = min(LATENT, *x.shape)
    found = np.random.default_rng(0).standard_normal((x.shape[1], min(axes + SPARE, *x.shape)))
    for _ in range(POWERS):
        found, _ = np.linalg.qr(sum((b.T @ (b @ found) for b in _weighted(x, spread)), 0.0))
    inner = sum(((b @ found).T @ (b @ found) for b in _weighted(x, spread)), 0.0)
    _, turn = np.linalg.eigh(inner)  # ascending
    return spread[:, None] * (found @ turn[:, ::-1][:, :axes])


def _weighted(x: np.ndarray, spread: np.ndarray) -> Iterable[np.ndarray]:
    return (x[at : at + BLOCK] * spread for at in range(0, len(x), BLOCK))


@dataclass(frozen=True)
class Voters:
    """Latent bases with term weights, of shapes and of what texts say, and the labelled vectors in
    them. Bounded by LABELLED."""

    basis: np.ndarray
    semantic: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(float)
        shapes, says = rows[:, :TERMS] @ self.basis, rows[:, TERMS:] @ self.semantic
        return _unit(np.concatenate([_unit(shapes), SEMANTIC * _unit(says)], 1))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Label share among the nearest, by cosine; ties in cosine go to the earlier vector."""
        out = np.full(len(rows), self.prior)
        if not len(self.labels):
            return out
        for at in range(0, len(rows), BLOCK):
            cosine = self.latent(rows[at : at + BLOCK]) @ self.vectors.T
            k = min(NEIGHBOURS, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0.0)
            total = weight.sum(1)
            share = (weight * self.labels[near]).sum(1)
            block = out[at : at + BLOCK]
            np.divide(share, total, out=block, where=total > 0)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Voters:
    """Voters from at most twice ``labelled`` rows, those with the smallest id digests of both
    classes together, so that the classes keep their shares whatever the size of the table.

    Rows whose CRC32 of doc_id modulo 5 is 0 are never learned from. Null labels and labels
    other than 0 and 1 are left out; of several labels of one id the smallest counts.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * labelled)
    sample = F.broadcast(sample)  # 2 * labelled rows

    def make():
        cache: dict[bytes, bytes] = {}

        def work(batch):
            found = vectors((t.as_py() for t in batch["text"]), cache)
            yield {
                "doc_id": batch["doc_id"].to_pylist(),
                "quality": batch["quality"].to_pylist(),
                "vector": [row.tobytes() for row in found],
            }

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = arrow_rows(
        docs.select("doc_id", "text").join(sample, "doc_id"),
        make,
        f"doc_id {kind}, quality int, vector binary",
    ).collect()
    rows.sort(key=lambda r: (r.doc_id, r.vector))
    rows = [r for i, r in enumerate(rows) if not i or rows[i - 1] != r]
    y = np.array([r.quality for r in rows], float)
    x = np.empty((len(rows), TERMS + 2 * CELLS), np.float32)
    while rows:  # each row's bytes go once they are part of the matrix
        last = rows.pop()
        x[len(rows)] = np.frombuffer(last.vector, np.float32)
    if not len(x):
        empty = np.zeros((TERMS, 1)), np.zeros((2 * CELLS, 1))
        return Voters(*empty, np.zeros((0, 2)), y, 0.5)
    bases = _basis(x[:, :TERMS]), _basis(x[:, TERMS:])
    voters = Voters(*bases, np.zeros((0, 0)), y, float(y.mean()))
    latent = [voters.latent(x[at : at + BLOCK]) for at in range(0, len(x), BLOCK)]
    return Voters(*bases, np.concatenate(latent), y, voters.prior)


def score(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 is likelier) and ``predicted`` (0 or 1).

    Every whole text is compared with every labelled vector. Texts without words, null ones
    included, get the share of label 1 among the learned rows, 0.5 if there are none. A null
    doc_id is scored like any other. Scores never read labels, ids, lang or source. An empty
    table gives no rows. Columns named ``score`` and ``predicted``, in any case, are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, labels, labelled))
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    given = docs.select(*kept)

    def make():
        voters, cache = shared.value, {}

        def work(batch):
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)  # whole texts go back a block at a time
                scores = voters.scores(vectors((t.as_py() for t in part["text"]), cache)).tolist()
                yield {
                    **{c: part[c] for c in kept},
                    "score": scores,
                    "predicted": [int(s >= REJECT_BELOW) for s in scores],
                }

        return work

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return arrow_rows(given, make, f"{fields}, score double, predicted int")
