"""Near duplicates among embeddings: cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import arrow_rows, components
from stratafold.session import pin

THRESHOLD = 0.95
SEED = 5
#: Sign bits that a pair may differ in: six standard deviations above the mean at 0.95.
BITS = 64
MOST_BITS = 22
#: Vectors that one bucket holds by chance, about.
BUCKET = 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        y = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x / math.sqrt(d)


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """Pseudo-random rotation: three rounds of random signs and a Hadamard transform."""
    signs = np.random.default_rng([SEED, x.shape[1], number]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def padded(x: np.ndarray) -> np.ndarray:
    d = max(2, 1 << max(0, x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, d - x.shape[1])))


def two_nearest(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and second nearest of the 2d signed axes, as numbers below 2d."""
    size = np.abs(y)
    top = np.argpartition(-size, 1, axis=1)[:, :2]
    picked = np.take_along_axis(size, top, 1)
    swap = picked[:, 0] < picked[:, 1]
    top[swap] = top[swap][:, ::-1]
    signs = np.take_along_axis(y, top, 1) < 0
    code = 2 * top + signs
    return code[:, 0], code[:, 1]


def shape_for(rows: int, dim: int) -> tuple[int, int]:
    """(tables, hashes a table): buckets grow with the rows, and tables make up for it."""
    codes = 2 * max(2, 1 << max(0, dim - 1).bit_length())
    hashes = max(2, math.ceil(math.log(max(rows, 2) / BUCKET) / math.log(codes)))
    return 8 * 2 ** (hashes - 2), hashes


def hashed(x: np.ndarray, tables: int, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits, own buckets and probed buckets of unit vectors.

    A probe replaces the nearest axis by the second nearest, in one hash or in two.
    """
    x = padded(x)
    own, probes = [], []
    base = 2 * x.shape[1]
    for t in range(tables):
        pairs = [two_nearest(rotated(x, t * hashes + h)) for h in range(hashes)]
        codes = [p[0].astype(np.int64) for p in pairs]
        other = [p[1].astype(np.int64) for p in pairs]

        def bucket(swapped: tuple[int, ...]) -> np.ndarray:
            key = np.full(len(x), t, np.int64)
            for h in range(hashes):
                key = key * base + (other[h] if h in swapped else codes[h])
            return key

        own.append(bucket(()))
        singles = [(h,) for h in range(hashes)]
        doubles = [(g, h) for g in range(hashes) for h in range(g)]
        probes += [bucket(s) for s in [*singles, *doubles]]
    wide = [rotated(x, 1_000_000 + i) for i in range(-(-BITS // x.shape[1]))]
    bits = np.hstack(wide)[:, :BITS] > 0
    signs = np.packbits(bits, axis=1).view(">i8").ravel().astype(np.int64)
    return signs, np.stack(own, 1), np.stack(probes, 1)


def _matrix(column, dim: int) -> np.ndarray:
    """A column of lists of ``dim`` numbers as rows, without a Python object per number."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _keys(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, embedding and a digest of its components; null if it links with nothing."""

    def make():
        def work(batch):
            keys, dims = [], []
            for value in batch["embedding"].to_pylist():
                ok = bool(value) and None not in value
                x = np.array(value if ok else [], np.float64)
                norm = float(np.sqrt((x * x).sum()))
                ok = ok and math.isfinite(norm) and norm > 0
                keys.append(xxhash.xxh3_128_digest((x + 0.0).tobytes()) if ok else None)
                dims.append(len(x) if ok else None)
            yield {
                "vec_id": batch["vec_id"].to_pylist(),
                "embedding": batch["embedding"].to_pylist(),
                "node": keys,
                "dim": dims,
            }

        return work

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, node binary, dim int"
    return arrow_rows(vectors.select("vec_id", "embedding"), make, schema)


def _buckets(classes: DataFrame, tables: int, hashes: int) -> DataFrame:
    def make():
        def work(batch):
            dims = np.array(batch["dim"].to_pylist())
            for dim in np.unique(dims):
                part = batch.take(np.flatnonzero(dims == dim))
                x = _matrix(part["embedding"], dim)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                signs, own, probes = hashed(x, tables, hashes)
                yield {
                    "node": part["node"].to_pylist(),
                    "dim": part["dim"].to_pylist(),
                    "signs": signs,
                    "own": list(own),
                    "probes": list(probes),
                }

        return work

    schema = "node binary, dim int, signs long, own array<long>, probes array<long>"
    return arrow_rows(classes.select("node", "dim", "embedding"), make, schema)


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    def make():
        def work(batch):
            if not batch.num_rows:
                return
            dims = pc.list_value_length(batch["x"]).to_numpy(zero_copy_only=False)
            keep = np.zeros(len(dims), bool)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                x, y = _matrix(part["x"], dim), _matrix(part["y"], dim)
                cosine = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                keep[at] = cosine >= threshold
            kept = batch.filter(pa.array(keep))
            yield {"a": kept["a"].to_pylist(), "b": kept["b"].to_pylist()}

        return work

    return arrow_rows(pairs, make, "a binary, b binary")


def links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) with a < b: pairs of the stored distinct vectors with cosine at the threshold.

    A vector is posted under its own bucket in every table and looked up under that and the
    probed ones. Of the pairs that meet, those whose sign bits rule the threshold out go at
    once, the rest are verified in double precision.
    """
    rows, dim = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    tables, hashes = shape_for(rows, dim or 2)
    buckets = pin(_buckets(classes, tables, hashes), "vec-buckets")
    posted = buckets.select("node", "dim", "signs", F.explode("own").alias("bucket"))
    asked = buckets.select(
        "node", "dim", "signs", F.explode(F.concat("own", "probes")).alias("bucket")
    )
    p, q = posted.alias("p"), asked.alias("q")
    apart = F.bit_count(F.col("p.signs").bitwiseXOR(F.col("q.signs")))
    met = p.join(
        q,
        (F.col("p.bucket") == F.col("q.bucket"))
        & (F.col("p.dim") == F.col("q.dim"))
        & (F.col("p.node") != F.col("q.node"))
        & (apart <= MOST_BITS),
    )
    ends = [f("p.node", "q.node") for f in (F.least, F.greatest)]
    pairs = met.select(ends[0].alias("a"), ends[1].alias("b")).distinct()
    vectors = classes.select("node", "embedding")
    x = vectors.select(F.col("node").alias("a"), F.col("embedding").alias("x"))
    y = vectors.select(F.col("node").alias("b"), F.col("embedding").alias("y"))
    return _verified(pairs.join(x, "a").join(y, "b"), threshold)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Links are pairs with a cosine of at least ``threshold`` in double precision. Equal vectors
    are one node: they link with each other without being paired up. ``n_links`` counts rows.

    Null, empty and zero vectors, and those with null or non-finite components, link with
    nothing, as do vectors of different lengths; their component is their own vec_id. Rows that
    repeat a vec_id count as vectors of their own under that id. A null vec_id takes part; it is
    never the smallest id unless all in the component are null. An empty table gives no rows.
    """
    rows = pin(_keys(vectors), "vec-keys")
    classes = pin(
        rows.where("node IS NOT NULL")
        .groupBy("node", "dim")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("vec_id").alias("least"),
            F.first("embedding").alias("embedding"),
        ),
        "vec-classes",
    )
    found = pin(links(classes, threshold), "vec-links")
    both = found.union(found.select("b", "a"))
    copies = classes.select(F.col("node").alias("b"), "copies")
    degrees = both.join(copies, "b").groupBy(F.col("a").alias("node")).agg(
        F.sum("copies").alias("others")
    )
    roots = components(found, "vec-components")
    labelled = classes.drop("embedding", "dim").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = labelled.join(smallest, "root").join(degrees, "node", "left")
    nodes = nodes.select(
        "node",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        "component_id",
    )
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "node").join(nodes, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
