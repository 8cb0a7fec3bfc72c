"""Samples that follow a growing source without reading it again.

A stratified sample keeps, per stratum, the rows with the smallest digests, which is a bottom-n
sketch: the bottom n of old and new rows together are found among the old bottom n and the new rows.
Two things make that hold for samples whose n grows with the stratum:

* a **reserve**: a sketch keeps some more rows than the sample needs, as many as the cut-off may
  move by chance (six standard deviations). A growing stratum needs a smaller share of its rows,
  so its cut-off falls and the reserve fills itself up again;
* a **bound** per stratum, the digest up to which the sketch is complete. A merge checks that no
  new cut-off and no tail rate lies beyond its bound; if one does, the sample is built anew. The
  merged sample is therefore always the one that a full build would give.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.functions.rowhash import EVERYTHING, row_digest, second_draw
from stratafold.functions.sizing import SizeRule
from stratafold.operators.joins import fits_broadcast, null_safe_join
from stratafold.operators.sampling import (
    TIE_SPLITS,
    check_sizes,
    likely_rows,
    stratum_cutoffs,
    stratum_quotas,
)
from stratafold.session import compact, pin

KEPT = "_kept"
#: Where a sketch is complete: the last digest, how many rows with it are held, the tail's rate.
LIMITS = ("_bound", "_bound_rows", "_tail_below")
_HELPERS = ("_stratum", "_cutoff", "_fitting", "_copies", "_bound_copies", *LIMITS)

Save = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Shape:
    """What a sample is drawn by; ``columns`` are those of the fact."""

    qcs: Sequence[str]
    key: Sequence[str]
    rule: SizeRule
    columns: Sequence[str]
    order: Sequence[str] = ()
    seed: int | str = 0
    tail: bool = True
    stored: list[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "stored", list(dict.fromkeys([*self.columns, *self.qcs])))

    def cutoffs(self, rows: DataFrame, sizes: DataFrame, save: Save) -> DataFrame:
        quotas = stratum_quotas(sizes.select(*self.qcs, "groupsize"), self.rule, reserve=True)
        return stratum_cutoffs(rows, pin(quotas, "quotas"), self.qcs, self.key, self.seed, save)[0]


@dataclass(frozen=True)
class Sketch:
    """``rows`` hold ``shape.stored`` and KEPT, true for the sample and false for the reserve;
    ``bounds`` has a row per stratum with the qcs and LIMITS."""

    rows: DataFrame
    bounds: DataFrame

    @property
    def sample(self) -> DataFrame:
        return self.rows.where(KEPT).drop(KEPT)


def _sorted_out(
    shape: Shape, source: DataFrame, limits: DataFrame, others_whole: bool = False
) -> DataFrame:
    """The rows up to their stratum's bound, or in the tail, with KEPT.

    A row whose stratum has no limit is an error, or belongs to a stratum that is kept whole.
    """
    rows = source.withColumn("_digest", row_digest(shape.key, shape.seed))
    by = limits.select(*shape.qcs, *_HELPERS)
    if not others_whole:
        rows = likely_rows(rows, by, shape.qcs, "_bound", "_tail_below" if shape.tail else None)
    rows = null_safe_join(rows, by, shape.qcs, how="left")
    digest, cutoff, bound = F.col("_digest"), F.col("_cutoff"), F.col("_bound")
    in_tail = second_draw(digest) < F.col("_tail_below") if shape.tail else F.lit(False)
    unsized = F.raise_error(F.lit("a row's stratum has no size; profile the source again"))
    other = F.lit(True) if others_whole else unsized.cast("boolean")
    inside = F.when(F.col("_stratum").isNull(), other).otherwise(digest <= bound)
    kept = (digest <= cutoff) | in_tail
    if others_whole:
        kept = F.col("_stratum").isNull() | kept
    at_cutoff = F.col("_fitting") < F.col("_copies")
    at_bound = F.col("_bound_rows") < F.col("_bound_copies")
    # copies of one row of which a part is kept or held; below the bound all are held
    held = F.greatest(
        F.when(at_bound, F.col("_bound_rows")), F.when(at_cutoff & (cutoff < bound), F.col("_copies"))
    )
    split = limits.agg(F.max(held)).first()[0]
    if split is None:
        return rows.where(inside | in_tail).select(*shape.stored, kept.alias(KEPT))
    partly = ~in_tail & (
        ((digest == cutoff) & F.coalesce(at_cutoff, F.lit(False)))
        | ((digest == bound) & F.coalesce(at_bound, F.lit(False)))
    )
    whole = rows.where((inside | in_tail) & ~partly).select(*shape.stored, kept.alias(KEPT))
    room = F.when((digest == bound) & at_bound, F.col("_bound_rows")).otherwise(F.col("_copies"))
    ranking = [F.col(c) for c in shape.order] or [F.lit(0)]
    # the constant bound lets every task cut its copies before the shuffle, the
    # split by task number keeps a hot stratum out of a single reducer
    piece = F.pmod(F.spark_partition_id(), F.lit(TIE_SPLITS))
    copies = rows.where(partly).withColumn("_piece", piece)
    for group in (["_stratum", "_digest", "_piece"], ["_stratum", "_digest"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*ranking))
        copies = copies.withColumn("_place", place).where(F.col("_place") <= F.lit(split))
        copies = copies.where(F.col("_place") <= room)
    fits = (digest == cutoff) & (F.col("_place") <= F.col("_fitting"))
    return whole.unionByName(copies.select(*shape.stored, fits.alias(KEPT)))


def build_sketch(
    shape: Shape, source: DataFrame, sizes: DataFrame, share: float = 1.0, save: Save = pin
) -> Sketch:
    """Sample and reserve of a whole source; ``share`` is about what they keep of it.

    ``save`` writes a table under a label and reads it back: "cutoffs" and "rows" are the parts of
    the result.
    """
    source = source.select(*shape.stored)
    limits = shape.cutoffs(source, sizes, save)
    cut = _cut_strata(shape, source, limits)
    found = _sorted_out(shape, source, limits if cut is None else cut, cut is not None)
    rows = save(compact(found, share), "rows")
    return Sketch(rows, limits.select(*shape.qcs, *LIMITS))


def _cut_strata(shape: Shape, source: DataFrame, limits: DataFrame) -> DataFrame | None:
    """The limits of strata that are not kept whole, if these alone can be broadcast.

    Where most strata have fewer rows than are to be kept, there are nearly as many limits as rows
    and a join with all of them would shuffle the source. Rows of strata kept whole need no limit;
    that every row's stratum has a size is checked by counts instead.
    """
    if fits_broadcast(limits):
        return None
    cut = pin(limits.where(F.col("_cutoff") != F.lit(EVERYTHING)), "cut")
    if not fits_broadcast(cut):
        return None
    check_sizes(source, limits, shape.qcs)
    return cut


def merge_sketch(
    shape: Shape,
    sketch: Sketch,
    new: DataFrame,
    sizes: DataFrame,
    share: float = 1.0,
    save: Save = pin,
) -> Sketch | None:
    """The sketch of the source with rows added to it, from the rows added; ``sizes`` are those of
    the grown source. None if the reserve does not reach, which only a full build mends."""
    was = sketch.bounds.withColumnsRenamed({c: f"_old{c}" for c in LIMITS})
    added = null_safe_join(new.select(*shape.stored), was, shape.qcs, how="left")
    added = added.where(_likely(shape)).select(*shape.stored)
    rows = sketch.rows.select(*shape.stored).unionByName(added)
    rows = pin(compact(rows, share), "candidates")

    found = null_safe_join(shape.cutoffs(rows, sizes, pin), was, shape.qcs, how="left")
    limits = save(found.select(*shape.qcs, *_narrowed(), _beyond().alias("_beyond")), "cutoffs")
    if not limits.where("_beyond").isEmpty():
        return None
    rows = save(compact(_sorted_out(shape, rows, limits), share), "rows")
    return Sketch(rows, limits.select(*shape.qcs, *LIMITS))


def _likely(shape: Shape) -> Column:
    """Whether a new row can be in the merged sketch: no stratum's bound ever rises."""
    digest = row_digest(shape.key, shape.seed)
    likely = (digest <= F.col("_old_bound")) | F.col("_old_bound").isNull()  # or a new stratum
    return likely | (second_draw(digest) < F.col("_old_tail_below")) if shape.tail else likely


def _beyond() -> Column:
    """Whether a stratum needs rows that the old sketch does not hold."""
    cutoff, bound = F.col("_cutoff"), F.coalesce("_old_bound", F.lit(EVERYTHING))
    return F.coalesce(
        cutoff.isNull()
        | (cutoff > bound)
        | ((cutoff == bound) & (F.col("_fitting") > F.col("_old_bound_rows")))
        | (F.col("_tail_below") > F.col("_old_tail_below")),
        F.lit(False),
    )


def _narrowed() -> list[Column]:
    """The helpers, with bounds that lie no further than the old ones."""
    bound, old = F.col("_bound"), F.coalesce("_old_bound", F.lit(EVERYTHING))
    parts = ("_bound", "_bound_rows", "_bound_copies")
    both = F.least("_bound_rows", "_old_bound_rows")
    own = F.struct(*parts)
    limit = (
        F.when(bound < old, own)
        .when(bound == old, F.struct(bound, both.alias("_bound_rows"), F.col("_bound_copies")))
        .otherwise(
            F.struct(
                old.alias("_bound"),
                F.col("_old_bound_rows").alias("_bound_rows"),
                F.col("_old_bound_rows").alias("_bound_copies"),
            )
        )
    )
    return [
        *(F.col(c) for c in _HELPERS if c not in parts),
        *(limit[c].alias(c) for c in parts),
    ]
