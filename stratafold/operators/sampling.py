"""Uniform, stratified and min-row samples of a fact table.

A stratified sample keeps, per stratum, the rows with the smallest digests. It
is built without moving the fact while the cut-offs are small enough to broadcast:

1. stratum sizes (one aggregate over the query columns);
2. the digest of the last row to keep per stratum. The sizes predict where it
   lies, so digests below the predicted band are only counted, those above are
   skipped, and the few inside are listed. One narrow pass with map-side
   combining; copies of a row collapse into one entry with a count;
3. one pass over the fact that compares each digest with its stratum's cut-off.

The prediction only decides how much is listed. Where the counts show that it
missed, the cut-off is found by counting digest prefixes instead, so the result
is the exact first n of each stratum in every case.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.functions.rowhash import (
    EVERYTHING,
    NOTHING,
    literal_threshold,
    row_digest,
    second_draw,
    threshold,
)
from stratafold.functions.sizing import SizeRule, at_least, cochran, whole_rows
from stratafold.operators.joins import fits_broadcast, null_safe_join
from stratafold.operators.strata import stratum_sizes
from stratafold.session import pin

TAIL_SHARE = 20  # rows beyond the target are kept at 1/20 of the stratum's rate
BAND = 6.0  # width of the listed band in standard deviations to each side
PREFIX_STEPS = (4, 9, 32)
TIE_SPLITS = 256
#: Thresholds of the filter before a shuffle and the digits of each: 8 MB for both lists.
BUCKETS, PREFIX = 1 << 18, 5


def uniform_sample(
    fact: DataFrame, ratio: float, key: Sequence[str], seed: int | str = 0
) -> DataFrame:
    """Each row with probability ``ratio``, decided by its own digest."""
    return fact.where(row_digest(key, seed) < F.lit(literal_threshold(ratio)))


def tail_rate(target: Column, groupsize: Column) -> Column:
    return target / F.lit(TAIL_SHARE) / groupsize


def stratified_sample(
    source: DataFrame,
    qcs: Sequence[str],
    key: Sequence[str],
    *,
    rule: SizeRule | None = None,
    sizes: DataFrame | None = None,
    tail: bool = True,
    seed: int | str = 0,
    order: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``rule(groupsize)`` rows of every stratum, plus a thin random tail beyond them.

    ``source`` is the fact or a prejoin, ``columns`` the fact's columns to return
    (all by default). ``key`` identifies a row; rows that share it are copies,
    drawn in the order of ``order`` where only some of them fit. ``sizes`` may
    pass in stored stratum sizes of this source; a row whose stratum they lack is an
    error, as they are of another state then.

    One way for any number of strata: quotas and cut-offs are stored tables joined
    without a hint, so Catalyst broadcasts them while their files are small and
    shuffles by the strata beyond that, where AQE splits a hot stratum. A filter by
    hashed strata goes before such a shuffle, so that hardly more than the sample moves.
    """
    rule = rule or cochran()
    columns = list(columns or source.columns)
    qcs = list(qcs)
    given = sizes is not None
    if not given:
        sizes = stratum_sizes(source, qcs)
    quotas = pin(stratum_quotas(sizes.select(*qcs, "groupsize"), rule), "quotas")
    if given and not fits_broadcast(quotas):
        check_sizes(source, quotas, qcs)
    cutoffs, split = stratum_cutoffs(source, quotas, qcs, key, seed)
    return rows_below(source, cutoffs, split, qcs, key, tail, seed, order).select(*columns)


def min_row_sample(
    source: DataFrame, qcs: Sequence[str], min_rows: int, key: Sequence[str], **options
) -> DataFrame:
    """As :func:`stratified_sample` with the same number of rows for every stratum."""
    return stratified_sample(source, qcs, key, rule=at_least(min_rows), **options)


def _margin(keep: Column) -> Column:
    return F.lit(BAND) * F.sqrt(keep) + F.lit(2.5 * BAND)


def stratum_quotas(sizes: DataFrame, rule: SizeRule, reserve: bool = False) -> DataFrame:
    """Per stratum: rows to keep, the band that should hold the last of them, the tail's rate.

    ``most`` rows are to be found; with a ``reserve`` that is some more than are kept.
    """
    groupsize = F.col("groupsize")
    target = rule(groupsize)
    keep = F.least(groupsize, whole_rows(target))
    most = F.least(groupsize, keep + F.ceil(_margin(keep))) if reserve else keep
    return sizes.select(
        "*",
        keep.alias("keep"),
        most.alias("most"),
        threshold(tail_rate(target, groupsize)).alias("tail_below"),
        threshold((keep - _margin(keep)) / groupsize).alias("low"),
        threshold((most + _margin(most)) / groupsize).alias("high"),
        (keep < groupsize).alias("open"),
        F.monotonically_increasing_id().alias("_stratum"),
    )


def _bucket(qcs: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*qcs), F.lit(BUCKETS)).cast("int")


def check_sizes(source: DataFrame, sizes: DataFrame, qcs: Sequence[str]) -> None:
    """Raise if the source has not the rows that the sizes say, by hashed stratum.

    Needed before :func:`likely_rows`, which could drop a row whose stratum has no size before the
    join notices. One scan of the query columns, combined to BUCKETS counts before the shuffle.
    """
    there = source.groupBy(_bucket(qcs).alias("_bucket")).agg(F.count("*").alias("n"))
    said = sizes.groupBy(_bucket(qcs).alias("_bucket")).agg((-F.sum("groupsize")).alias("n"))
    apart = there.union(said).groupBy("_bucket").agg(F.sum("n").alias("n")).where("n <> 0")
    if not apart.isEmpty():
        raise ValueError("a row's stratum has no size or another one; profile the source again")


def likely_rows(
    rows: DataFrame, limits: DataFrame, qcs: Sequence[str], below: str, tail: str | None
) -> DataFrame:
    """``rows`` whose digest may lie below their stratum's limit, or in its tail.

    Where the limits are too large to broadcast, the rows would be shuffled by their strata. The
    greatest limits per hashed stratum, rounded up, are two lists of BUCKETS short texts, whatever
    the number of strata: a value of the filter. Rows above them can't be in the sample and stay
    where they are. With many more strata than BUCKETS the lists tell them apart less and less.
    """
    if fits_broadcast(limits):
        return rows

    def prefix(digest: Column) -> Column:
        return F.substring(digest, 1, PREFIX)

    greatest = [prefix(F.max(below)).alias("most")]
    if tail:
        greatest.append(prefix(F.max(tail)).alias("thickest"))
    names = ["most", "thickest"][: len(greatest)]
    spark = rows.sparkSession
    buckets = limits.groupBy(_bucket(qcs).alias("id")).agg(*greatest)
    listed = spark.range(BUCKETS).join(buckets, "id", "left")
    listed = listed.select("id", *(F.coalesce(n, F.lit(NOTHING)).alias(n) for n in names))
    entries = F.sort_array(F.collect_list(F.struct("id", *names)))
    lists = pin(
        listed.agg(
            F.struct(*(entries.getField(n).alias(n) for n in names)).alias("l")
        ),
        "thresholds",
    ).scalar()
    digest, at = F.col("_digest"), _bucket(qcs)
    likely = prefix(digest) <= F.get(lists["most"], at)
    if tail:
        likely = likely | (prefix(second_draw(digest)) <= F.get(lists["thickest"], at))
    return rows.where(likely)


def rows_below(source, cutoffs, split, qcs, key, tail, seed, order) -> DataFrame:
    """Filter the source by its strata's cut-offs; small cut-offs leave it unshuffled."""
    helpers = ["_stratum", "_cutoff", "_tail_below", "_fitting", "_copies"]
    cutoffs = cutoffs.select(*qcs, *helpers)
    rows = source.withColumn("_digest", row_digest(key, seed))
    rows = likely_rows(rows, cutoffs, qcs, "_cutoff", "_tail_below" if tail else None)
    rows = null_safe_join(rows, cutoffs, qcs, how="left")
    helpers.append("_digest")
    digest, cutoff = F.col("_digest"), F.col("_cutoff")
    in_tail = second_draw(digest) < F.col("_tail_below") if tail else F.lit(False)
    unsized = F.raise_error(F.lit("a row's stratum has no size; profile the source again"))
    below = F.when(F.col("_stratum").isNull(), unsized.cast("boolean")).otherwise(digest <= cutoff)
    if split is None:
        return rows.where(below | in_tail).drop(*helpers)

    # some stratum has room for a part of the copies of one row only
    partly = (digest == cutoff) & (F.col("_fitting") < F.col("_copies")) & ~in_tail
    whole = rows.where((below | in_tail) & ~partly)
    copies = rows.where(partly)
    ranking = [F.col(c) for c in order] or [F.lit(0)]
    # the constant bound lets every task cut its copies before the shuffle, the
    # split by task number keeps a hot stratum out of a single reducer
    pieces = copies.withColumn("_piece", F.pmod(F.spark_partition_id(), F.lit(TIE_SPLITS)))
    for group in (["_stratum", "_piece"], ["_stratum"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*ranking))
        pieces = pieces.withColumn("_place", place).where(F.col("_place") <= F.lit(split))
        pieces = pieces.where(F.col("_place") <= F.col("_fitting")).drop("_place")
    return whole.drop(*helpers).unionByName(pieces.drop(*helpers, "_piece"))


def stratum_cutoffs(
    source: DataFrame,
    quotas: DataFrame,
    qcs: Sequence[str],
    key: Sequence[str],
    seed: int | str,
    save: Callable[[DataFrame, str], DataFrame] | None = None,
) -> tuple[DataFrame, int | None]:
    """Per stratum the digest of its last row to keep; written once, read back.

    ``_fitting`` of the ``_copies`` rows with that digest belong to the sample; a cut-off is
    NULL where ``source`` has fewer rows of a stratum than are to be kept. ``_bound``,
    ``_bound_rows`` and ``_bound_copies`` say the same of the last of the ``most`` rows, and are
    those of the cut-off where that one isn't in the predicted band.
    The second result is the largest ``_fitting`` that is less than all copies,
    or None if there is no such stratum.
    """
    save = save or pin
    bands = quotas.where("open").select(*qcs, "_stratum", "keep", "most", "low", "high")
    narrow = source.select(*qcs, row_digest(key, seed).alias("_digest"))
    narrow = null_safe_join(likely_rows(narrow, bands, qcs, "high", None), bands, qcs)
    entry = F.when(F.col("_digest") < F.col("low"), F.lit(NOTHING)).otherwise(F.col("_digest"))
    listed = (
        narrow.where(F.col("_digest") < F.col("high"))
        .groupBy("_stratum", "keep", "most", entry.alias("entry"))
        .agg(F.count("*").alias("rows"))
    )
    cutoffs = save(_with_cutoffs(quotas, _hits(listed, "keep", "most"), qcs), "cutoffs")
    missed, split = _check(cutoffs)
    if missed:
        lost = quotas.join(cutoffs.where("_cutoff is null").select("_stratum"), "_stratum")
        found = _hits(_by_prefix(source, lost, qcs, key, seed), "keep")
        again = _with_cutoffs(lost, found, qcs)
        cutoffs = save(cutoffs.where("_cutoff is not null").unionByName(again), "cutoffs")
        _, split = _check(cutoffs)
    return cutoffs, split


def _check(cutoffs: DataFrame) -> tuple[int, int | None]:
    fitting = F.col("_fitting")
    partial = F.when(fitting < F.col("_copies"), fitting)
    return tuple(cutoffs.agg(F.count_if(F.col("_cutoff").isNull()), F.max(partial)).first())


def _running(entries: DataFrame) -> DataFrame:
    running = Window.partitionBy("_stratum").orderBy("entry")
    upto = F.sum("rows").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return entries.select("*", (upto - F.col("rows")).alias("before"))


def _reaches(goal: str) -> Column:
    """Whether a stratum's running count first reaches ``goal`` with this entry."""
    goal = F.col(goal)
    return (F.col("before") < goal) & (F.col("before") + F.col("rows") >= goal)


def _last_entry(entries: DataFrame) -> DataFrame:
    return _running(entries).where(_reaches("keep"))


def _hits(entries: DataFrame, *goals: str) -> DataFrame:
    """Per stratum and goal the entry that reaches it, how many of its rows fit, and all of them."""
    if "before" not in entries.columns:
        entries = _running(entries)

    def hit(goal: str) -> Column:
        there = _reaches(goal) & (F.col("entry") != F.lit(NOTHING))
        fitting = F.col(goal) - F.col("before")
        value = F.struct("entry", fitting.alias("fitting"), F.col("rows").alias("copies"))
        return F.max(F.when(there, value)).alias(f"_{goal}")

    found = entries.groupBy("_stratum").agg(*map(hit, goals))
    return found if "most" in goals else found.withColumn("_most", F.col("_keep"))


def _with_cutoffs(quotas: DataFrame, found: DataFrame, qcs: Sequence[str]) -> DataFrame:
    cutoff = (
        F.when(~F.col("open"), F.lit(EVERYTHING))
        .when(F.col("keep") == 0, F.lit(NOTHING))
        .otherwise(F.col("_keep.entry"))
    )
    most = F.coalesce("_most", "_keep")
    everything = F.col("most") >= F.col("groupsize")
    return quotas.join(found, "_stratum", "left").select(
        *qcs,
        "_stratum",
        "groupsize",
        "keep",
        cutoff.alias("_cutoff"),
        F.col("tail_below").alias("_tail_below"),
        F.col("_keep.fitting").alias("_fitting"),
        F.col("_keep.copies").alias("_copies"),
        F.when(everything, F.lit(EVERYTHING))
        .otherwise(F.coalesce(most["entry"], F.lit(NOTHING)))
        .alias("_bound"),
        F.when(~everything, most["fitting"]).alias("_bound_rows"),
        F.when(~everything, most["copies"]).alias("_bound_copies"),
    )


def _by_prefix(source, quotas, qcs, key, seed) -> DataFrame:
    """Find the cut-offs of ``quotas`` by counting ever longer digest prefixes.

    Each step counts only digests that share the prefix found so far, so the
    number of counters per stratum stays bounded whatever the rows look like.
    """
    rows = source.select(*qcs, row_digest(key, seed).alias("_digest"))
    state = quotas.select(*qcs, "_stratum", "keep", F.lit("").alias("prefix"))
    for width in PREFIX_STEPS:
        inside = null_safe_join(rows, state, qcs).where(
            F.col("_digest").startswith(F.col("prefix"))
        )
        counted = inside.groupBy(
            "_stratum", "keep", F.substring("_digest", 1, width).alias("entry")
        ).agg(F.count("*").alias("rows"))
        found = pin(_last_entry(counted), "prefixes")
        # what is left to find inside the prefix that holds the last row
        inner = found.select(
            "_stratum",
            (F.col("keep") - F.col("before")).alias("keep"),
            F.col("entry").alias("prefix"),
        )
        state = state.drop("keep", "prefix").join(inner, "_stratum")
    return found
