"""Mixing sources to target weights over a tree of domain, language and source.

DataFrame functions only: tokens are counted per leaf, the budget goes down the small tree with
windows over siblings, and each leaf's part is a prefix of a seeded order of its documents.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.session import pin

LEVELS = ("domain", "lang", "source")
#: Weights of siblings that are not named count as 1.
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {},
}
SEED = 17
MAX_EPOCHS = 2
#: Share of all tokens that the mix is to hold.
BUDGET = (3, 5)
#: Leading hex digits of the digest that cut a leaf's order into pieces.
PIECE_DIGITS = 3
TOKEN = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """The domain of a source: the last digit of its name modulo 4; d0 without one."""
    last = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9])$", 1)
    digit = F.when(last == "", F.lit(0)).otherwise(F.ascii(last) - F.ascii(F.lit("0")))
    return F.concat(F.lit("d"), (digit % 4).cast("string"))


def _placed(docs: DataFrame) -> DataFrame:
    """Place in the tree and digest of every row, and the whole row as ``row``, so that no column
    of the documents clashes with one of the mix."""
    row = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return row.select(
        "row",
        F.col("row.doc_id").alias("doc_id"),
        domain_of(F.col("row.source")).alias("domain"),
        F.coalesce(F.col("row.lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("row.source"), F.lit("")).alias("source"),
        F.md5(text.cast("binary")).alias("text_md5"),
    )


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, place in the tree, tokens and a digest of the text, for every row."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    n_tokens = F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("n_tokens")
    return _placed(docs).select("doc_id", *LEVELS, n_tokens, "text_md5")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    weight = F.lit(1)
    for name, value in weights.get(level, {}).items():
        weight = F.when(F.col(level) == name, F.lit(value)).otherwise(weight)
    return weight.cast("long")


def budgets(
    stock: DataFrame,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    budget: tuple[int, int] = BUDGET,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """(domain, lang, source, tokens, budget) for the leaves ``stock`` (domain, lang, source, tokens).

    The budget goes down the tree by weight. No node gets more than ``max_epochs`` times the
    tokens below it; what it can't take goes to its siblings by weight while they have room, and
    only then to its parent's siblings, as a parent's room is the sum of its children's. Sorted
    by room over weight, the siblings that fill up come first and the others share the rest.
    Whole tokens, rounded down.
    """
    room = stock.withColumn("cap", F.col("tokens") * max_epochs)
    numerator, denominator = budget
    available = stock.agg(F.sum("tokens")).first()[0] or 0
    given = F.lit(available * numerator // denominator)
    parents, above = None, []
    for level in LEVELS:
        names = [*above, level]
        nodes = room.groupBy(*names).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("w", _weight(level, weights))
        nodes = nodes.withColumn("given", given) if parents is None else nodes.join(parents, above)
        siblings = Window.partitionBy(*(above or [F.lit(0)]))
        by_room = siblings.orderBy(F.col("cap") / F.col("w"), level)
        before = by_room.rowsBetween(Window.unboundedPreceding, -1)
        onward = by_room.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumns(
            {
                "left": F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0)),
                "shares": F.sum("w").over(onward),
                "rank": F.row_number().over(by_room),
            }
        )
        short = F.expr("cap * shares > left * w")
        at = F.min(F.when(short, F.struct("rank", "left", "shares"))).over(siblings)
        nodes = nodes.withColumn("at", at)
        part = F.expr("CASE WHEN at IS NULL OR rank < at.rank THEN cap ELSE at.left * w DIV at.shares END")
        parents = nodes.select(*names, part.alias("given"))
        above = names
    return room.join(parents, list(LEVELS)).select(
        *LEVELS, "tokens", F.col("given").alias("budget")
    )


def _digest(seed: int, epoch: Column, doc_id: Column) -> Column:
    named = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), named).cast("binary"))


def cut_offs(rows: DataFrame, leaf_budgets: DataFrame, seed: int = SEED) -> DataFrame:
    """Per leaf: whole epochs, and the last place in the order of the next epoch that fits.

    The order is cut into pieces by the leading digits of the digest; pieces are summed up and
    only then added along a leaf, so a leaf of any size never sits in one task.
    """
    leaf = [*LEVELS]
    parts = leaf_budgets.withColumns(
        {
            "whole": F.expr("coalesce(budget DIV nullif(tokens, 0), 0L)"),
            "rest": F.expr("coalesce(budget % nullif(tokens, 0), 0L)"),
        }
    )
    placed = rows.join(parts, leaf).where("rest > 0").withColumn(
        "digest", _digest(seed, F.col("whole") + 1, F.col("doc_id"))
    ).withColumn("piece", F.substring("digest", 1, PIECE_DIGITS))
    sums = placed.groupBy(*leaf, "piece").agg(F.sum("n_tokens").alias("n"))
    along = Window.partitionBy(*leaf).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*leaf, "piece", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"))
    # equal rows share their place: they come in together or not at all
    inside = Window.partitionBy(*leaf, "piece").orderBy("digest", F.expr("struct(doc_id, text_md5)"))
    last = (
        placed.join(starts, [*leaf, "piece"])
        .where("start <= rest")
        .withColumn("upto", F.col("start") + F.sum("n_tokens").over(inside))
        .where("upto <= rest")
        .groupBy(*leaf)
        .agg(F.max(F.struct("digest", "doc_id", "text_md5")).alias("last"))
    )
    return parts.join(last, leaf, "left").select(*leaf, "whole", "last")


def mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    budget: tuple[int, int] = BUDGET,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per epoch, with ``epoch`` from 1 added.

    Each epoch orders a leaf's rows by a digest of seed, epoch and doc_id. A leaf's budget takes
    whole epochs first, then of the next epoch the longest prefix that fits. Tokens are runs of
    other than ASCII white space.

    A null text has no tokens; null lang and source are leaves of their own, named by the empty
    text; a null doc_id counts as empty in the order and comes first. Rows that agree in doc_id
    and text share their place and come in together. Rows of a leaf without tokens stay out. An
    empty table gives no rows. Further columns pass through; a column ``epoch``, in any case, is replaced.
    """
    rows = pin(leaves(docs), "mix-rows")
    stock = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = pin(budgets(pin(stock, "mix-stock"), weights, budget, max_epochs), "mix-budgets")
    cuts = pin(cut_offs(rows, plan, seed), "mix-cuts")
    place = F.struct(
        _digest(seed, F.col("whole") + 1, F.col("doc_id")).alias("digest"), "doc_id", "text_md5"
    )
    epochs = F.col("whole") + F.coalesce((place <= F.col("last")).cast("long"), F.lit(0))
    taken = _placed(docs).join(cuts, [*LEVELS]).select("row", epochs.alias("epochs"))
    taken = taken.where("epochs > 0").select(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))).alias("epoch")
    )
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "epoch"]
    return taken.select(*kept, F.col("epoch").cast("int").alias("epoch"))


def oracle_sql() -> str:
    """The query in SQL: the same budgets level by level, and running sums over whole leaves."""

    def weight(level: str) -> str:
        whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
        return f"CASE {level} {whens} ELSE 1 END" if whens else "1"

    levels, above = [], []
    for level in LEVELS:
        names = [*above, level]
        listed = ", ".join(names)
        by = f"PARTITION BY {', '.join(above)}" if above else ""
        given = (
            f"JOIN {above[-1]}_got USING ({', '.join(above)})"
            if above
            else f"CROSS JOIN (SELECT sum(tokens) * {BUDGET[0]} // {BUDGET[1]} AS given FROM stock) AS g"
        )
        levels.append(f"""
{level}_n AS (SELECT *, {weight(level)} AS w FROM
  (SELECT {listed}, sum(tokens) * {MAX_EPOCHS} AS cap FROM stock GROUP BY {listed}) AS n {given}),
{level}_l AS (SELECT *,
  given - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {level}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
  sum(w) OVER ({by} ORDER BY cap / w, {level}
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares,
  row_number() OVER ({by} ORDER BY cap / w, {level}) AS rn FROM {level}_n),
{level}_a AS (SELECT *,
  min(CASE WHEN cap * shares > remains * w THEN rn END) OVER ({by}) AS first_short FROM {level}_l),
{level}_s AS (SELECT *, max(CASE WHEN rn = first_short THEN remains END) OVER ({by}) AS s_remains,
  max(CASE WHEN rn = first_short THEN shares END) OVER ({by}) AS s_shares FROM {level}_a),
{level}_got AS (SELECT {listed}, CAST(CASE WHEN first_short IS NULL OR rn < first_short THEN cap
  ELSE s_remains * w // s_shares END AS HUGEINT) AS given FROM {level}_s)""")
        above = names
    leaf = ", ".join(LEVELS)
    return f"""
WITH rows_ AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  'd' || coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9])$', 1) AS INTEGER), 0) % 4 AS domain,
  len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS n_tokens,
  md5(coalesce(text, '')) AS text_md5 FROM documents),
stock AS (SELECT {leaf}, sum(n_tokens) AS tokens FROM rows_ GROUP BY {leaf}),{",".join(levels)},
parts AS (SELECT {leaf}, coalesce(given // nullif(tokens, 0), 0) AS whole,
  coalesce(given % nullif(tokens, 0), 0) AS rest FROM stock JOIN source_got USING ({leaf})),
placed AS (SELECT *, md5('{SEED}:' || (whole + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM rows_ JOIN parts USING ({leaf})),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY digest, doc_id, text_md5
  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed),
took AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS epochs FROM run)
SELECT doc_id, lang, source, n_tokens, CAST(epoch AS INTEGER) AS epoch
FROM (SELECT *, unnest(range(1, CAST(epochs AS BIGINT) + 1)) AS epoch FROM took) AS t
"""
