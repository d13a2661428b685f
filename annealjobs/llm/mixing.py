"""Operator 6: mixing sources to target weights.

Sizes are summed per source, targets follow from the weights by raising a water level over the sources'
ceilings, and the repetition rate of a source is its target over its size: a document is taken
floor(rate) times plus once more with probability equal to the fraction, drawn from a keyed hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annealjobs.llm.shared import WORD, saved, table

WEIGHTS, CEILING, SEED = (5, 2, 1), 3, 17
#: Sources whose rates are small enough to send to every task.
MOST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """In [0, 1), from the key alone: reruns, retries and other partitionings draw the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; no target
    exceeds ceiling times its source's size, and what is above is shared again by weight among the others.
    That fixed point is a water level: with sources ordered by ceiling over weight, those whose ceiling
    lies under the level of the rest are full. Sources of size zero have target zero. The windows run over
    one row a source.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(ceiling)).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("full", F.col("most") / F.col("w") <= F.col("level"))
    water = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * water).alias("target"))


def rates(docs: DataFrame, size: Column, weights: Sequence[int] = WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """(goal_source, source_size, target, rate), one row a source of docs (source and what size reads), for joins.

    Broadcast where it has at most MOST_SOURCES rows, so that texts need not move; a join by source beyond.
    """
    sizes = saved(docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(size).alias("source_size")), "sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = saved(targets(sizes, weights, ceiling).select(F.col("source").alias("goal_source"), "source_size", "target", rate.alias("rate")), "rates")
    return F.broadcast(goal) if goal.count() <= MOST_SOURCES else goal


def times(rate: Column, key: Column, seed: int = SEED) -> Column:
    """floor(rate), and one more with the fraction's probability, drawn from the key; never over the ceiling, as no rate is."""
    return (F.floor(rate) + (uniform(key, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def copies(docs: DataFrame, size: Column, weights: Sequence[int] = WEIGHTS, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies) for every row of docs (doc_id, source and what size reads).

    Null texts have size 0, texts of any length are counted whole, a null source is a source, other columns
    are ignored, repeated rows count and draw alike, as rows without a doc_id do; an empty table gives an
    empty result.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))
    goal = rates(docs, size, weights, ceiling)
    out = sized.join(goal, sized["source"].eqNullSafe(goal["goal_source"]))
    return out.select("doc_id", "size", "source_size", "target", times(F.col("rate"), F.col("doc_id"), seed).alias("copies"))


def mixed(docs: DataFrame, size: Column, weights: Sequence[int] = WEIGHTS, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """The rows of docs (doc_id, text, source), each as often as the mix takes it, with all their columns.

    Cases as in copies, but that rows without a doc_id draw by their text.
    """
    goal = rates(docs, size, weights, ceiling)
    rows = docs.select(F.struct("*").alias("row"))
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit("")).cast("binary")))
    both = rows.join(goal, F.col("row.source").cast("string").eqNullSafe(goal["goal_source"]))
    return both.select("row", F.explode(F.array_repeat(F.lit(True), times(F.col("rate"), key, seed).cast("int")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents"), n_words(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [{', '.join(f'{float(w)}' for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS w, source_size * {float(CEILING)}::DOUBLE AS most FROM per),
levels AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(most) OVER before, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0)) AS level
  FROM ranked WINDOW before AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, CASE WHEN most / w <= level THEN most ELSE w * (SELECT max(level) FROM levels WHERE NOT most / w <= level) END AS target FROM levels),
rates AS (SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}|' || doc_id), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rates
"""
