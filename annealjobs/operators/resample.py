"""Weighted draws. Cumulative weights are two-level prefix sums, so no population is summed in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annealjobs.functions.keyed import uniform

#: Particles of a population whose running sum one task takes; chunks of a population are summed first.
CHUNK = 1 << 16


def _list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def running_totals(df: DataFrame, keys: str | Sequence[str], order: str, w: str, chunk: int = CHUNK) -> DataFrame:
    """Rows with _before and _upto, the sum of w before and up to the row in the order of an integer id, and _total."""
    keys = _list(keys)
    rows = df.withColumn("_c", F.floor(F.col(order) / chunk).cast("long"))
    sums = rows.groupBy(*keys, "_c").agg(F.sum(w).alias("_sum"))
    within = Window.partitionBy(*keys, "_c").orderBy(order)
    total = Window.partitionBy(*keys)
    before = total.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_c", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.sum("_sum").over(total).alias("_total"))
    rows = rows.withColumn("_hi", F.sum(w).over(within)).withColumn("_lo", F.coalesce(F.lag("_hi").over(within), F.lit(0))).join(base, [*keys, "_c"])
    return rows.withColumn("_before", F.col("_base") + F.col("_lo")).withColumn("_upto", F.col("_base") + F.col("_hi")).drop("_c", "_lo", "_hi", "_base")


def cumulative_intervals(df: DataFrame, keys: str | Sequence[str], order: str, w: str = "w", chunk: int = CHUNK) -> DataFrame:
    """Rows with lo and hi, their share of [0, 1) in the order of an integer id; zero weights are empty intervals."""
    rows = running_totals(df, keys, order, w, chunk)
    checked = F.when(F.col("_total") > 0, F.col("_total")).otherwise(F.raise_error(F.lit("all weights are zero")).cast("double"))
    return rows.withColumn("lo", F.col("_before") / checked).withColumn("hi", F.col("_upto") / checked).drop("_before", "_upto", "_total")


def draw_counts(df: DataFrame, key: str, seed: int, w: str = "w", n: int | None = None, id_col: str = "particle_id", per_bucket: int = 4) -> DataFrame:
    """(key, id, count): how often each particle is drawn in n draws (its population's size if not given).

    Draws and intervals meet in buckets of [0, 1) by an equi-join, with about per_bucket draws in each, so
    that the work grows with the draws; a dominating particle is one interval, and its hits are counted
    before anything is replicated. Draws are made by chunks, so that no task makes those of a large population alone.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_n")).withColumn("_n", F.lit(n).cast("long") if n else F.col("_n")).withColumn("_k", F.ceil(F.col("_n") / per_bucket))
    at = lambda c: F.least(F.col("_k") - 1, F.floor(c * F.col("_k")))
    spans = cumulative_intervals(df, key, id_col, w).where(F.col(w) > 0).join(sizes, key)
    spans = spans.select(key, id_col, "lo", "hi", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi")))).alias("_b"))
    chunks = sizes.select(key, "_n", "_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))).alias("_c")).repartition(key, "_c")
    draws = chunks.select(key, "_k", F.explode(F.sequence(F.col("_c") * CHUNK + 1, F.least(F.col("_n"), (F.col("_c") + 1) * CHUNK))).alias("draw"))
    draws = draws.withColumn("u", uniform(seed, key, "draw")).select(key, "u", at(F.col("u")).alias("_b"))
    hit = (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))
    return draws.join(spans, [key, "_b"]).where(hit).groupBy(key, id_col).agg(F.count("*").alias("count"))


def multinomial_resample(df: DataFrame, key: str, seed: int, w: str = "w", n: int | None = None, id_col: str = "particle_id") -> DataFrame:
    """Each drawn particle's row once per draw, with weight 1 / n."""
    counts = draw_counts(df, key, seed, w, n, id_col)
    total = F.lit(n) if n else F.sum("count").over(Window.partitionBy(key))
    rows = df.drop(w).join(counts.withColumn(w, F.lit(1.0) / total), [key, id_col])
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("count")


def resample_packed(df: DataFrame, key: str, seed: int, w: str = "w", n: int | None = None, id_col: str = "particle_id") -> DataFrame:
    """Each survivor once, its count as weight."""
    counts = draw_counts(df, key, seed, w, n, id_col)
    return df.drop(w).join(counts, [key, id_col]).withColumn(w, F.col("count").cast("double")).drop("count")


def survivors(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(key).agg(F.count("*").alias("survivors"))


def reset_weights(df: DataFrame, resampled: Column, n: Column, w: str = "w") -> DataFrame:
    return df.withColumn(w, F.when(resampled, 1 / n).otherwise(F.col(w)))


def weighted_draw(df: DataFrame, keys: str | Sequence[str], seed: int, w: str = "w", order: str = "particle_id") -> DataFrame:
    """One row a group, drawn by weight: no join, the draw is a condition on its interval."""
    keys = _list(keys)
    spans = cumulative_intervals(df, keys, order, w).withColumn("u", uniform(seed, *keys))
    return spans.where("u >= lo AND u < hi").drop("lo", "hi", "u")
