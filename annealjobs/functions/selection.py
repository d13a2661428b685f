"""Exact order statistics of groups of any size, by histograms that narrow to the rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annealjobs.functions.scratch import cut

#: Rows of a group that one task may order, and bins of a histogram.
MOST, BINS = 10_000, 256


def _on(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})


def select(rows: DataFrame, keys: list[str], value: str, weight: str | None, targets: DataFrame, most: int = MOST, bins: int = BINS) -> DataFrame:
    """(keys, selected): the least value of each group up to which values weigh at least its target, of targets (keys, target).

    Groups of more than `most` rows are narrowed by passes: a histogram of what is between the bounds, laid out
    by their own least and largest values, gives the bin that holds the target, and its least and largest
    values are the next bounds. What is left then has few rows a group and is ordered; nothing is buffered
    before. Weights are positive; values are finite numbers, other rows are left out, and so are groups
    without a target; null keys are groups.
    """
    own = rows.select(*keys, F.col(value).cast("double").alias("_v"), (F.lit(1).cast("long") if weight is None else F.col(weight)).alias("_w")).where("_v IS NOT NULL AND NOT isnan(_v)")
    stats = own.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = cut(_renamed(stats.join(_renamed(targets, keys), _on(keys)).select(*keys, "_n", "_lo", "_hi", F.col("target").alias("_t")), keys))
    ks = [f"_k{i}" for i in range(len(keys))]
    closed = None
    while True:
        done = state.where((F.col("_n") <= most) | (F.col("_lo") == F.col("_hi")))
        closed = done if closed is None else closed.unionByName(done)
        wide = state.where((F.col("_n") > most) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        inside = own.join(wide, _on(keys)).where("_v >= _lo AND _v <= _hi")
        # halves, so that the span of any two numbers is one
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins))
        counts = inside.groupBy(*ks, bin_.alias("_b")).agg(F.count("*").alias("_n"), F.sum("_w").alias("_s"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_t").alias("_t"))
        before = F.coalesce(F.sum("_s").over(Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("_before", before)
        last = F.max("_b").over(Window.partitionBy(*ks))  # rounding may leave a target beyond all weights
        hit = placed.withColumn("_last", last).where((F.col("_before") < F.col("_t")) & ((F.col("_before") + F.col("_s") >= F.col("_t")) | (F.col("_b") == F.col("_last"))))
        state = cut(hit.select(*ks, "_n", "_lo", "_hi", (F.col("_t") - F.col("_before")).alias("_t")).select(state.columns))
    closed = cut(closed)
    one = closed.where("_lo = _hi").select(*ks, F.col("_lo").alias("selected"))
    left = own.join(closed.where("_lo < _hi"), _on(keys)).where("_v >= _lo AND _v <= _hi")
    by_value = left.groupBy(*ks, "_v", "_t").agg(F.sum("_w").alias("_s"))
    upto = by_value.withColumn("_upto", F.sum("_s").over(Window.partitionBy(*ks).orderBy("_v"))).withColumn("_top", F.max("_v").over(Window.partitionBy(*ks)))
    few = upto.where((F.col("_upto") >= F.col("_t")) | (F.col("_v") == F.col("_top"))).groupBy(*ks).agg(F.min("_v").alias("selected"))
    return cut(one.unionByName(few).withColumnsRenamed(dict(zip(ks, keys))))


def quantile(rows: DataFrame, keys: list[str], value: str, q: float, out: str, most: int = MOST, bins: int = BINS) -> DataFrame:
    """(keys, out, n): the q-quantile by linear interpolation between order statistics, and the number of rows with a value."""
    own = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    sizes = own.groupBy(*keys).agg(F.count("*").alias("n"))
    rank = F.floor((F.col("n") - 1) * q)
    low = select(own, keys, "_v", None, sizes.select(*keys, (rank + 1).alias("target")), most, bins)
    # the next order statistic: the same value if it stands more often, else the least beyond it
    near = own.join(_renamed(low, keys), _on(keys))
    ends = near.groupBy(*keys).agg(F.count("*").alias("n"), F.first("selected").alias("_a"), F.count_if(F.col("_v") <= F.col("selected")).alias("_upto"), F.min(F.when(F.col("_v") > F.col("selected"), F.col("_v"))).alias("_b"))
    at = (F.col("n") - 1) * q
    following = F.when(F.col("_upto") > F.floor(at) + 1, F.col("_a")).otherwise(F.coalesce("_b", "_a"))
    return ends.select(*keys, (F.col("_a") + (following - F.col("_a")) * (at - F.floor(at))).alias(out), "n")
