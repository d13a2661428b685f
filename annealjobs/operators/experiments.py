"""Scoring of methods over data sets and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annealjobs.functions.selection import quantile


def design(datasets: DataFrame, methods: list[str], iter_scales: list[float], reps: int, replay: str | None = None) -> DataFrame:
    """Data set x repeat x method rows with run 0; method i is paired with scale i.

    replay: a method whose steps are adaptive and are run again as a fixed ladder, as run 1 beside run 0.
    """
    if len(methods) != len(iter_scales):
        raise ValueError("each method needs one iteration scale")
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(float(s)).alias("iter_scale")) for m, s in zip(methods, iter_scales)])
    rows = datasets.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("p", F.explode(pairs))
    runs = F.when(F.col("p.method") == F.lit(replay), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(*datasets.columns, "repeat", "p.method", "p.iter_scale", F.explode(runs).alias("run"))


def tag_scores(scores: DataFrame, adaptive: str, kind: str, t: str, label: str = "ANNEALING") -> DataFrame:
    """Annealing rows carry how they were annealed, others blanks."""
    mine = F.col("Method") == label
    return scores.withColumns({n: F.when(mine, F.lit(v)).otherwise(F.lit("")) for n, v in (("Adaptive", adaptive), ("AdaptiveType", kind), ("T", t))})


def score_medians(scores: DataFrame) -> DataFrame:
    """(Method, IterScale, TreeName, Metric, median, n) over repeats, and whatever else a group holds."""
    return quantile(scores, ["Method", "IterScale", "TreeName", "Metric"], "Value", 0.5, "median")


def gold_lookup(datasets: DataFrame, gold: DataFrame, computed: DataFrame) -> DataFrame:
    """(name, tree, computed): the reference tree named after the data file, else the computed one."""
    key = F.regexp_replace("name", r"\.msf$", ".newick")
    named = datasets.withColumn("_key", key).join(gold.select(F.col("file").alias("_key"), F.col("tree").alias("_gold")), "_key", "left")
    both = named.join(computed.select("name", F.col("tree").alias("_own")), "name", "left")
    return both.select("name", F.coalesce("_gold", "_own").alias("tree"), F.col("_gold").isNull().alias("computed"))


def without_gold(datasets: DataFrame, gold: DataFrame) -> DataFrame:
    return datasets.withColumn("file", F.regexp_replace("name", r"\.msf$", ".newick")).join(gold, "file", "left_anti").drop("file")


def compare_to_truth(estimates: DataFrame, truth: DataFrame, on: list[str], rtol: float = 1e-3) -> DataFrame:
    """Absolute and relative error against (on, truth), and whether it is within rtol; nulls where there is no truth."""
    error = F.abs(F.col("estimate") - F.col("truth"))
    return estimates.join(truth, on, "left").withColumn("abs_error", error).withColumn("rel_error", error / F.abs("truth")).withColumn("within", error <= F.abs("truth") * rtol)


def expected_z(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Expected evidence over weighted runs (log_z, p) and the total probability."""
    return runs.groupBy(*keys).agg(F.sum(F.exp("log_z") * F.col("p")).alias("expected_z"), F.sum("p").alias("total_p"))


def method_summary(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))


def pivot_methods(rows: DataFrame, key: str, methods: list[str], value: str) -> DataFrame:
    return rows.groupBy(key).pivot("Method", methods).agg(F.avg(value))


def timing_summary(scores: DataFrame) -> DataFrame:
    """(Method, mean_time, p90_time, n) of rows that have a time."""
    means = scores.groupBy("Method").agg(F.avg("Time").alias("mean_time"))
    return quantile(scores, ["Method"], "Time", 0.9, "p90_time").join(means.withColumnRenamed("Method", "_m"), F.col("Method").eqNullSafe(F.col("_m"))).select("Method", "mean_time", "p90_time", "n")
