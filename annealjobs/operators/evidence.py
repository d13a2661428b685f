"""Estimators of log evidence over chain traces (dataset_id, rung, iter, log_lik), grouped sums throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annealjobs.functions.logspace import log_sum_exp
from annealjobs.operators.ladders import adjacent_rungs


def drop_burn_in(trace: DataFrame, burn: float) -> DataFrame:
    """Without the first share of each rung's iterations."""
    n = trace.groupBy("dataset_id", "rung").agg(F.count("*").alias("_n"))
    return trace.join(n, ["dataset_id", "rung"]).where(F.col("iter") >= F.floor(F.col("_n") * burn)).drop("_n")


def rung_terms(trace: DataFrame, steps: DataFrame, burn: float = 0.2) -> DataFrame:
    """(dataset_id, rung, n, mean_log_lik, term): term = LSE(delta * log_lik) - ln n; steps (t, delta)."""
    rows = drop_burn_in(trace, burn).join(F.broadcast(steps.select(F.col("t").alias("rung"), "delta")), "rung")
    rows = rows.withColumn("_x", F.col("delta") * F.col("log_lik"))
    lse = log_sum_exp(rows, ["dataset_id", "rung"], "_x", "_lse", ["log_lik"], n=F.count("*"), mean_log_lik=F.avg("log_lik"))
    return lse.select("dataset_id", "rung", "n", "mean_log_lik", (F.col("_lse") - F.ln("n")).alias("term"))


def rung_summary(trace: DataFrame, ladder: DataFrame, burn: float = 0.2) -> DataFrame:
    running = Window.partitionBy("dataset_id").orderBy("rung")
    return rung_terms(trace, adjacent_rungs(ladder), burn).withColumn("log_z", F.sum("term").over(running))


def stepping_stone(trace: DataFrame, ladder: DataFrame, burn: float = 0.2) -> DataFrame:
    return rung_terms(trace, adjacent_rungs(ladder), burn).groupBy("dataset_id").agg(F.sum("term").alias("log_z"))


def stepping_stone_generic(ratios: DataFrame, key: str = "dataset_id", rung: str = "rung", log_ratio: str = "log_ratio") -> DataFrame:
    """The same sum for any density ratio: LSE(log_ratio) - ln n by rung."""
    lse = log_sum_exp(ratios, [key, rung], log_ratio, "_lse", _n=F.count("*"))
    return lse.groupBy(key).agg(F.sum(F.col("_lse") - F.ln("_n")).alias("log_z"))


def reverse_stepping_stone(trace: DataFrame, ladder_open: DataFrame, burn: float = 0.2) -> DataFrame:
    """Over an open ladder, whose top rung steps to 1; the sum has no order, so it may start at the posterior's side."""
    return rung_terms(trace, adjacent_rungs(ladder_open, top=1.0), burn).groupBy("dataset_id").agg(F.sum("term").alias("log_z"))


def equal_rungs(trace: DataFrame) -> DataFrame:
    """Without the first iterations of rungs that have more than the data set's shortest."""
    n = trace.groupBy("dataset_id", "rung").agg(F.count("*").alias("_n"))
    n = n.withColumn("_m", F.min("_n").over(Window.partitionBy("dataset_id")))
    return trace.join(n, ["dataset_id", "rung"]).where(F.col("iter") >= F.col("_n") - F.col("_m")).drop("_n", "_m")


def linked_importance_sampling(trace: DataFrame, ladder: DataFrame) -> DataFrame:
    """Half steps from both sides of each pair of adjacent rungs, which must have equally many samples."""
    steps = F.broadcast(adjacent_rungs(ladder).select(F.col("t").alias("rung"), "delta"))
    up = trace.join(steps, "rung").withColumn("_x", F.col("delta") / 2 * F.col("log_lik"))
    down = trace.join(steps.withColumn("rung", F.col("rung") + 1), "rung").withColumn("_x", -F.col("delta") / 2 * F.col("log_lik"))
    a = log_sum_exp(up, ["dataset_id", "rung"], "_x", "_a", n_up=F.count("*"))
    b = log_sum_exp(down, ["dataset_id", "rung"], "_x", "_b", n_down=F.count("*"))
    b = b.withColumn("rung", F.col("rung") - 1)
    equal = F.when(F.col("n_up") == F.col("n_down"), F.col("_a") - F.col("_b")).otherwise(F.raise_error(F.lit("rungs of unequal size")).cast("double"))
    return a.join(b, ["dataset_id", "rung"]).groupBy("dataset_id").agg(F.sum(equal).alias("log_z"))


def link_weights(trace: DataFrame, delta: float, keys: list[str]) -> DataFrame:
    """Weight of each sample as a link to the next rung, exp(log_lik * delta / 2) over the rung; draw with weighted_draw."""
    from annealjobs.functions.logspace import exp_normalize

    return exp_normalize(trace.withColumn("_x", F.col("log_lik") * (delta / 2)), keys, "_x", "w").drop("_x")


def monte_carlo_evidence(df: DataFrame, key: str, log_lik: str = "log_lik") -> DataFrame:
    lse = log_sum_exp(df, key, log_lik, "_lse", _n=F.count("*"))
    return lse.select(key, (F.col("_lse") - F.ln("_n")).alias("log_z"))


def smc_evidence(running: DataFrame, key: str, method: str) -> DataFrame:
    """Final running log evidence with a method's label; running (key, t, log_z)."""
    return running.groupBy(key).agg(F.max_by("log_z", "t").alias("log_z")).withColumn("method", F.lit(method))
