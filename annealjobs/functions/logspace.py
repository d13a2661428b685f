"""Weights in log space: sums, normalisation, effective sample sizes, evidence increments.

Every aggregate is a groupBy with partial sums, so one population may hold most of the rows; what goes
back to the rows is one value a group, by an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = str | Sequence[str]


def _keys(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def neg_inf() -> Column:
    return F.lit(float("-inf"))


def ln(x: Column) -> Column:
    """Natural logarithm with ln 0 = -inf (Spark's own gives null)."""
    return F.when(x > 0, F.ln(x)).when(x == 0, neg_inf())


def log_sum_exp(df: DataFrame, keys: Keys, x: str, out: str = "lse", carry: Sequence[str] = (), **more: Column) -> DataFrame:
    """max + ln sum exp(x - max) by group; nulls are skipped, groups of -inf alone give -inf.

    more: further aggregates by name, in the same aggregation, of x and of the columns that carry names.
    """
    keys = _keys(keys)
    top = df.groupBy(*keys).agg(F.max(x).alias("_m"))
    joined = df.select(*keys, x, *carry).join(top.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    shifted = F.when(F.col("_m") == neg_inf(), 0.0).otherwise(F.exp(F.col(x) - F.col("_m")))
    sums = joined.groupBy(*keys).agg(F.max("_m").alias("_m"), F.sum(shifted).alias("_s"), *[c.alias(n) for n, c in more.items()])
    return sums.select(*keys, F.when(F.col("_m") == neg_inf(), neg_inf()).otherwise(F.col("_m") + F.ln("_s")).alias(out), *more)


def exp_normalize(df: DataFrame, keys: Keys, x: str, out: str = "w") -> DataFrame:
    """Softmax of x by group, as a column of the rows; a group of -inf alone gives null weights."""
    keys = _keys(keys)
    total = log_sum_exp(df, keys, x, "_lse").withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    joined = df.join(total, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    value = F.when(F.col("_lse") == neg_inf(), F.lit(None)).otherwise(F.exp(F.col(x) - F.col("_lse")))
    return joined.withColumn(out, value).drop("_lse", *[f"_k{i}" for i in range(len(keys))])


def ess(df: DataFrame, keys: Keys, w: str = "w") -> DataFrame:
    """Effective sample size, its share of n, and the largest weight; w sums to one by group."""
    return df.groupBy(*_keys(keys)).agg((1 / F.sum(F.col(w) * F.col(w))).alias("ess"), F.count("*").alias("n"), F.max(w).alias("max_w")).withColumn("relative_ess", F.col("ess") / F.col("n"))


def cess(df: DataFrame, keys: Keys, w_prev: str = "w", log_incr: str = "dlog", out: str = "cess") -> DataFrame:
    """Conditional ESS over n, (sum w v)^2 / sum w v^2 with v = exp(log_incr), in (0, 1]."""
    keys = _keys(keys)
    base = df.select(*keys, (ln(F.col(w_prev)) + F.col(log_incr)).alias("_a"), (ln(F.col(w_prev)) + 2 * F.col(log_incr)).alias("_b"))
    a, b = log_sum_exp(base, keys, "_a", "_la"), log_sum_exp(base, keys, "_b", "_lb")
    return a.join(b, keys).select(*keys, F.exp(2 * F.col("_la") - F.col("_lb")).alias(out))


def lookahead_relative_ess(df: DataFrame, keys: Keys, w: str, log_lik: str, delta: float, conditional: bool = True) -> DataFrame:
    """Relative ESS that a step of delta would leave: conditional (sum W v)^2 / sum W v^2, or (sum W v)^2 / sum (W v)^2 / n."""
    keys = _keys(keys)
    top = df.groupBy(*keys).agg(F.max(log_lik).alias("_m"))
    v = F.exp(delta * (F.col(log_lik) - F.col("_m")))  # scale-free: any shift will do
    second = F.col(w) * v * v if conditional else F.col(w) * F.col(w) * v * v
    sums = df.join(top, keys).groupBy(*keys).agg(F.sum(F.col(w) * v).alias("_a"), F.sum(second).alias("_b"), F.count("*").alias("_n"))
    value = F.col("_a") * F.col("_a") / F.col("_b")
    return sums.select(*keys, (value if conditional else value / F.col("_n")).alias("relative_ess"))


def incremental_log_weight(particles: DataFrame, ladder: DataFrame, on: Keys, out: str = "dlog") -> DataFrame:
    """(beta' - beta) * log_lik at the state before the move; ladder: on, d_beta."""
    return particles.join(ladder.select(*_keys(on), "d_beta"), _keys(on)).withColumn(out, F.col("d_beta") * F.col("log_lik"))


def carry_weights(df: DataFrame, w_prev: str = "w", log_incr: str = "dlog", out: str = "log_w") -> DataFrame:
    return df.withColumn(out, ln(F.col(w_prev)) + F.col(log_incr))


def mark_dead(df: DataFrame, state: str = "state", log_w: str = "log_w") -> DataFrame:
    """A particle without a state weighs nothing."""
    return df.withColumn(log_w, F.when(F.col(state).isNull(), neg_inf()).otherwise(F.col(log_w)))


def needs_resample(stats: DataFrame, strategy: str = "ess", threshold: float = 0.5, last: Column | None = None) -> DataFrame:
    """Flag resample on rows (ess, n, any_dead): always, never, or ess < threshold * n; never on the last step."""
    rule = {"always": F.lit(True), "never": F.lit(False), "ess": F.col("ess") < threshold * F.col("n")}[strategy] | F.coalesce(F.col("any_dead"), F.lit(False))
    return stats.withColumn("resample", rule & ~(F.lit(False) if last is None else last))


def log_z_running(df: DataFrame, key: str, t: str, log_w: str) -> DataFrame:
    """Evidence increment of each generation after the first and their running sum; one row a (key, t)."""
    steps = log_sum_exp(df.where(F.col(t) > 0), [key, t], log_w, "increment")
    return steps.withColumn("log_z", F.sum("increment").over(Window.partitionBy(key).orderBy(t)))


def annealing_diagnostics(particles: DataFrame, d_beta: float, beta: float, threshold: float = 0.5) -> DataFrame:
    """One row a population after a step of d_beta from beta: ESS and CESS, largest weight, increment, resample flag.

    particles (population_id, state, log_lik, w). The shift by the maximum and all sums take two aggregations.
    """
    stepped = mark_dead(particles.withColumn("log_w", ln(F.col("w")) + d_beta * F.col("log_lik")))
    top = stepped.groupBy("population_id").agg(F.max("log_w").alias("_m"))
    v = F.when(F.col("_m") == neg_inf(), 0.0).otherwise(F.exp(F.col("log_w") - F.col("_m")))
    square = F.when(F.col("w") > 0, v * v / F.col("w")).otherwise(0.0)
    sums = stepped.join(top, "population_id").groupBy("population_id").agg(
        F.max("_m").alias("m"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"), F.sum(square).alias("c2"), F.max(v).alias("v"), F.count("*").alias("n"), F.bool_or(F.col("state").isNull()).alias("any_dead")
    )
    out = sums.select("population_id", "n", (F.col("s") * F.col("s") / F.col("s2")).alias("ess"), (F.col("s") * F.col("s") / F.col("c2")).alias("cess"), (F.col("v") / F.col("s")).alias("max_w"), (F.col("m") + F.ln("s")).alias("log_z_increment"), F.lit(beta + d_beta).alias("beta"), "any_dead")
    return needs_resample(out.withColumn("relative_ess", F.col("ess") / F.col("n")), "ess", threshold, F.col("beta") >= 1).drop("any_dead")
