"""The next temperature: the step at which the (conditional) effective sample size falls to its target."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annealjobs.functions.scratch import cut, forget, new_path, saved

#: Passes after which a population counts as one that no step solves.
MOST_PASSES = 100


def _relative(mode: str) -> Column:
    """From sums a = sum w v, b (see cess_profile), and the count n; a conditional or plain relative ESS."""
    value = F.col("_a") * F.col("_a") / F.col("_b")
    return value if mode == "cess" else value / F.col("_n")


def cess_profile(particles: DataFrame, key: str, grid: DataFrame, mode: str = "cess") -> DataFrame:
    """(key, delta, cess) of particles (key, log_lik, w) at each delta of the grid (delta), or of grid (key, delta).

    One aggregation over particles x candidates; scale-free, so each population is shifted by its maximum. A
    grid of deltas alone is short and goes to every task; one by key is joined by it.
    """
    top = particles.groupBy(key).agg(F.max("log_lik").alias("_m"))
    rows = particles.select(key, "log_lik", "w").join(top, key)
    steps = rows.join(grid, key) if key in grid.columns else rows.crossJoin(F.broadcast(grid))
    v = F.exp(F.col("delta") * (F.col("log_lik") - F.col("_m")))
    second = F.col("w") * v * v if mode == "cess" else F.col("w") * F.col("w") * v * v
    sums = steps.groupBy(key, "delta").agg(F.sum(F.col("w") * v).alias("_a"), F.sum(second).alias("_b"), F.count("*").alias("_n"))
    return sums.select(key, "delta", _relative(mode).alias("cess"))


def _second(mode: str) -> Column:
    """What the squares of v are weighted by."""
    return F.col("w") if mode == "cess" else F.col("w") * F.col("w")


def _first_cells(rows: DataFrame, key: str, start: DataFrame, mode: str, alpha: float, cells: int) -> DataFrame:
    """start with lo and hi: the first of equal cells of (0, top] at whose end the objective is under its target."""
    ends = F.explode(F.sequence(F.lit(1), F.lit(cells))).alias("_k")
    v = F.exp(F.col("top") * F.col("_k") / cells * F.col("x"))
    live = rows.drop("top").join(start.where("NOT done").select(key, "top", "scale"), key).select(key, "w", "x", "top", "scale", ends)
    sums = live.groupBy(key, "_k", "scale").agg(F.sum(F.col("w") * v).alias("a"), F.sum(_second(mode) * v * v).alias("b"))
    first = sums.where(F.col("a") * F.col("a") / F.col("b") / F.col("scale") < alpha).groupBy(key).agg(F.min("_k").alias("_k"))
    out = start.join(first, key, "left").withColumn("_k", F.coalesce("_k", F.lit(cells)))
    return out.withColumn("lo", F.col("top") * (F.col("_k") - 1) / cells).withColumn("hi", F.col("top") * F.col("_k") / cells).drop("_k")


def next_temperature(particles: DataFrame, key: str, beta: Column | str, alpha: float = 0.999, mode: str = "cess", default: float | None = None, tolerance: float = 1e-9, cells: int = 32) -> DataFrame:
    """(key, delta): the step from beta (a column of particles, one value a population) to the target, at most 1 - beta.

    mode cess: CESS = alpha; mode ess: ESS = alpha times the ESS now. The root is found for all populations
    together, by Newton steps on the square root of minus the log of the objective, which is close to
    linear in the step, kept inside a bracket; a pass is one aggregation over the particles of populations
    that are still open, and ends a population's search once the objective is within tolerance * (1 - alpha)
    of its target. CESS only falls with the step; ESS may cross its target more than once, and then the first of
    `cells` equal cells of the way that ends under it is searched. All the way if the target holds at
    beta = 1; default where no step solves it: dead particles (log_lik -inf) alone take the objective to its
    target (within that tolerance) or under it, a log_lik or weight is no number, or MOST_PASSES did not do.
    """
    spark = particles.sparkSession
    goal, slack = math.sqrt(-math.log(alpha)), tolerance * (1 - alpha)
    beta = F.col(beta) if isinstance(beta, str) else beta
    kept = particles.select(key, "log_lik", "w", beta.alias("_beta"))
    tops = kept.groupBy(key).agg(F.max("log_lik").alias("_m"), (1 - F.max("_beta")).alias("top"))
    dead = (F.col("log_lik") == float("-inf")) | (F.col("w") == 0)
    path = new_path(spark, "particles")
    rows = saved(kept.where(~dead).join(tops, key).select(key, "w", (F.col("log_lik") - F.col("_m")).alias("x"), "top"), "particles", path)

    x, w, v = F.col("x"), F.col("w"), F.exp(F.col("top") * F.col("x"))
    now = F.lit(1.0) if mode == "cess" else 1 / F.when(F.sum(w * w) > 0, F.sum(w * w))
    whole = kept.groupBy(key).agg(now.alias("scale"), (1 - F.max("_beta")).alias("top"), F.count_if(F.isnan("log_lik") | F.isnan("w") | F.col("log_lik").isNull() | F.col("w").isNull()).alias("_odd"))
    alive = rows.groupBy(key).agg(F.sum(w).alias("s"), F.sum(_second(mode)).alias("s2"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"), F.sum(w * v).alias("a"), F.sum(_second(mode) * v * v).alias("b"))
    end, zero = F.col("a") * F.col("a") / F.col("b") / F.col("scale"), F.col("s") * F.col("s") / F.col("s2") / F.col("scale")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("sxx") / F.col("s") - F.pow(F.col("sx") / F.col("s"), F.lit(2.0))))
    fails = F.coalesce((F.col("_odd") > 0) | F.isnan(end) | (zero <= alpha + slack) & (end < alpha), F.lit(True))
    start = whole.join(alive, key, "left").select(key, "top", "scale", F.when(~fails & (end >= alpha), F.col("top")).alias("delta"), (fails | (end >= alpha)).alias("done"), F.lit(0.0).alias("lo"), F.col("top").alias("hi"), (math.sqrt(-math.log(alpha)) / F.when(sd > 0, sd)).alias("guess"))
    if mode == "ess":
        start = _first_cells(rows, key, cut(start), mode, alpha, cells)
    inside = lambda g: F.when((g > F.col("lo")) & (g < F.col("hi")), g).otherwise(F.when(F.col("lo") > 0, F.sqrt(F.col("lo") * F.col("hi"))).otherwise(F.col("hi") / 16))
    state = cut(start.select(key, "top", "scale", "delta", "done", "lo", "hi", inside(F.col("guess")).alias("at")))

    done = state.where("done")
    for _ in range(MOST_PASSES):
        open_ = state.where("NOT done")
        if open_.isEmpty():
            break
        v = F.exp(F.col("at") * x)
        sums = rows.select(key, "w", "x").join(open_.select(key, "at"), key).groupBy(key).agg(F.sum(w * v).alias("a"), F.sum(_second(mode) * v * v).alias("b"), F.sum(w * v * x).alias("da"), F.sum(2 * _second(mode) * v * v * x).alias("db"))
        found = open_.join(sums, key).withColumn("r", F.col("a") * F.col("a") / F.col("b") / F.col("scale"))
        found = found.withColumn("lo", F.when(F.col("r") >= alpha, F.col("at")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("r") >= alpha, F.col("hi")).otherwise(F.col("at")))
        s, slope = F.sqrt(-F.ln("r")), F.col("db") / F.col("b") - 2 * F.col("da") / F.col("a")
        newton = F.when((F.col("r") < 1) & (slope > 0), F.col("at") - (s - goal) * 2 * s / slope)
        near = F.abs(F.col("r") - alpha) <= slack
        exact = F.col("hi") - F.col("lo") <= F.col("hi") * 1e-15  # no number in between
        found = found.select(key, "top", "scale", F.when(near | exact, F.col("at")).alias("delta"), (near | exact).alias("done"), "lo", "hi", inside(newton).alias("at"))
        state = cut(found)
        done = done.unionByName(state.where("done"))
    out = cut(done.select(key, "delta").unionByName(state.where("NOT done").select(key, F.lit(None).cast("double").alias("delta"))))
    forget(spark, path)
    return out.select(key, F.coalesce("delta", F.lit(default)).alias("delta"))


def or_default(steps: DataFrame, n_annealing: int) -> DataFrame:
    """Where the solver gave nothing, an equal step."""
    return steps.withColumn("delta", F.coalesce("delta", F.lit(1.0 / n_annealing)))
