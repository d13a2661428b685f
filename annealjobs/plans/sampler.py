"""Annealed sequential Monte Carlo over many populations, and annealed importance sampling.

The loop runs over generations and advances all populations together: each stands at its own
temperature, and those at 1 leave. A generation is: choose the step, weigh the state before the move,
resample where the effective sample size has fallen, move with the kernel of the new temperature.
Each generation is a table in the shared folder, deleted once the next one stands.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annealjobs.functions.keyed import uniform
from annealjobs.functions.logspace import log_sum_exp, neg_inf
from annealjobs.functions.scratch import forget, new_path, saved, spread
from annealjobs.operators.adaptive import MOST_PASSES, next_temperature, or_default
from annealjobs.operators.hmm import Params
from annealjobs.operators.resample import draw_counts, running_totals


class Kernel(Protocol):
    """What a model gives: blocks of particles as arrays, one generator a particle."""

    def initial(self, data: list, draws: np.ndarray) -> tuple[list, np.ndarray]: ...

    def move(self, states: list, data: list, log_lik: np.ndarray, beta: np.ndarray, draws: np.ndarray) -> tuple[list, np.ndarray]: ...


class HmmKernel:
    """Paths of a hidden Markov model: a position chosen uniformly, a state proposed, accepted on local terms."""

    draws = 3

    def __init__(self, params: Params):
        with np.errstate(divide="ignore"):
            self.init, self.trans, self.emit = (np.log(np.array(x)) for x in (params.init, params.trans, params.emit))
        # what a change of state adds to the log prior, by both neighbours (n is none), and to the log likelihood, by what is seen
        n = len(self.init)
        near = np.vstack([self.trans, self.init])[:, None] + np.hstack([self.trans, np.zeros((n, 1))]).T[None]
        with np.errstate(invalid="ignore"):
            self._near, self._seen = ((x[..., None, :] - x[..., None]).ravel() for x in (near, self.emit.T))

    def paths(self, y: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prior paths (one a row of the uniforms u, a column a position) and their log likelihoods of y, one sequence or one a row."""
        first, then = np.cumsum(np.exp(self.init))[:-1], np.cumsum(np.exp(self.trans), axis=1)[:, :-1]
        z = np.zeros(u.shape, np.int8)
        for i in range(u.shape[1]):
            z[:, i] = ((then[z[:, i - 1]] if i else first) <= u[:, i : i + 1]).sum(1)
        return z, self.emit[z, y].sum(1)

    def framed(self, z: np.ndarray) -> np.ndarray:
        """Paths with what stands for no neighbour at both ends."""
        return np.pad(z, ((0, 0), (1, 1)), constant_values=len(self.init))

    def shift(self, z: np.ndarray, y: np.ndarray, log_lik: np.ndarray, beta: np.ndarray | float, u: np.ndarray) -> None:
        """Moves framed paths (one a row) and their log likelihoods where they are; y is one sequence or one a row, u three rows of uniforms."""
        (many, width), n, flat = z.shape, len(self.init), z.reshape(-1)
        i = np.minimum((u[0] * (width - 2)).astype(np.intp), width - 3)
        at = np.arange(1, many * width, width) + i
        old, left, right = (flat.take(k).astype(np.intp) for k in (at, at - 1, at + 1))
        new = 1 - old if n == 2 else np.minimum((u[1] * n).astype(np.intp), n - 1)
        pair = old * n + new
        more = self._seen.take((y.take(i) if y.ndim == 1 else y[np.arange(many), i]) * (n * n) + pair)
        ratio = self._near.take((left * (n + 1) + right) * (n * n) + pair) + beta * more
        yes = u[2] < np.exp(np.minimum(0.0, ratio, out=ratio), out=ratio)
        flat[at] = np.where(yes, new, old)
        np.add(log_lik, more, out=log_lik, where=yes)

    def initial(self, data: list, draws: np.ndarray) -> tuple[list, np.ndarray]:
        states, lls = [None] * len(data), np.zeros(len(data))
        sizes = np.array([len(y) for y in data])
        for size in np.unique(sizes):  # paths of one length are drawn as one block
            k = np.flatnonzero(sizes == size)
            u = np.array([np.random.default_rng(int(x * 2**53)).random(size) for x in draws[k, 0]])
            z, lls[k] = self.paths(np.array([data[j] for j in k], int).reshape(u.shape), u)
            for j, path in zip(k, z.tolist()):
                states[j] = path
        return states, lls

    def move(self, states: list, data: list, log_lik: np.ndarray, beta: np.ndarray, draws: np.ndarray) -> tuple[list, np.ndarray]:
        out, lls = list(states), log_lik.copy()
        sizes = np.array([len(s) for s in states])
        for size in np.unique(sizes[sizes > 0]):  # paths of one length move as one block
            k = np.flatnonzero(sizes == size)
            z, own = self.framed(np.array([states[j] for j in k], np.int8)), lls[k]
            self.shift(z, np.array([data[j] for j in k]), own, beta[k], draws[k].T)
            lls[k] = own
            for j, path in zip(k, z[:, 1:-1].tolist()):
                out[j] = path
        return out, lls


def tempered_log_target(log_prior: str = "log_prior", log_lik: str = "log_lik", beta: str = "beta"):
    return F.col(log_prior) + F.col(beta) * F.col(log_lik)


def metropolis_accept(df: DataFrame, current: str, proposed: str, log_q: str, keys: list[str], seed: int) -> DataFrame:
    """accepted: u < min(1, exp(log_q + proposed - current)) with a keyed u; a ratio that is no number is an error."""
    r = F.col(log_q) + F.col(proposed) - F.col(current)
    accept = uniform(seed, *keys) < F.least(F.lit(1.0), F.exp(r))
    return df.withColumn("accepted", F.when(F.isnan(r), F.raise_error(F.lit("the acceptance ratio is no number")).cast("boolean")).otherwise(accept))


def _uniforms(ids: pd.DataFrame, seed: int, t: int, n: int) -> np.ndarray:
    """n uniforms a row from (seed, t, population, particle) alone: hashing by integer mixing."""
    x = (ids["population_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ids["particle_id"].to_numpy().astype(np.uint64)
    out = np.empty((len(x), n))
    for k in range(n):
        h = x + np.uint64((seed * 1_000_003 + t * 101 + k * 7 + 1) * 0xD1342543DE82EF95 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = (h >> np.uint64(11)).astype(float) / 2**53
    return out


_DONE = "population_id long, particle_id long, state array<int>, log_lik double, w double, beta double, log_z double"
_STATE = _DONE + ", data array<int>"

#: Populations of at most so many states (particles times positions) run through in the task that has them.
CELLS = 1 << 24


def _weighed(log_lik: np.ndarray, w: np.ndarray, delta: float) -> tuple[np.ndarray, float]:
    """Weights after a step, and the evidence increment."""
    top = log_lik[w > 0].max() if w.min() == 0 else log_lik.max()
    v = w * np.exp(delta * (log_lik - top))
    total = v.sum()
    return v / total, delta * top + math.log(total)


def _first_guess(x: np.ndarray, w: np.ndarray, goal: float) -> float:
    """The step at which three cumulants put -log CESS at its target; infinite where x is one value."""
    c = x - w @ x
    wcc = w * c * c
    k2, k3, k4 = (float(wcc @ x) for x in (np.ones_like(c), c, c * c))
    if not k2 > 0:
        return math.inf
    k3, k4 = k3 / k2**1.5, k4 / k2**2 - 3
    d = goal
    for _ in range(3):
        d = goal / math.sqrt(max(0.25, 1 + k3 * d + 7 / 12 * k4 * d * d))
    return d / math.sqrt(k2)


def _solved(log_lik: np.ndarray, w: np.ndarray, top: float, alpha: float, tolerance: float = 1e-9) -> float | None:
    """The step of one population, as adaptive.next_temperature finds it for all: Newton steps on sqrt(-log CESS) inside a bracket."""
    most, least = log_lik.max(), log_lik.min()
    if not most > -np.inf or np.isnan(least):
        return None
    x = log_lik - most
    if least == -np.inf or not w.min() > 0:
        alive = (w > 0) & (log_lik > -np.inf)
        x, w = log_lik[alive] - most, w[alive]
    if not (whole := float(w.sum())) > 0:
        return None
    goal, slack = math.sqrt(-math.log(alpha)), tolerance * (1 - alpha)
    lo, hi, ended = 0.0, top, False
    at = min(_first_guess(x, w / whole, goal), top)
    for _ in range(MOST_PASSES):
        v = np.exp(at * x)
        wv = w * v
        a, b = float(w @ v), float(wv @ v)
        r = a * a / b
        if at == top:
            if r >= alpha:
                return top
            if whole <= alpha + slack:  # the dead alone are too many
                return None
            ended = True
        elif abs(r - alpha) <= slack or hi - lo <= hi * 1e-15:
            return at
        lo, hi = (at, hi) if r >= alpha else (lo, at)
        s, slope = math.sqrt(max(0.0, -math.log(max(r, 1e-300)))), 2 * float(wv @ (v * x)) / b - 2 * float(wv @ x) / a
        newton = at - (s - goal) * 2 * s / slope if r < 1 and slope > 0 else hi
        if newton >= hi and hi == top and not ended:
            at = top
        elif lo < newton < hi:
            at = newton
        else:
            at = math.sqrt(lo * hi) if lo > 0 else hi / 16
    return None


def _run_through(kernel: HmmKernel, y: np.ndarray, n: int, alpha: float, again: Callable[[float], bool], steps: list[float] | None, most: int, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(states, log likelihoods, weights, temperature, log_z) of one population after its generations, as annealed_smc describes them."""
    z, log_lik = kernel.paths(y, r.random((n, len(y))))
    z, w, beta, log_z, t = kernel.framed(z), np.full(n, 1 / n), 0.0, 0.0, 0
    while beta < 1 and t < most:
        delta = min(1.0, steps[t]) - beta if steps is not None else _solved(log_lik, w, 1 - beta, alpha)
        delta = 1 / most if delta is None else delta
        w, more = _weighed(log_lik, w, delta)
        log_z += more
        t, beta = t + 1, 1.0 if beta + delta > 1 - 1e-12 else beta + delta
        if beta < 1 and again(1 / (w @ w)):
            ends = np.cumsum(w)
            kept = np.searchsorted(ends, np.sort(r.random(n)) * ends[-1], "right")
            z, log_lik, w = z[kept], log_lik[kept], np.full(n, 1 / n)
        if len(y):
            kernel.shift(z, y, log_lik, beta, r.random((kernel.draws, n)))
    return z[:, 1:-1], log_lik, w, beta, log_z


def annealed_smc(populations: DataFrame, kernel: HmmKernel, n: int = 1000, alpha: float = 0.999, ess: float = 0.5, strategy: str = "ess", steps: list[float] | None = None, seed: int = 1, most_generations: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Weighted particles at temperature 1, and (population_id, log_z), of populations (population_id, data array<int>).

    Populations of up to CELLS states run through inside tasks, many a task, as one knows nothing of another; larger
    ones go over generations as tables, so that no task holds them.

    steps: a fixed ladder's temperatures after 0, the last of them 1; else each population's step is solved
    for CESS = alpha, or is 1 / most_generations where no step solves it. strategy: always, never (annealed
    importance sampling) or ess (below ess * n). Nothing is resampled on a population's last step. Results
    do not depend on partitioning. Populations that are not done after most_generations are an error.
    """
    if steps is not None and (not steps or steps[-1] < 1):
        raise ValueError("the last of the steps must be 1")

    most = min(most_generations, len(steps or []) or most_generations)
    again = {"always": lambda e: True, "never": lambda e: False, "ess": lambda e: e < ess * n}[strategy]
    spark = populations.sparkSession
    given, path = new_path(spark, "populations"), new_path(spark, "done")
    populations = saved(populations.select(F.col("population_id").cast("long").alias("population_id"), F.col("data").cast("array<int>").alias("data")), "populations", given)
    fits = F.coalesce(F.size("data"), F.lit(0)) * F.lit(n).cast("long") <= CELLS

    def through(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, y in zip(b["population_id"].to_pylist(), b["data"].to_pylist()):
                r = np.random.default_rng([seed, 1] if k is None else [seed, 0, k % 2**64])
                z, lls, w, beta, log_z = _run_through(kernel, np.array(y, np.intp), n, alpha, again, steps, most, r)
                states = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(y), z.astype(np.int32).ravel())
                columns = [pa.array([k] * n, pa.int64()), np.arange(n), states, lls, w, np.full(n, beta), np.full(n, log_z)]
                yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["population_id", "particle_id", "state", "log_lik", "w", "beta", "log_z"])

    spread(populations.where(fits), "population_id").mapInArrow(through, _DONE).write.parquet(path)
    if not spark.read.schema(_DONE).parquet(path).where("beta < 1").isEmpty():
        raise RuntimeError(f"populations are under temperature 1 after {most} generations")

    def draw(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            states, lls = kernel.initial(b["data"].tolist(), _uniforms(b, seed, 0, 1))
            yield pd.DataFrame({"population_id": b.population_id, "particle_id": b.particle_id, "state": states, "log_lik": lls, "w": 1.0 / n, "beta": 0.0, "log_z": 0.0, "data": b["data"]})

    slots = populations.where(~fits).select("population_id", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("particle_id"))
    here, t = new_path(spark, "live"), 0
    live = saved(spread(slots, "population_id", "particle_id").mapInPandas(draw, _STATE), "live", here)
    while not live.isEmpty():
        t += 1
        if t > most:
            raise RuntimeError(f"populations are under temperature 1 after {t - 1} generations")
        if steps is not None:
            delta = live.groupBy("population_id").agg((F.least(F.lit(1.0), F.lit(float(steps[t - 1]))) - F.max("beta")).alias("delta"))
        else:
            delta = or_default(next_temperature(live, "population_id", "beta", alpha), most_generations)
        weighed = live.join(delta, "population_id").withColumn("_lw", F.when(F.col("w") > 0, F.ln("w")).otherwise(neg_inf()) + F.col("delta") * F.col("log_lik"))
        total = log_sum_exp(weighed, "population_id", "_lw", "_lse")
        weighed = weighed.join(total, "population_id").withColumn("w", F.exp(F.col("_lw") - F.col("_lse"))).withColumn("log_z", F.col("log_z") + F.col("_lse"))
        weighed = weighed.withColumn("beta", F.when(F.col("beta") + F.col("delta") > 1 - 1e-12, 1.0).otherwise(F.col("beta") + F.col("delta"))).drop("delta", "_lw", "_lse")
        weighed = saved(weighed, "weighed", between := new_path(spark, "weighed"))
        sizes = weighed.groupBy("population_id").agg((1 / F.sum(F.col("w") * F.col("w"))).alias("_e"), F.max("beta").alias("_b"))
        few = {"always": F.lit(True), "never": F.lit(False), "ess": F.col("_e") < ess * n}[strategy]
        fallen = sizes.where((F.col("_b") < 1) & few).select("population_id")
        counts = draw_counts(weighed.join(fallen, "population_id", "left_semi"), "population_id", seed * 7919 + t)
        # copies of a particle are numbered after those of all particles before it
        places = running_totals(counts, "population_id", "particle_id", "count").select("population_id", "particle_id", "count", "_before")
        copies = weighed.drop("w").join(places, ["population_id", "particle_id"]).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
        copies = copies.withColumn("particle_id", F.col("_before") + F.col("_c")).withColumn("w", F.lit(1.0 / n))
        kept = weighed.join(fallen, "population_id", "left_anti")
        mixed = kept.unionByName(copies.select(kept.columns))

        def move(batches: Iterable[pd.DataFrame], t: int = t) -> Iterator[pd.DataFrame]:
            for b in batches:
                states, lls = kernel.move(b["state"].tolist(), b["data"].tolist(), b["log_lik"].to_numpy(), b["beta"].to_numpy(), _uniforms(b, seed, t, kernel.draws))
                yield b.assign(state=states, log_lik=lls)

        after = new_path(spark, "live")
        moved = saved(mixed.select("population_id", "particle_id", "state", "log_lik", "w", "beta", "log_z", "data").mapInPandas(move, _STATE), "live", after)
        forget(spark, here), forget(spark, between)
        here = after
        moved.where("beta >= 1").drop("data").write.mode("append").parquet(path)
        live = moved.where("beta < 1")
    forget(spark, here), forget(spark, given)
    done = spark.read.schema(_DONE).parquet(path)
    return done, done.groupBy("population_id").agg(F.max("log_z").alias("log_z"))


def annealed_importance_sampling(populations: DataFrame, kernel: HmmKernel, n: int, steps: list[float], seed: int = 1) -> DataFrame:
    """(population_id, log_z) without resampling."""
    return annealed_smc(populations, kernel, n, strategy="never", steps=steps, seed=seed)[1]


def path_evidence(paths: DataFrame, key: str, path: str, increment: str) -> DataFrame:
    """log Z from a table of paths' increments: LSE of each path's sum, less ln of their number."""
    sums = paths.groupBy(key, path).agg(F.sum(increment).alias("_s"))
    lse = log_sum_exp(sums, key, "_s", "_lse").join(sums.groupBy(key).agg(F.count("*").alias("_n")), key)
    return lse.select(key, (F.col("_lse") - F.ln("_n")).alias("log_z"))
