"""Hidden Markov models over many sequences: densities of paths, exact evidence and marginals."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annealjobs.functions.keyed import uniform
from annealjobs.functions.neighbours import CHUNK as ORDERED
from annealjobs.functions.neighbours import with_neighbours

Matrix = tuple[tuple[float, ...], ...]
#: Positions of a sequence that one row gathers.
CHUNK = 4096


@dataclass(frozen=True)
class Params:
    """Small dense parameters; they are literals of the plan."""

    init: tuple[float, ...]
    trans: Matrix
    emit: Matrix

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        rows = {"init": [(s, float(p)) for s, p in enumerate(self.init)]}
        rows |= {k: [(i, j, float(p)) for i, row in enumerate(m) for j, p in enumerate(row)] for k, m in (("trans", self.trans), ("emit", self.emit))}
        return spark.createDataFrame(rows[kind], {"init": "s int, p double", "trans": "i int, j int, p double", "emit": "s int, o int, p double"}[kind])


# Fixed values of the models.
TWO = Params((0.2, 0.8), ((0.1, 0.9), (0.6, 0.4)), ((0.1, 0.9), (0.6, 0.4)))
_THREE = ((0.8, 0.15, 0.05), (0.02, 0.93, 0.05), (0.15, 0.15, 0.7))
THREE = Params((0.25, 0.25, 0.5), _THREE, _THREE)


def valley(epsilon: float = 0.01) -> Params:
    """Five states in a band, with a state of low probability in the middle."""
    if epsilon >= 1:
        raise ValueError("epsilon must be under 1")
    band = [[float(abs(i - j) < 2) for j in range(5)] for i in range(5)]
    emit = {0: 0.2, 1: 0.1, 2: epsilon, 3: 0.2, 4: 0.3}
    return Params((0.2,) * 5, tuple(tuple(x / sum(r) for x in r) for r in band), tuple((emit[s], 1 - emit[s]) for s in range(5)))


def transition_table(spark: SparkSession, params: Params) -> DataFrame:
    """(i, j, p), each row normalised by a window over i."""
    raw = params.table(spark, "trans")
    return raw.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("i")))


def _look(m: Matrix, row: Column, column: Column) -> Column:
    """ln of a matrix entry by two state columns, out of a literal."""
    flat = F.array(*[F.lit(math.log(x) if x > 0 else -math.inf) for r in m for x in r])
    return F.element_at(flat, (row * len(m[0]) + column + 1).cast("int"))


def hmm_log_likelihood(paths: DataFrame, params: Params) -> DataFrame:
    """(seq_id, log_lik) of paths (seq_id, pos, state, obs)."""
    return paths.groupBy("seq_id").agg(F.sum(_look(params.emit, F.col("state"), F.col("obs"))).alias("log_lik"))


def _entering(params: Params) -> Column:
    """ln of the probability of a state after the one before (_before), or as the first."""
    first = _look((params.init,), F.lit(0), F.col("state"))
    return F.when(F.col("_before").isNull(), first).otherwise(_look(params.trans, F.col("_before"), F.col("state")))


def hmm_log_prior(paths: DataFrame, params: Params, chunk: int = ORDERED) -> DataFrame:
    rows = with_neighbours(paths, "seq_id", "pos", "state", chunk=chunk)
    return rows.groupBy("seq_id").agg(F.sum(_entering(params)).alias("log_prior"))


def hmm_local_terms(paths: DataFrame, params: Params, chunk: int = ORDERED) -> DataFrame:
    """(seq_id, pos, log_lik, log_prior): the terms of the densities that hold the position."""
    rows = with_neighbours(paths, "seq_id", "pos", "state", chunk=chunk)
    right = F.when(F.col("_after").isNull(), 0.0).otherwise(_look(params.trans, F.col("state"), F.col("_after")))
    return rows.select("seq_id", "pos", _look(params.emit, F.col("state"), F.col("obs")).alias("log_lik"), (_entering(params) + right).alias("log_prior"))


def score_steps(seqs: DataFrame, table: DataFrame, least: float = 1e-9, chunk: int = ORDERED) -> DataFrame:
    """(seq_id, score): sum of ln p over steps between symbols that follow one another; table (i, j, p), small; p of 0 counts as least."""
    rows = with_neighbours(seqs, "seq_id", "pos", "obs", chunk=chunk)
    steps = rows.where("_after IS NOT NULL").select("seq_id", F.col("obs").alias("i"), F.col("_after").alias("j")).join(F.broadcast(table), ["i", "j"])
    return steps.groupBy("seq_id").agg(F.sum(F.ln(F.when(F.col("p") > 0, F.col("p")).otherwise(least))).alias("score"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _times(acc: Column, m: Column, ll: Column, rows: int, k: int) -> Column:
    """struct(m, ll): acc, rows x k, times a k x k matrix (flat arrays, with ln of their scales), scaled to sum to 1."""
    cells = F.array(*[sum((acc["m"][i * k + x] * m[x * k + j] for x in range(1, k)), acc["m"][i * k] * m[j]) for i in range(rows) for j in range(k)])
    scaled = lambda c: F.transform(c["c"], lambda x: x / F.when(c["t"] > 0, c["t"]).otherwise(1.0))
    scale = lambda c: F.when(c["t"] > 0, acc["ll"] + ll + F.ln(c["t"])).otherwise(F.lit(-math.inf))
    total = lambda c: F.struct(c.alias("c"), F.aggregate(c, F.lit(0.0), lambda a, x: a + x).alias("t"))
    return _let(cells, lambda c: _let(total(c), lambda s: F.struct(scaled(s).alias("m"), scale(s).alias("ll"))))


def _literal(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def _start(params: Params) -> Column:
    return F.struct(F.array(*[F.lit(float(p)) for p in params.init]).alias("m"), F.lit(0.0).alias("ll"))


def _product(c: Column, obs: Column, params: Params, pos: int = -1, state: int = -1) -> Column:
    """struct(m, ll) of a chunk's observations [(pos, obs)]: what they do to forward sums; the state at pos is held fixed.

    The first chunk (c = 0) starts from the initial distribution and is a vector of forward sums, any other a matrix.
    """
    k = len(params.init)
    one = F.struct(F.array(*[F.lit(float(i == j)) for i in range(k) for j in range(k)]).alias("m"), F.lit(0.0).alias("ll"))
    each = [[[params.emit[i][o] * params.trans[i][j] for i in range(k) for j in range(k)] for o in range(len(params.emit[0]))]]
    each.append([[x if i // k == state else 0.0 for i, x in enumerate(row)] for row in each[0]])

    def folded(start: Column, rows: int) -> Column:
        def step(acc: Column, o: Column) -> Column:
            at = (o["obs"] + 1).cast("int")
            free = F.element_at(_literal(each[0]), at)
            own = free if pos < 0 else F.when(o["pos"] == pos, F.element_at(_literal(each[1]), at)).otherwise(free)
            return _let(own, lambda m: _times(acc, m, F.lit(0.0), rows, k))

        return F.aggregate(obs, start, step)

    return F.when(c == 0, folded(_start(params), 1)).otherwise(folded(one, k))


def _log_total(parts: Column, params: Params) -> Column:
    """ln of the probability of all observations, from the products of consecutive chunks [(c, m, ll)]."""
    k = len(params.init)
    first = F.when(parts[0]["c"] == 0, F.struct(parts[0]["m"].alias("m"), parts[0]["ll"].alias("ll"))).otherwise(_start(params))
    return F.aggregate(F.filter(parts, lambda x: x["c"] != 0), first, lambda acc, x: _times(acc, x["m"], x["ll"], 1, k), lambda acc: acc["ll"])


def _chunks(seqs: DataFrame, chunk: int) -> DataFrame:
    rows = seqs.groupBy("seq_id", F.floor(F.col("pos") / chunk).alias("c"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("pos", "obs"))).alias("o"))


def hmm_log_evidence(seqs: DataFrame, params: Params, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, log_z): exact, of sequences (seq_id, pos, obs) of any length.

    The first chunk of positions is folded into forward sums and any other reduced to one small matrix; a sequence's
    are multiplied in order. Rows of the transition matrix sum to one, so that the step after the last
    observation changes nothing.
    """
    parts = _chunks(seqs, chunk).select("seq_id", F.struct("c", _product(F.col("c"), F.col("o"), params).alias("p")).alias("x")).select("seq_id", F.struct("x.c", "x.p.m", "x.p.ll").alias("x"))
    return parts.groupBy("seq_id").agg(_log_total(F.array_sort(F.collect_list("x")), params).alias("log_z"))


def hmm_marginal(seqs: DataFrame, params: Params, pos: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, state, p): exact posterior of the state at a position."""
    k, here = len(params.init), F.col("c") == pos // chunk
    free = _chunks(seqs, chunk).withColumn("p", _product(F.col("c"), F.col("o"), params))
    held = [F.when(here, _product(F.col("c"), F.col("o"), params, pos, s)).otherwise(F.col("p")).alias(f"p{s}") for s in range(k)]
    rows = free.select("seq_id", "c", "p", *held)
    ordered = lambda p: F.array_sort(F.collect_list(F.struct("c", F.col(f"{p}.m").alias("m"), F.col(f"{p}.ll").alias("ll"))))
    totals = rows.groupBy("seq_id").agg(_log_total(ordered("p"), params).alias("_z"), *[_log_total(ordered(f"p{s}"), params).alias(f"_z{s}") for s in range(k)])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"_z{s}").alias("ll")) for s in range(k)])).alias("x")
    return totals.select("seq_id", "_z", each).select("seq_id", "x.state", F.exp(F.col("x.ll") - F.col("_z")).alias("p"))


def particle_marginal(particles: DataFrame, key: str, state: Column, value: object, w: str = "w") -> DataFrame:
    return particles.groupBy(key).agg(F.sum(F.when(state == value, F.col(w)).otherwise(0.0)).alias("p"))


def _draw(row: Column, u: Column, k: int) -> Column:
    """Inverse cdf over the first k entries of an array column."""
    out, total = F.lit(k - 1), None
    sums = []
    for i in range(k):
        total = row[i] if total is None else total + row[i]
        sums.append(total)
    for i in reversed(range(k - 1)):
        out = F.when(u < sums[i], i).otherwise(out)
    return out.cast("int")


def draw_prior_paths(spark: SparkSession, n: int, length: int, params: Params, seed: int = 1) -> DataFrame:
    """(seq_id, pos, state, obs): n paths from the prior and emitted observations, from keyed uniforms."""
    k, m = len(params.init), len(params.emit[0])
    lit = lambda rows: F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])
    ids = spark.range(n).select(F.col("id").alias("seq_id"))
    us = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.struct(i.alias("pos"), uniform(seed, F.col("seq_id"), i, F.lit("z")).alias("u"), uniform(seed, F.col("seq_id"), i, F.lit("y")).alias("v")))
    start = F.array().cast("array<struct<pos:int,state:int,obs:int>>")

    def step(acc: Column, x: Column) -> Column:
        row = F.when(F.size(acc) == 0, F.array(*[F.lit(float(p)) for p in params.init])).otherwise(F.element_at(lit(params.trans), F.coalesce(F.try_element_at(acc, F.lit(-1))["state"], F.lit(0)) + 1))
        state = _draw(row, x["u"], k)
        obs = _draw(F.element_at(lit(params.emit), state + 1), x["v"], m)
        return F.concat(acc, F.array(F.struct(x["pos"].cast("int").alias("pos"), state.alias("state"), obs.alias("obs"))))

    return ids.select("seq_id", F.explode(F.aggregate(us, start, step)).alias("x")).select("seq_id", "x.*")
