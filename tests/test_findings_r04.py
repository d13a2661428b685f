"""What the fourth round's findings found."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from annealjobs.operators import adaptive, hmm, ladders
from annealjobs.plans import registry, sampler


@pytest.fixture
def bare(spark, tmp_path):
    """Two data sets of 25 and 16 sites with a text without characters, and one of that alone; the second has no number."""
    docs = [(0, "x" * 25), (1, ""), (2, "abc"), (None, "y" * 16), (16, ""), (17, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_site_ladder_of_bare_texts(spark, bare):
    """As the SQL: a text without characters is a block of no place, full from rung 0 on; data sets without a number count."""
    rows = [tuple(r) for r in registry.p1_site_ladder(spark, bare).collect()]
    assert sorted(r for r in rows if r[2] is None) == [(0, 0, None, 1.0, 1.0), (2, 0, None, 1.0, 1.0)]
    assert sorted(r[1:] for r in rows if r[0] is None) == [(1, 0, 0.285714, 0.285714), (2, 0, 0.571429, 0.285714), (3, 0, 0.857143, 0.285714), (4, 0, 1.0, 0.142857), (4, 1, 0.142857, 0.142857), (5, 1, 0.428571, 0.285714), (6, 1, 0.714286, 0.285714), (7, 1, 1.0, 0.285714)]
    assert sum(r[0] == 0 for r in rows) == 10 and len(rows) == 19


def test_states_of_bare_texts(spark, bare):
    rows = {(r.dataset_id, r.t): (r.n_full, r.block, r.psi) for r in registry.p3_classify_blocks(spark, bare).collect()}
    assert len(rows) == 24 and all(rows[2, t] == (1, -1, 0.0) for t in range(8))
    assert [rows[0, t] for t in (0, 1, 3, 7)] == [(1, -1, 0.0), (1, 0, 0.428571), (2, 1, 0.285714), (4, -1, 0.0)]
    assert rows[None, 7] == (2, -1, 0.0)


def test_what_rungs_fill_of_bare_texts(spark, bare):
    rows = {(r.dataset_id, r.t): tuple(r)[2:] for r in registry.p3_classify_diffs(spark, bare).collect()}
    assert len(rows) == 24 and [rows[2, t] for t in (0, 1)] == [(1, -1, 0, -1, 0.0), (0, -1, 0, -1, 0.0)]
    assert [rows[0, t] for t in (0, 1, 3)] == [(1, -1, 0, -1, 0.0), (0, -1, 1, 0, 0.428571), (0, -1, 2, 0, 0.428571)]
    assert rows[None, 0] == (0, -1, 0, -1, 0.0)


def test_unknown_differences_at_a_ladders_start(spark):
    """As the SQL: with no difference known yet the temperature is 1, and the ladder goes on from 0."""
    diffs = spark.createDataFrame([("a", 0, None), ("a", 1, 0.5), ("a", 2, 0.75), ("a", 3, 0.1)], "schedule_id string, t int, d_beta double")
    assert [tuple(r)[1:] for r in ladders.replay_ladder(diffs).orderBy("t").collect()] == [(0, 1.0, None), (1, 0.5, 0.5), (2, 1.0, 0.5)]
    assert [tuple(r)[1:] for r in ladders.adjacent_rungs(ladders.replay_ladder(diffs)).orderBy("t").collect()] == [(0, 1.0, 0.5, -0.5), (1, 0.5, 1.0, 0.5)]


def test_the_sampler_runs_at_its_defaults(spark, tmp_path, monkeypatch):
    """1,000 particles a population and a CESS target of 0.999, which take many generations."""
    asked, run = {}, sampler.annealed_smc
    names, of = inspect.signature(run).parameters, {}

    def kept(*args, **kwargs):
        of.update({k: v.default for k, v in names.items() if v.default is not v.empty}, **dict(zip(names, args)), **kwargs)
        asked["done"] = run(*args, **kwargs)
        return asked["done"]

    monkeypatch.setattr(sampler, "annealed_smc", kept)
    rows = [(i, f"2024-01-0{1 + i % 9} 00:00:00", i % 2, ["view", "click", "purchase", "signup", "error"][i * i % 5], 1.0) for i in range(14)] + [(14, "2024-01-01 00:00:00", None, "view", 1.0)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    out = {r.population_id: r for r in registry.k8_annealed_smc(spark, str(tmp_path)).collect()}
    assert (of["n"], of["alpha"], of["steps"]) == (1000, 0.999, None)
    assert asked["done"][0].groupBy("population_id").count().collect() and asked["done"][0].count() == 3000
    exact = {r.seq_id: r.log_z for r in registry.h4_hmm_log_evidence(spark, str(tmp_path)).collect() if r.seq_id is not None}
    assert {k: out[k].log_z for k in exact} == pytest.approx(exact, abs=0.3)


def test_steps_of_one_population_are_those_of_all(spark):
    """The solver inside tasks finds what the one over tables does: any spread, dead and weightless particles, no step at all."""
    r, inf = np.random.default_rng(7), float("inf")
    groups = {k: (-r.random(60) ** 2 * 10 ** r.uniform(-3, 3), r.dirichlet(np.ones(60))) for k in range(12)}
    groups[12] = (np.array([-1.0, -2.0, -inf, -4.0]), np.array([0.5, 0.4999, 0.0001, 0.0]))
    groups[13] = (np.array([-1.0, -2.0, -inf]), np.array([0.3, 0.3, 0.4]))
    groups[14] = (np.full(5, -3.0), np.full(5, 0.2))
    rows = [(k, float(x), float(w), 0.25) for k, (lls, ws) in groups.items() for x, w in zip(lls, ws)]
    table = spark.createDataFrame(rows, "k int, log_lik double, w double, beta double")
    for alpha in (0.999, 0.5):
        want = {x.k: x.delta for x in adaptive.next_temperature(table, "k", "beta", alpha).collect()}
        got = {k: sampler._solved(lls, ws, 0.75, alpha) for k, (lls, ws) in groups.items()}
        assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
        assert (got[13] is None) == (alpha > 0.6)
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None}, rel=1e-6)


def test_large_populations_go_over_generations_as_tables(spark, monkeypatch):
    """Both ways meet the exact evidence, from the same populations; none is lost where they part."""
    data = spark.createDataFrame([(0, [0, 1, 0]), (1, [1, 1, 1, 0])], "population_id long, data array<int>")
    seen = []
    for cells in (1 << 24, 12000, 0):
        monkeypatch.setattr(sampler, "CELLS", cells)
        done, z = sampler.annealed_smc(data, sampler.HmmKernel(hmm.TWO), n=4000, steps=[0.3, 1.0])
        seen.append({x.population_id: x.log_z for x in z.collect()})
        assert {x.population_id: (x["count"], round(x.w, 9)) for x in done.groupBy("population_id").agg(F.count("*").alias("count"), F.sum("w").alias("w")).collect()} == {0: (4000, 1.0), 1: (4000, 1.0)}
    exact = {x.seq_id: x.log_z for x in hmm.hmm_log_evidence(data.select(F.col("population_id").alias("seq_id"), F.posexplode("data").alias("pos", "obs")), hmm.TWO).collect()}
    assert all(x == pytest.approx(exact, abs=0.04) for x in seen)
