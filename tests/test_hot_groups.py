"""Operators that must not order, buffer or pair a large group in one task: against brute force, and even tasks."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annealjobs.functions import selection
from annealjobs.functions.neighbours import with_neighbours
from annealjobs.operators import experiments, hmm, summaries
from annealjobs.sources import io


@pytest.mark.parametrize("chunk", [1, 4, 1 << 16])
def test_neighbours(spark, chunk):
    r = random.Random(3)
    rows = [(k, p, r.choice([None, "a", "b", "c"])) for k in range(4) for p in sorted(r.sample(range(60), 25 if k else 1))]
    got = {(x.k, x.p): (x._before, x._after) for x in with_neighbours(spark.createDataFrame(rows, "k int, p int, v string").repartition(5), "k", "p", "v", chunk=chunk).collect()}
    want = {}
    for k, own in itertools.groupby(rows, key=lambda x: x[0]):
        own = list(own)
        for i, x in enumerate(own):
            want[k, x[1]] = (own[i - 1][2] if i else None, own[i + 1][2] if i + 1 < len(own) else None)
    assert got == want


def test_a_long_sequence_runs_in_even_tasks(spark):
    """One sequence has over half of all rows; after the shuffles no partition does."""
    long = spark.range(60_000).selectExpr("0L AS seq_id", "CAST(id AS INT) AS pos", "CAST((id * 7) % 3 AS INT) AS state", "CAST(id % 3 AS INT) AS obs")
    more = spark.range(40_000).selectExpr("1 + id % 400 AS seq_id", "CAST(id div 400 AS INT) AS pos", "CAST((id * 7) % 3 AS INT) AS state", "CAST(id % 3 AS INT) AS obs")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = hmm.hmm_local_terms(long.unionByName(more), hmm.THREE, chunk=2000)
        most = rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("log_prior").alias("s")).agg(F.max("n"), F.count("*"), F.sum("s")).first()
        assert most[0] < 45_000 and most[1] == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    prior = {r.seq_id: r.log_prior for r in hmm.hmm_log_prior(long.unionByName(more), hmm.THREE, chunk=2000).collect()}
    path = [(i * 7) % 3 for i in range(60_000)]
    assert prior[0] == pytest.approx(math.log(hmm.THREE.init[path[0]]) + sum(math.log(hmm.THREE.trans[a][b]) for a, b in itertools.pairwise(path)))


@pytest.mark.parametrize(("most", "bins"), [(10_000, 256), (20, 4), (1, 2)])
def test_quantiles(spark, most, bins):
    r = np.random.default_rng(5)
    groups = {"even": r.normal(size=300), "ties": r.integers(0, 4, 251).astype(float), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "wide": np.exp(r.normal(0, 40, 200)) * r.choice([-1, 1], 200), "equal": np.full(90, 7.0), None: r.exponential(size=77)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for q in (0.0, 0.5, 0.9, 1.0) if most > 20 else (0.5,):
        got = {x.k: (x.out, x.n) for x in selection.quantile(df, ["k"], "v", q, "out", most, bins).collect()}
        assert set(got) == set(groups)
        for k, v in groups.items():
            assert got[k][0] == pytest.approx(float(np.quantile(v, q)), rel=1e-12, abs=1e-12) and got[k][1] == len(v)


def test_scores(spark):
    rows = [("m", 1.0, "t", "x", float(v), v) for v in (5, 1, 9, 2)] + [(None, 1.0, "t", "x", 4.0, 3)]
    df = spark.createDataFrame(rows, "Method string, IterScale double, TreeName string, Metric string, Value double, Time long")
    assert {(r.Method, r["median"], r.n) for r in experiments.score_medians(df).collect()} == {("m", 3.5, 4), (None, 4.0, 1)}
    assert {(r.Method, r.mean_time, round(r.p90_time, 9), r.n) for r in experiments.timing_summary(df).collect()} == {("m", 4.25, 7.8, 4), (None, 3.0, 3.0, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_centroids(spark, seed, monkeypatch):
    monkeypatch.setattr(selection, "MOST", 5)
    r = random.Random(seed)
    rows = [(k, f"i{r.randrange(30)}x{'y' * r.randrange(9)}", r.randint(1, 9)) for k in range(6) for _ in range(40 if k else 1)]
    weight = {}
    for k, i, w in rows:
        weight[k, i] = weight.get((k, i), 0) + w
    df = spark.createDataFrame([(*k, w) for k, w in weight.items()], "k int, item string, weight long").repartition(3)
    want = {}
    for k in range(6):
        own = {i: w for (g, i), w in weight.items() if g == k}
        cost = {x: sum(w * abs(len(x) - len(y)) for y, w in own.items()) for x in own}
        want[k] = min((c, i) for i, c in cost.items())
    loss = lambda x, y: F.abs(F.length(x) - F.length(y)).cast("long")
    for out in (summaries.centroid(df, ["k"], loss), summaries.centroid(df, ["k"], loss, metric=True), summaries.centroid_on_line(df, ["k"], F.length("item"))):
        assert {x.k: (x.loss, x["item"]) for x in out.collect()} == want


def test_a_metric_drops_items_before_pairing(spark):
    df = spark.createDataFrame([(1, "a", 90.0)] + [(1, "b" * n, 0.1) for n in range(2, 60)], "k int, item string, weight double")
    out = summaries.centroid(df, ["k"], lambda x, y: F.abs(F.length(x) - F.length(y)).cast("double"), metric=True)
    assert out.first()["item"] == "a"


def test_fingerprints_count_copies(spark):
    df = spark.createDataFrame([(k, x) for k, xs in ((1, "aabb"), (2, "ccdd"), (3, "bbaa"), (4, "ab")) for x in xs] + [(5, None), (6, "-")], "k int, x string")
    got = {r.k: (r.fingerprint, r.n) for r in summaries.population_fingerprint(df, "k", ["x"]).collect()}
    assert got[1] == got[3] and len({v[0] for v in got.values()}) == 5
    parts = spark.createDataFrame([(1, "a|b", "c"), (2, "a", "b|c"), (3, "1:a", ""), (4, "", "1:a")], "k int, x string, y string")
    assert len({r.fingerprint for r in summaries.population_fingerprint(parts, "k", ["x", "y"]).collect()}) == 4


def test_fork(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 4)], "g string, s string, v int")
    got = {(r.grouping, r.g, r.s, r.total) for r in summaries.fork(df, {"g": ["g"], "s": ["s"], "all": [], "gs": ["s", "g"]}, total=F.sum("v")).collect()}
    assert got == {("g", "a", None, 3), ("g", None, None, 4), ("s", None, None, 1), ("s", None, "x", 6), ("all", None, None, 7), ("gs", "a", None, 1), ("gs", "a", "x", 2), ("gs", None, "x", 4)}
    with pytest.raises(ValueError, match="same keys"):
        summaries.fork(df, {"a": ["g"], "b": ["g"]}, n=F.count("*"))


def test_schedules_round_trip(spark, tmp_path):
    rows = [(s, t, 0.25 * t + i) for i, s in enumerate(("a", "b/c", "007", "d e", "%x", "f")) for t in range(3 + i)]
    io.write_schedule(spark.createDataFrame(rows, "schedule_id string, t int, d_beta double").repartition(4), str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("schedule_id=*/part-*.txt"))) == 6
    assert sorted(map(tuple, io.read_schedule(spark, str(tmp_path / "s"), named=True).collect())) == sorted(rows)


def test_files_larger_than_a_block(spark, tmp_path):
    """Places in a file that many tasks read: tokens of a schedule, and sites of taxa in interleaved blocks."""
    r = random.Random(1)
    lines, want = [], []
    for _ in range(2000):
        some = [r.random() for _ in range(r.randrange(4))]
        want += some
        lines.append("  ".join(map(repr, some)) + r.choice(["", " "]))
    (tmp_path / "s.txt").write_text("\n".join(lines))
    taxa = {f"t{i}": "".join(r.choices("acgt-", k=r.randint(3000, 4000))) for i in range(5)}
    blocks = ["!!NA", " MSF: 5 Type: N", "//"]
    for at in range(0, 4000, 50):
        blocks += [f"{t}  {s[at:at + 20]} {s[at + 20:at + 50]}" for t, s in taxa.items() if at < len(s)] + [""]
    (tmp_path / "a.msf").write_text("\n".join(blocks))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = [(x.t, x.d_beta) for x in io.read_schedule(spark, str(tmp_path / "s.txt")).orderBy("t").collect()]
        sites = io.read_alignments(spark, str(tmp_path / "a.msf")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(want))
    assert {(x.taxon, x.site, x.ch) for x in sites} == {(t, i, c.upper()) for t, s in taxa.items() for i, c in enumerate(s)} and len(sites) == sum(map(len, taxa.values()))
