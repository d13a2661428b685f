"""Golden values, metamorphic relations and brute force for the annealing jobs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annealjobs.functions import logspace as lw
from annealjobs.operators import adaptive, evidence, hmm, ladders, resample, trees
from annealjobs.plans import sampler
from annealjobs.sources import io

GOLDEN = [
    (hmm.TWO, (0, 0), 0.155, 0.07096774193548389), (hmm.TWO, (0, 1, 0), 0.16875, 0.01866666666666667), (hmm.TWO, (1, 1, 1), 0.16625, 0.31669172932330825), (hmm.TWO, (0, 1, 1, 0, 0), 0.022809375, 0.03802712700369915),
    (hmm.THREE, (0, 0), 0.1474105, 0.8825694234806882), (hmm.THREE, (0, 1, 0), 0.02066264895, 0.8289638971967338), (hmm.THREE, (1, 1, 1), 0.1942534332, 0.030146339776505927),
]


@pytest.mark.parametrize(("params", "obs", "z", "p0"), GOLDEN)
def test_hmm_golden(spark, params, obs, z, p0):
    seqs = spark.createDataFrame([(1, i, o) for i, o in enumerate(obs)], "seq_id long, pos int, obs int")
    assert math.exp(hmm.hmm_log_evidence(seqs, params).first().log_z) == pytest.approx(z, rel=1e-12)
    marginal = {r.state: r.p for r in hmm.hmm_marginal(seqs, params).collect()}
    assert marginal[0] == pytest.approx(p0, rel=1e-9) and sum(marginal.values()) == pytest.approx(1)
    # and by enumeration of all paths
    k, total = len(params.init), 0.0
    for path in itertools.product(range(k), repeat=len(obs)):
        p = params.init[path[0]]
        for a, b in itertools.pairwise(path):
            p *= params.trans[a][b]
        total += p * math.prod(params.emit[s][o] for s, o in zip(path, obs))
    assert total == pytest.approx(z, rel=1e-9)


def test_long_sequences_do_not_underflow(spark):
    seqs = spark.range(3000).select(F.lit(1).alias("seq_id"), F.col("id").cast("int").alias("pos"), (F.col("id") % 2).cast("int").alias("obs"))
    assert -5000 < hmm.hmm_log_evidence(seqs, hmm.TWO).first().log_z < -1000


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_chunks_of_a_sequence_give_the_same(spark, chunk):
    r = random.Random(2)
    rows = [(i, p, r.randrange(3)) for i, n in enumerate((1, 2, 3, 50, 7)) for p in range(n)]
    seqs = spark.createDataFrame(rows, "seq_id long, pos int, obs int").repartition(3)
    z = {x.seq_id: x.log_z for x in hmm.hmm_log_evidence(seqs, hmm.THREE, chunk).collect()}
    marginal = {(x.seq_id, x.state): x.p for x in hmm.hmm_marginal(seqs, hmm.THREE, 0, chunk).collect()}
    t, e = np.array(hmm.THREE.trans), np.array(hmm.THREE.emit)
    for i in range(5):
        obs = [o for j, _, o in rows if j == i]
        back = np.ones(3)
        for o in reversed(obs[1:]):
            back = t @ (e[:, o] * back)
        joint = np.array(hmm.THREE.init) * e[:, obs[0]] * back
        assert z[i] == pytest.approx(math.log(joint.sum())) and [marginal[i, s] for s in range(3)] == pytest.approx((joint / joint.sum()).tolist())


def test_log_sum_exp_edges(spark):
    inf = float("-inf")
    rows = [(1, 0.0), (1, 1.0), (2, inf), (2, inf), (3, -1e6), (3, -1e6), (4, None), (None, 2.0), (5, inf), (5, 3.0)]
    df = spark.createDataFrame(rows, "k int, x double")
    got = {r.k: r.lse for r in lw.log_sum_exp(df, "k", "x").collect()}
    assert got[1] == pytest.approx(math.log(1 + math.e)) and got[2] == inf and got[3] == pytest.approx(-1e6 + math.log(2)) and got[None] == 2.0 and got[5] == 3.0 and got[4] is None
    shifted = {r.k: r.lse for r in lw.log_sum_exp(df.withColumn("x", F.col("x") + 7), "k", "x").collect()}
    assert shifted[1] == pytest.approx(got[1] + 7)
    weights = lw.exp_normalize(df.where("k IN (1, 2)"), "k", "x").collect()
    assert sum(r.w for r in weights if r.k == 1) == pytest.approx(1) and all(r.w is None for r in weights if r.k == 2)


def particles(spark, n=400, populations=3, parts=4):
    r = random.Random(5)
    rows = [(p, i, "s", -r.random() * 20, r.random()) for p in range(populations) for i in range(n)]
    total = {p: sum(x[4] for x in rows if x[0] == p) for p in range(populations)}
    return spark.createDataFrame([(*x[:4], x[4] / total[x[0]]) for x in rows], "population_id long, particle_id long, state string, log_lik double, w double").repartition(parts)


def test_diagnostics_are_within_bounds(spark):
    for r in lw.annealing_diagnostics(particles(spark), 0.3, 0.2).collect():
        assert 1 <= r.ess <= r.n and 0 < r.cess <= 1
    dead = particles(spark).withColumn("state", F.when(F.col("particle_id") > 3, F.col("state")))
    assert all(r.resample for r in lw.annealing_diagnostics(dead, 0.3, 0.2).collect())


def test_ladders(spark):
    for ladder in (ladders.ladder_linear(spark, 10), ladders.ladder_power(spark, 10), ladders.ladder_beta(spark, 10), ladders.ladder_even(spark, 10)):
        rows = ladder.orderBy("t").collect()
        assert rows[0].beta == 0 and rows[-1].beta == 1 and sum(r.d_beta for r in rows) == pytest.approx(1)
    assert ladders.ladder_beta_open(spark, 10).agg(F.max("beta")).first()[0] < 1
    targets = [r.target for r in ladders.target_alpha(spark, 5, "geometric", 0.9).orderBy("t").collect()]
    a, want = 0.9, []
    for t in range(5):
        a += 0.5 * 0.1**2 * 0.9**t
        want.append(a)
    assert targets == pytest.approx(want)


@pytest.mark.parametrize(("n", "chunk"), [(5, 4096), (1, 4096), (1000, 7), (23, 1)])
def test_sparse_ramps(spark, monkeypatch, n, chunk):
    """Rows where ramps change, as many as blocks and rungs; what is between follows from them."""
    monkeypatch.setattr(ladders, "CHUNK", chunk)
    betas = [0.0, 0.1, 0.1, 0.35, 0.34, 0.9, 1.0]
    ladder = spark.createDataFrame([("s", t, b) for t, b in enumerate(betas)], "schedule_id string, t int, beta double")
    dense = lambda b, k: max(0.0, min(1.0, b * n - k))
    want = {(t, k): (dense(b, k), dense(b, k) - (dense(betas[t - 1], k) if t else 0.0)) for t, b in enumerate(betas) for k in range(n)}
    rows = ladders.site_ladder(ladder, n).join(ladders.site_ladder_diff(ladder, n), ["schedule_id", "t", "block"]).collect()
    assert {(r.t, r.block): (r.psi, r.d_psi) for r in rows} == {k: v for k, v in want.items() if v[1]} and len(rows) <= n + 2 * len(betas) + 0.02 * n
    for r in ladders.classify_blocks(ladder, n).collect():
        part = [(k, want[r.t, k][0]) for k in range(n) if 0 < want[r.t, k][0] < 1]
        assert r.n_full == sum(want[r.t, k][0] == 1 for k in range(n)) and [(r.block, r.psi)] == (part or [(-1, 0.0)])
    for r in ladders.classify_diffs(ladder, n).collect():
        d = [(k, want[r.t, k][1]) for k in range(n) if want[r.t, k][1]]
        assert r.n_whole == sum(abs(x) == 1 for _, x in d) and r.first_whole == min((k for k, x in d if abs(x) == 1), default=-1)
        assert [k for k, _ in r.parts] == [k for k, x in d if abs(x) != 1] and [x for _, x in r.parts] == pytest.approx([x for _, x in d if abs(x) != 1])
    some = [(k, -float(k % 7) - 1) for k in range(n) if k % 5 != 2 or n < 3]  # blocks without a likelihood add nothing
    lik = spark.createDataFrame([(1, *x) for x in some], "k long, block int, log_lik double")
    prior = spark.createDataFrame([(1, -2.0)], "k long, log_prior double")
    dlog = {r.t: r.dlog for r in ladders.subsampled_log_weight(lik, ladder, n, ["k"]).collect()}
    target = {r.t: r.log_target for r in ladders.subsampled_log_target(lik, ladder, n, prior, ["k"]).collect()}
    for t in range(len(betas)):
        assert dlog[t] == pytest.approx(sum(want[t, k][1] * x for k, x in some), abs=1e-9) and target[t] == pytest.approx(-2 + sum(want[t, k][0] * x for k, x in some), abs=1e-9)


def test_draws_do_not_depend_on_partitions(spark):
    one, two = (sorted(map(tuple, resample.draw_counts(particles(spark, parts=p), "population_id", 3).collect())) for p in (1, 7))
    assert one == two and sum(x[2] for x in one) == 1200
    chunks = resample.cumulative_intervals(particles(spark), "population_id", "particle_id", chunk=16).agg(F.max("hi"), F.sum(F.col("hi") - F.col("lo"))).first()
    assert chunks[0] == pytest.approx(1) and chunks[1] == pytest.approx(3)
    fixed = resample.draw_counts(particles(spark), "population_id", 3, n=100_000).groupBy("population_id").agg(F.sum("count").alias("n")).collect()
    assert [r.n for r in fixed] == [100_000] * 3  # two chunks of draws each
    with pytest.raises(Exception, match="all weights are zero"):
        resample.weighted_draw(particles(spark).withColumn("w", F.lit(0.0)), "population_id", 1).collect()
    one_heavy = particles(spark).withColumn("w", (F.col("particle_id") == 7).cast("double"))
    assert {r.particle_id for r in resample.resample_packed(one_heavy, "population_id", 1).collect()} == {7}


@pytest.mark.parametrize("mode", ["cess", "ess"])
def test_next_temperature(spark, mode):
    df = particles(spark)
    steps = {r.population_id: r.delta for r in adaptive.next_temperature(df.withColumn("beta", F.lit(0.25)), "population_id", "beta", 0.8, mode).collect()}
    pdf = df.toPandas()
    for p, g in pdf.groupby("population_id"):
        w, ll = g.w.to_numpy(), g.log_lik.to_numpy()

        def value(delta):
            v = np.exp(delta * (ll - ll.max()))
            return (w @ v) ** 2 / (w @ v**2) if mode == "cess" else (w @ v) ** 2 / ((w * v) ** 2).sum() / len(w)

        goal = 0.8 if mode == "cess" else 0.8 * value(0)
        lo, hi = 0.0, 0.75
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if value(mid) >= goal else (lo, mid)
        assert steps[p] == pytest.approx(lo, rel=1e-7)
    flat = df.withColumn("log_lik", F.lit(-1.0)).withColumn("beta", F.lit(0.25))
    assert all(r.delta == pytest.approx(0.75) for r in adaptive.next_temperature(flat, "population_id", "beta", 0.8).collect())


@pytest.mark.parametrize(("sd", "alpha"), [(0.01, 0.999), (1, 0.9999), (1000, 0.999), (5000, 0.999), (5000, 0.9999), (200, 0.5)])
def test_steps_hold_their_target(spark, sd, alpha):
    """The conditional ESS at the step is the target, whatever the scale: the tolerance is a share of 1 - alpha."""
    r = np.random.default_rng(3)
    rows = [(p, float(x) - 1e4) for p in range(3) for x in (r.normal(0, sd, 300) if p else r.standard_cauchy(300) * sd)]
    df = spark.createDataFrame([(p, x, 1 / 300, 0.0) for p, x in rows], "population_id long, log_lik double, w double, beta double").repartition(5)
    for s in adaptive.next_temperature(df, "population_id", "beta", alpha).collect():
        x = np.array([v for p, v in rows if p == s.population_id])
        v = np.exp(s.delta * (x - x.max()))
        got = v.sum() ** 2 / (v * v).sum() / 300
        assert (s.delta == 1 and got >= alpha) or abs(got - alpha) < 1e-6 * (1 - alpha)


def test_steps_that_nothing_solves(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, -inf, 0.5), (1, -1.0, 0.5), (2, -inf, 0.5), (2, -inf, 0.5), (3, nan, 0.5), (3, 1.0, 0.5), (4, -inf, 0.05), (4, -1.0, 0.5), (4, -3.0, 0.45), (5, -inf, 0.5), (5, -1.0, 0.5), (6, -3.0, 1.0)]
    df = spark.createDataFrame([(*x, 0.0) for x in rows], "population_id long, log_lik double, w double, beta double")
    got = {r.population_id: r.delta for r in adaptive.next_temperature(df, "population_id", "beta", 0.9).collect()}
    assert [got[k] for k in (1, 2, 3, 5)] == [None] * 4 and got[6] == 1 and 0 < got[4] < 1
    assert {r.delta for r in adaptive.or_default(adaptive.next_temperature(df.where("population_id = 1"), "population_id", "beta", 0.9), 50).collect()} == {0.02}
    assert not adaptive.next_temperature(df.limit(0), "population_id", "beta").count()
    # the dead take this one just to its target: whichever side of it a sum of tenths falls on
    even = spark.createDataFrame([(1, -float(i), 0.1, 0.0) for i in range(7)] + [(1, -inf, 0.3, 0.0)], df.schema)
    assert [r.delta for r in adaptive.next_temperature(even.repartition(5), "population_id", "beta", 0.7).collect()] == [None]


def test_smc_meets_the_exact_evidence(spark):
    data = spark.createDataFrame([(0, [0, 1, 0]), (1, [1, 1, 1])], "population_id long, data array<int>")
    _, z = sampler.annealed_smc(data, sampler.HmmKernel(hmm.TWO), n=4000, steps=[0.2, 0.6, 1.0])
    got = {r.population_id: r.log_z for r in z.collect()}
    assert got == pytest.approx({0: -1.779336949229498, 1: -1.7942625994461734}, abs=0.03)
    _, again = sampler.annealed_smc(data.repartition(3), sampler.HmmKernel(hmm.TWO), n=200, steps=[0.5, 1.0])
    _, same = sampler.annealed_smc(data.coalesce(1), sampler.HmmKernel(hmm.TWO), n=200, steps=[0.5, 1.0])
    assert {r.population_id: r.log_z for r in again.collect()} == pytest.approx({r.population_id: r.log_z for r in same.collect()}, rel=1e-12)


def test_unfinished_populations_are_an_error(spark):
    data = spark.createDataFrame([(0, [0, 1, 0])], "population_id long, data array<int>")
    with pytest.raises(ValueError, match="must be 1"):
        sampler.annealed_smc(data, sampler.HmmKernel(hmm.TWO), n=5, steps=[0.2, 0.6])
    with pytest.raises(RuntimeError, match="under temperature 1"):
        sampler.annealed_smc(data, sampler.HmmKernel(hmm.TWO), n=20, alpha=0.999, most_generations=2)
    done, z = sampler.annealed_smc(data, sampler.HmmKernel(hmm.TWO), n=50, alpha=0.5)
    assert done.count() == 50 and done.select("particle_id").distinct().count() == 50 and z.first().log_z == pytest.approx(-1.78, abs=0.5)
    assert not sampler.annealed_smc(data.limit(0), sampler.HmmKernel(hmm.TWO), n=5)[0].count()


def test_newick():
    edges = trees.newick_edges("((A:1,B:2)x:3,(C:4,'D d':5):6,E:7);")
    assert sorted((c, x) for _, c, x, _ in edges if not c.startswith("internal")) == [("'Dd'", 5.0), ("A", 1.0), ("B", 2.0), ("C", 4.0), ("E", 7.0)]


def _by_hand(text):
    """Lengths by split, and topology, of one tree, by the row-at-a-time parser."""
    edges = trees.newick_edges(text)
    taxa = frozenset().union(*[e[3] for e in edges]) if edges else frozenset()
    out = {}
    for _, _, length, below in edges:
        side = below if min(taxa) not in below else taxa - below
        if side:
            key = ",".join(sorted(side))
            out[key] = out.get(key, 0.0) + length
    return out, len(taxa)


def _random_tree(r, names):
    parts = [f"{n}:{r.randint(1, 99) / 100}" for n in r.sample(names, len(names))]
    while len(parts) > 3:
        k = r.randint(2, 3)
        some = [parts.pop(r.randrange(len(parts))) for _ in range(k)]
        parts.append(f"({','.join(some)}){r.choice(['', 'x', ' 0.9'])}:{r.randint(1, 99) / 100}")
    return "(" + ", ".join(parts) + ");"


def test_trees_in_columns(spark):
    """Edges and splits of tokens and running sums, against a parser with a stack."""
    r = random.Random(6)
    texts = [_random_tree(r, [f"t{i}" for i in range(n)]) for n in (2, 3, 4, 5, 8, 8, 8, 40, 90)] + ["((A:1,B:2):3,(C:4,D:5):6,E:7);", "((A:1,B:2):3,(C:4,D:5):6);", "(A,B,(C,'D d'))", "A;", "", " ", None, "(B:1,A:2,C:0.5)root;"]
    df = spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string").repartition(3)
    edges, every, inner = {}, {}, {}
    for x in trees.tree_edges(df).collect():
        edges.setdefault(x.tree_id, []).append((x.node_b if not x.node_b.startswith("internal") else "", x.length))
    for x in trees.tree_splits(df, trivial=True).collect():
        every.setdefault(x.tree_id, {})[x.split] = x.length
    for x in trees.tree_splits(df).collect():
        inner.setdefault(x.tree_id, {})[x.split] = x.length
    for i, t in enumerate(texts):
        own = trees.newick_edges(t or "")
        assert sorted(edges.get(i, [])) == sorted(("" if c.startswith("internal") else c, x) for _, c, x, _ in own)
        want, n = _by_hand(t or "")
        assert every.get(i, {}) == pytest.approx(want) and inner.get(i, {}) == pytest.approx({s: x for s, x in want.items() if 1 < s.count(",") + 1 < n - 1})
    assert every[9]["C,D"] == 6 and every[9]["C,D,E"] == 3 and every[10]["C,D"] == 9  # both edges at a root of degree two
    joined = trees.tree_nodes(df.where("tree_id = 9")).alias("a").join(trees.tree_nodes(df.where("tree_id = 9")).alias("b"), F.col("a.parent") == F.col("b.i")).where("a.name = 'C'").select("b.size").first()
    assert joined[0] == 2


def test_topologies(spark):
    same = ["((A:1,B:2):3,(C:4,D:5):6,E:7);", "(E:1,(D:1,C:1):9,(B:3,A:2):1);", "((E:1,(A:1,B:1):1):1,C:1,D:2);", "(((A:1,C:1):1,B:1):1,D:1,E:1);", "(A,B,C,D,E);"]
    df = spark.createDataFrame(list(enumerate(same)), "tree_id long, newick string")
    splits = trees.split_rows(trees.tree_nodes(df))
    weights = spark.createDataFrame([("g", i, 1.0 + i) for i in range(5)], "k string, tree_id long, weight double")
    counts = trees.topology_counts(splits, weights, ["k"])
    got = {(r.topology, r.weight, r.n) for r in trees.named_topologies(counts, splits, trees.split_names(splits, df)).collect()}
    assert got == {("C,D;C,D,E", 6.0, 3), ("B,D,E;D,E", 4.0, 1), ("", 5.0, 1)}


@pytest.mark.parametrize(("per_task", "per_block"), [(64, 1024), (2, 3), (1, 1)])
def test_likelihoods_of_many_trees(spark, per_task, per_block):
    """Shared clades and blocks of patterns give each tree the likelihood that summing over inner states gives it."""
    r = random.Random(2)
    names = ["a", "b", "c", "d"]
    sites = [(1, t, i, r.choice("ACGT-N")) for t in names for i in range(12) if t != "d" or i < 9]
    base = [_random_tree(r, names) for _ in range(4)]
    texts = base + ["((a:0.1,b:0.2):0.3,(c:0.1,d:0.4):0.2);", "(((a:0.1,b:0.2):0.3,c:0.1):0.5,d:0.4);", "((b:0.2,a:0.1):0.3,(c:0.1,zz:0.4):0.2);", base[0]]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "dataset_id long, tree_id long, newick string")
    table = spark.createDataFrame(sites, "dataset_id long, taxon string, site int, ch string")
    got = {x.tree_id: x.log_lik for x in trees.tree_log_likelihood(df, trees.site_patterns(table), 2.0, per_task, per_block).collect()}
    char = {(t, i): c for _, t, i, c in sites}
    for k, text in enumerate(texts):
        edges = trees.newick_edges(text)
        inner = sorted({p for p, *_ in edges})
        total = 0.0
        for i in range(12):
            lik = 0.0
            for states in itertools.product("AGCT", repeat=len(inner)):
                at, p = dict(zip(inner, states)), 0.25
                for parent, child, length, _ in edges:
                    m = trees._transition(length, 2.0)
                    row = m["AGCT".index(at[parent])]
                    p *= row["AGCT".index(at[child])] if child in at else row["AGCT".index(char[child, i])] if char.get((child, i)) in tuple("ACGT") else 1.0
                lik += p
            total += math.log(lik)
        assert got[k] == pytest.approx(total, rel=1e-10)
    taxa, nodes, roots = trees.shared_clades(texts[4:8])
    assert len(nodes) < 3 * 4 and roots[0] != roots[1]  # (a, b) with its lengths is one node


def test_consensus_text(spark):
    splits = spark.createDataFrame([(1, "C,D", 0.25), (1, "C,D,E", 0.5), (2, "B,C", 1.0)], "k long, split string, mean_length double")
    taxa = spark.createDataFrame([(k, t) for k, n in ((1, "ABCDE"), (2, "ABC"), (3, "AB")) for t in n], "k long, taxon string")
    got = {r.k: r.newick for r in trees.consensus_newick(splits, taxa, "k").collect()}
    assert got == {1: "(A,B,((C,D):0.250000,E):0.500000);", 2: "(A,(B,C):1.000000);", 3: "(A,B);"}


def test_sites_that_taxa_lack(spark):
    """A taxon without a character says nothing: as if it were not in the tree."""
    sites = spark.createDataFrame([(1, t, i, c) for t, s in (("a", "ACGT"), ("b", "ACGA"), ("c", "AC")) for i, c in enumerate(s)], "dataset_id long, taxon string, site int, ch string")
    tree = lambda newick: spark.createDataFrame([(1, 1, newick)], "dataset_id long, tree_id long, newick string")
    whole = trees.tree_log_likelihood(tree("((a:0.1,b:0.2):0.3,c:0.4);"), trees.site_patterns(sites)).first().log_lik
    three = trees.tree_log_likelihood(tree("((a:0.1,b:0.2):0.3,c:0.4);"), trees.site_patterns(sites.where("site < 2"))).first().log_lik
    two = trees.tree_log_likelihood(tree("(a:0.1,b:0.2);"), trees.site_patterns(sites.where("site >= 2 AND taxon != 'c'"))).first().log_lik
    assert whole == pytest.approx(three + two)


def test_files(spark, tmp_path):
    (tmp_path / "a.t").write_text("#NEXUS\nbegin trees;\n translate\n  1 Ape,\n  2 Bee,\n  3 Cat;\n" + "".join(f"   tree rep.{i} = [&U] (1:0.{i},2:0.2,3:0.3);\n" for i in range(8)) + "end;\n")
    rows = io.read_tree_samples(spark, str(tmp_path / "a.t")).orderBy("line").collect()
    assert len(rows) == 6 and rows[0].newick == "(Ape:0.2,Bee:0.2,Cat:0.3);"
    assert io.read_tree_samples(spark, str(tmp_path / "a.t"), strict_reference=True).count() == 8
    (tmp_path / "many.t").write_text("".join(f"(A,B,t{i});\n\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")  # blocks of one file in many tasks
    many = io.read_tree_list(spark, str(tmp_path / "many.t")).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.line: r.newick for r in many} == {2 * i: f"(A,B,t{i});" for i in range(5000)}
    (tmp_path / "l.txt").write_text("treeName,Method,NumericalLogZ,logZ\na,SMC,NA,-1.5\nb,MCMC,-2\nc,SS,3,-4\n")
    assert [tuple(r) for r in io.read_logz(spark, str(tmp_path / "l.txt")).collect()] == [("a", "SMC", None, -1.5), ("b", "MCMC", None, -2.0), ("c", "SS", 3.0, -4.0)]
    (tmp_path / "s.txt").write_text("0.1 0.2\n 0.7\n")
    assert [r.d_beta for r in io.read_schedule(spark, str(tmp_path / "s.txt")).orderBy("t").collect()] == [0.1, 0.2, 0.7]
    (tmp_path / "m.msf").write_text("PileUp\n\n MSF: 8 Type: N\n Name: x1 Len: 8\n//\n\nx1  ACGT\ny2  AC-T\n\nx1  GG\ny2  TT\n")
    got = io.read_alignments(spark, str(tmp_path / "m.msf")).groupBy("taxon").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site", "ch"))), lambda s: s["ch"]), "").alias("s"))
    assert {r.taxon: r.s for r in got.collect()} == {"x1": "ACGTGG", "y2": "AC-TTT"}
    (tmp_path / "r.log").write_text("text\n   1  -123.5   -120.25\n   all  -1\n")
    assert io.read_logz_report(spark, str(tmp_path / "r.log")).first().log_z == -123.5
    io.write_evaluation(spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 2.5)], "statistic string, approximation double, truth double"), str(tmp_path / "e"))
    assert sorted(r.truth for r in spark.read.csv(str(tmp_path / "e"), header=True).collect()) == ["2.5", "NA"]


def test_linked_sampling_needs_equal_rungs(spark):
    trace = spark.createDataFrame([(1, r, i, -1.0) for r in range(3) for i in range(5 + r)], "dataset_id long, rung int, iter long, log_lik double")
    with pytest.raises(Exception, match="unequal"):
        evidence.linked_importance_sampling(trace, ladders.ladder_even(spark, 3)).collect()
    equal = evidence.equal_rungs(trace)
    assert {tuple(r) for r in equal.groupBy("rung").agg(F.count("*"), F.min("iter")).collect()} == {(0, 5, 0), (1, 5, 1), (2, 5, 2)}
    assert evidence.linked_importance_sampling(equal, ladders.ladder_even(spark, 3)).first().log_z == pytest.approx(-1.0)


def test_prior_paths(spark):
    paths = hmm.draw_prior_paths(spark, 4000, 3, hmm.TWO, seed=2)
    share = paths.where("pos = 0").agg(F.avg((F.col("state") == 0).cast("double"))).first()[0]
    assert share == pytest.approx(0.2, abs=0.03) and paths.count() == 12000


def test_arguments():
    with pytest.raises(ValueError, match="epsilon"):
        hmm.valley(1.0)
