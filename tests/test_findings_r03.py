"""What the third round's findings found."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annealjobs.functions.scratch import shared_folder
from annealjobs.operators import hmm, ladders, summaries, trees
from annealjobs.plans import sampler
from annealjobs.sources import fixtures, io


def test_losses_of_rounded_weights_tie(spark):
    """Weights of thirds, rounded to twelve digits, in which two items lose the same."""
    rows = [(1, "click", 1), (1, "error", 1), (1, "signup", 2), (1, "view", 1), (1, "viewing", 1), (2, "aa", 1), (2, "b", 1), (2, "cccc", 1)]
    total = F.when(F.col("k") == 1, 6).otherwise(3)
    df = spark.createDataFrame(rows, "k int, item string, weight int").withColumn("weight", (F.col("weight") / total).cast("decimal(20,12)"))
    halves = spark.createDataFrame([(3, "zz", "0.333333333333"), (3, "z", "0.166666666667"), (3, "bbb", "0.166666666667"), (3, "aaaa", "0.333333333334")], "k int, item string, weight string")
    df = df.unionByName(halves.withColumn("weight", F.col("weight").cast("decimal(20,12)")))
    want = {1: "click", 2: "aa", 3: "bbb"}
    pairs = summaries.centroid(df, ["k"], lambda x, y: F.abs(F.length(x) - F.length(y)).cast("decimal(6,0)"), metric=True, digits=9)
    line = summaries.centroid_on_line(df, ["k"], F.length("item"), slack=1e-10)
    for out in (pairs, line):
        assert {r.k: r["item"] for r in out.collect()} == want


def test_differences_that_sum_to_one_end_a_ladder(spark):
    """Ten tenths are under 1 as a running sum of doubles: no further rung comes of what is missing."""
    diffs = spark.createDataFrame([("a", t, 0.1) for t in range(12)], "schedule_id string, t int, d_beta double")
    rows = ladders.replay_ladder(diffs).orderBy("t").collect()
    assert len(rows) == 10 and rows[-1].beta == 1.0 and abs(rows[-1].d_beta - 0.1) < 1e-9
    assert ladders.adjacent_rungs(ladders.replay_ladder(diffs)).count() == 9


def test_patterns_of_pieces(spark, tmp_path, monkeypatch):
    """Columns of pieces are those of single characters, and no task makes a row of each character."""
    monkeypatch.setattr(fixtures, "PIECE", 7)
    texts = ["The quick \u00e9\u4e2d brown fox", "", None, "jumps over", "the lazy dog the lazy dog the lazy dog", "xy" * 40, "a", "tail"]
    docs = [(i, texts[i % 8] if i != 13 else "other words") for i in range(22)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    patterns, names = trees.piece_patterns(fixtures.pieces(spark, str(tmp_path), "aln"))
    got = {}
    for r in patterns.join(names, "dataset_id").collect():
        got[r.dataset_id, tuple(sorted((t, c) for t, c in zip(r.taxa, r.pattern) if c != "?"))] = r.n_sites
    columns = {(r.dataset_id, tuple(zip(r.taxa, r.pattern))): r.n_sites for r in trees.site_patterns(fixtures.fixture(spark, str(tmp_path), "aln")).collect()}
    assert got == columns
    plan = patterns._jdf.queryExecution().optimizedPlan().toString()
    assert "bases" in plan and "split(text" not in plan
    wide = spark.createDataFrame([(1, f"t{i:02d}", 0, "ACGT"[i % 4] * 5 + "G" * (i % 2)) for i in range(11)], "dataset_id long, taxon string, site long, block string")
    assert sorted((r.pattern, r.n_sites) for r in trees.piece_patterns(wide)[0].collect()) == [("?G?G?G?G?G?", 1), ("ACGTACGTACG", 5)]


def test_trees_are_taken_apart_without_a_shuffle_of_tokens(spark):
    """As by tokens in rows: odd labels, nested and flat trees, roots of degree two, other letters, empty texts."""
    r = random.Random(3)

    def grown(names):
        parts = [f"{n}:{r.randint(1, 99) / 100}" for n in names]
        while len(parts) > 3:
            some = [parts.pop(r.randrange(len(parts))) for _ in range(r.randint(2, 3))]
            parts.append(f"({','.join(some)}){r.choice(['', 'x', ' 0.9'])}:{r.randint(1, 99) / 100}")
        return "(" + ", ".join(parts) + ");"

    texts = [grown([f"t{i}" for i in r.sample(range(99), n)]) for n in (2, 3, 4, 5, 8, 8, 40, 90)] + ["((A:1,B:2):3,(C:4,D:5):6);", "((A,B),(C,D))", "((\u00e9:1,\u4e2d:2):3,(C:4,\U0001f600:5):6,E:7);", "A;", "", " ", None, "((((A:1,B:2):1):2,C:1):1,D:1,E:2)r;"]
    df = spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string").repartition(3)
    for trivial in (False, True):
        splits = trees.tree_split_rows(df, trivial)
        assert "Window" not in splits._jdf.queryExecution().executedPlan().toString()
        got = {(x.tree_id, x.split): x.length for x in trees.named(splits.drop("side"), trees.split_names(splits, df)).collect()}
        old = trees.split_rows(trees.tree_nodes(df), trivial)
        assert got == pytest.approx({(x.tree_id, x.split): x.length for x in trees.named(old.drop("side"), trees.split_names(old, df)).collect()})
    with pytest.raises(Exception, match="balanced"):
        trees.tree_split_rows(spark.createDataFrame([(1, "((A,B);")], "tree_id long, newick string")).collect()


def test_generations_leave_no_tables(spark):
    """A sampler's paths are drawn a block at a time, and what a generation wrote goes with the next."""
    kernel = sampler.HmmKernel(hmm.THREE)
    r = np.random.default_rng(5)
    data = [list(r.integers(0, 3, n)) for n in (1, 4, 4, 0, 9)]
    draws = r.random((5, 1))
    states, lls = kernel.initial(data, draws)
    for y, u, path, ll in zip(data, draws, states, lls):
        g, p, own = np.random.default_rng(int(u[0] * 2**53)), np.exp(kernel.init), []
        for _ in y:
            own.append(int(np.searchsorted(np.cumsum(p)[:-1], g.random(), "right")))
            p = np.exp(kernel.trans[own[-1]])
        assert path == own and ll == pytest.approx(sum(kernel.emit[s, o] for s, o in zip(own, y)))
    top = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(top))
    populations = spark.createDataFrame([(k, [0, 1, 2, k % 3]) for k in range(3)], "population_id long, data array<int>")
    done, _ = sampler.annealed_smc(populations, kernel, n=20, alpha=0.5)
    assert done.count() == 60
    assert not [x for x in set(os.listdir(top)) - before if x.startswith(("live", "weighed", "particles"))]


@pytest.mark.parametrize("burnin", [0.0, 0.25, 0.9, 1.0])
def test_burn_in_of_samples_in_many_blocks(spark, tmp_path, burnin):
    """The first tree that is kept is found in its block alone, wherever it stands."""
    for name, n in (("a", 300), ("b", 7), ("none", 0)):
        (tmp_path / f"{name}.t").write_text("#NEXUS\n translate\n  1 Ape,\n  2 Bee;\n" + "".join(f"   tree {'rep' if i % 5 else 'gen'}.{i} = [&U] (1:0.{i + 1},2:0.2);\n" for i in range(n)) + "end;\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        got = {(r.file[-3:], r.line, r.newick) for r in io.read_tree_samples(spark, str(tmp_path), burnin).collect()}
        strict = {(r.file[-3:], r.line) for r in io.read_tree_samples(spark, str(tmp_path), burnin, strict_reference=True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(f"{f}.t", i + 4, f"(Ape:0.{i + 1},Bee:0.2);") for f, n in (("a", 300), ("b", 7)) for i in range(n) if i >= int(n * burnin)}
    assert strict == {(f"{f}.t", i + 4) for f, n in (("a", 300), ("b", 7)) for i in range(n) if i % 5 or i > (n + 5) * burnin}


def test_blocks_of_pieces(spark):
    """Sums of blocks that begin and end inside pieces, with no row of a character."""
    texts = {0: "ACGTACGTACGTAC", 14: "GT", 16: "TTTTT"}
    rows = [(k, "a", at, x) for k in (1, 2) for at, x in texts.items()] + [(1, "b", 0, "GGG"), (1, "c", 0, "")]
    out = ladders.block_codes(spark.createDataFrame(rows, "dataset_id long, taxon string, site long, block string"), 10)
    whole = "".join(texts.values())
    want = {(k, i // 10): sum(map(ord, whole[i : i + 10])) + (k == 1 and i == 0) * 3 * ord("G") for k in (1, 2) for i in range(0, len(whole), 10)}
    assert {(r.dataset_id, r.block): r.code for r in out.collect()} == want


def test_many_alignments_a_file(spark, tmp_path):
    """Files are as many as tasks, not data sets; places hold where a data set's lines begin and end inside blocks of a file."""
    r = random.Random(4)
    texts = {(d, f"t{t}"): "".join(r.choices("ACGT", k=r.choice((0, 1, 59, 60, 61, 500, 1300)))) for d in range(-1, 40) for t in range(3)}
    rows = [(d, t, at, x[at : at + 240]) for (d, t), x in texts.items() for at in range(0, max(len(x), 1), 240)]
    io.write_alignments(spark.createDataFrame(rows, "dataset_id long, taxon string, site long, block string").repartition(5), str(tmp_path / "a"), 60)
    files = list((tmp_path / "a").glob("**/part-*.txt"))
    lines = [x.split("\t") for f in files for x in f.read_text().splitlines()]
    assert len(files) <= 4 and max(len(v.split()[1]) for _, v in lines if v[:1] == "t") == 60
    one = next(x for x in texts if len(texts[x]) == 1300)
    assert "".join(v.split()[1] for d, v in lines if d == str(one[0]) and v.startswith(one[1])) == texts[one]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = io.read_alignments(spark, str(tmp_path / "a"), many=True).collect()
        codes = ladders.stretch_codes(io.read_alignment_pieces(spark, str(tmp_path / "a"), many=True).withColumnRenamed("dataset", "dataset_id"), 100).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == sorted((str(d), t, i, c) for (d, t), x in texts.items() for i, c in enumerate(x))
    want = {(str(d), t, i // 100, len(x[i : i + 100]), sum(ord(c) * (k + 1) for k, c in enumerate(x[i : i + 100]))) for (d, t), x in texts.items() for i in range(0, len(x), 100)}
    assert set(map(tuple, codes)) == want and len(codes) == len(want)


def test_many_schedules_a_file(spark, tmp_path):
    """Files are as many as tasks, not schedules, with names of any characters."""
    names = [*"abcdefgh", "b/c", "007", "d e", "%x", "x\ty", "l\nm", "\\N", "", None, "é+"]
    rows = [(s, t, 0.25 * t + i) for i, s in enumerate(names) for t in range(1 + 9 * i)]
    df = spark.createDataFrame(rows, "schedule_id string, t int, d_beta double").repartition(5)
    io.write_schedules(df, str(tmp_path / "s"))
    three = df.groupBy("schedule_id", F.expr("t div 3").alias("i")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "d_beta"))), lambda x: x["d_beta"].cast("string")), " ").alias("value"))
    io.write_lines(three, str(tmp_path / "three"), "schedule_id", "i")
    assert len(list((tmp_path / "s").glob("**/part-*.txt"))) <= 4
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        for folder in ("s", "three"):
            got = sorted(map(tuple, io.read_schedules(spark, str(tmp_path / folder)).collect()), key=repr)
            assert got == sorted(rows, key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_splits_carry_what_they_are_summed_by(spark):
    """Posteriors and distances with no join of trees to their splits, as by joins: trees without splits, one that is its own reference, a key whose reference has none."""
    r = random.Random(8)
    rows = []
    for i in range(60):
        names = r.sample("ABCDEFG", 7 if i % 7 else 3)
        parts = [f"{n}:{r.randint(1, 99) / 100}" for n in names]
        while len(parts) > 3:
            parts.append(f"({parts.pop(r.randrange(len(parts)))},{parts.pop(r.randrange(len(parts)))}):{r.randint(1, 99) / 100}")
        rows.append((f"k{i % 4}", i, "(" + ",".join(parts) + ");", 1.0 + r.random()))
    rows += [("k9", 90, "(A:1,B:1,C:1);", 2.0), ("k9", 91, None, 1.0), ("k9", 92, "((A:1,B:1):0.5,C:1,D:1);", 1.0)]
    df = spark.createDataFrame(rows, "k string, tree_id long, newick string, weight double").repartition(3)
    weights = df.select("k", "tree_id", "weight")
    plain, carried = trees.tree_split_rows(df), trees.tree_split_rows(df, keep=["k", "weight"])
    sums = trees.clade_sums(carried, ["k"])
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan
    posterior = lambda p: {(x.k, x.split): (x.p, x.mean_length) for x in trees.named(p, trees.split_names(sums, df)).collect()}
    got, want = posterior(trees.summed_posterior(sums, weights, ["k"])), posterior(trees.clade_posterior(plain, weights, ["k"]))
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    first = weights.groupBy("k").agg(F.min("tree_id").alias("g"))
    golds = weights.join(first, "k").where("tree_id = g").select("k", "tree_id").join(plain, "tree_id").select("k", "split", "length")
    theirs = weights.select("k", "tree_id").join(golds, "k").drop("k")
    distances = lambda d: {x.tree_id: (x.partition, x.rate, x.branch_l1, x.branch_l2) for x in d.collect()}
    own = distances(trees.distance_to_one(trees.tree_split_rows(df, keep=["k"], outer=True), golds, "k"))
    want = distances(trees.tree_distance(plain, theirs, ["tree_id"]))
    assert own.keys() == want.keys() and all(own[x] == pytest.approx(want[x], abs=1e-9) for x in want)
    assert own[92] == (1, 1.0, 0.5, 0.5) and own[1] == (0, 0.0, 0.0, 0.0) and 90 not in own
