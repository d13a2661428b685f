"""Operator 11 against brute force, and on odd tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from annealjobs.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The top, and for each node its runs (siblings before, siblings after) from the bottom up."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for i in range(0, len(nodes), 8):
            for k in range(i, min(i + 8, len(nodes))):
                for leaf in at[k]:
                    paths[leaf].append(("".join(nodes[i:k]), "".join(nodes[k + 1 : i + 8])))
            up.append(sha(*nodes[i : i + 8]))
            held.append([x for k in at[i : i + 8] for x in k])
        nodes, at = up, held
    return nodes[0], paths


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    inner = []
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        inner.append(tree([leaf_of(r, r[1]) for r in by_lang[lang]]))
    root, above = tree([x[0] for x in inner])
    out = []
    for lang, (subroot, paths), more in zip(langs, inner, above):
        for r, path in zip(by_lang[lang], paths):
            path, own = path + more, leaf_of(r, r[1])
            now = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for b, a in path:
                now = sha(b, now, a)
            out.append((r[0], own, subroot, root, sha(*(b + a for b, a in path)), now, now == root))
    return sorted(out, key=repr)


def table(n, langs, seed=3):
    r = random.Random(seed)
    texts = [None, "", "Ä B\nc", "plain", "UPPER case", "x" * 50_000 + "Y"]
    rows = [(i if i % 50 else None, r.choice(texts), r.choices(langs, [9] + [1] * (len(langs) - 1))[0], r.choice([None, "s", ""]), r.choice([None, 3])) for i in range(n)]
    return rows + rows[:20] + [rows[-1]] * 9  # repeated rows


@pytest.mark.parametrize(("n", "langs"), [(1, ["a"]), (7, ["a"]), (9, [None, "a"]), (700, ["en", None, "", "é", "z"]), (300, [f"l{i}" for i in range(150)])])
def test_against_brute_force(spark, n, langs, tmp_path, monkeypatch):
    rows = table(n, langs)
    spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("tree", F.lit(1)).withColumn("leaf", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = manifest.op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert len({w[3] for w in want}) == 1


def test_blocks_of_another_depth_give_the_same(spark):
    rows = [(i, f"T{i}", "en" if i % 9 else None, "s", i) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    leaves = docs.select(F.col("lang").alias("tree"), manifest.leaf(*[F.col(c) for c in manifest.FIELDS]).alias("node"), F.col("doc_id").alias("item"), "doc_id")
    nodes = manifest.ranked(leaves, ["doc_id"]).select("tree", "rank", "node", "item")
    ranks = {(r.tree, r.item): r.rank for r in nodes.collect()}
    for lang in ("en", None):
        assert [ranks[lang, d] for d in sorted(i for t, i in ranks if t == lang)] == list(range(sum(t == lang for t, _ in ranks)))
    one, three = ({r.tree: r.node for r in _tops(nodes, levels).collect()} for levels in (1, 3))
    assert one == three


def _tops(nodes, levels):
    x = nodes
    for _ in range(4):
        x = manifest._rolled(x, levels).select("tree", "rank", "node", F.lit(None).cast("int").alias("item"))
    return x


def test_empty(spark):
    out = manifest.manifest(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[:2] == ["doc_id", "leaf"]


def test_an_untouched_table_verifies(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 1) for i in range(70)], SCHEMA)
    assert manifest.manifest(docs).where("verified").count() == 70
    other = manifest.manifest(docs, F.when(F.col("doc_id") == 5, F.lit("forged")))
    assert [r.doc_id for r in other.where("NOT verified").collect()] == [5]
