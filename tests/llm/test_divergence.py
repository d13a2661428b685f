"""Operator 12 against brute force, and on odd tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annealjobs.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n string, terms string, value string"
WORDS = ["the", "The", "THE", "of", "x", "é", "É", "naïve", "a1b", "don't", "日本", "rare", "ſ", "K"]


def brute(rows, ranks=200, least=3):
    texts, count = defaultdict(list), defaultdict(Counter)
    documents = defaultdict(Counter)
    for _, text, lang, source in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        lang, source = lang or "", source or ""
        texts[lang].append(source)
        count[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang, sources in texts.items():
        sources = sorted(set(sources), key=str.encode)
        kept = [t for t, n in documents[lang].items() if n >= least]
        share = lambda c, own: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in own) + len(own)) for t in own}
        p = {s: share(count[lang, s], kept) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()), kept)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def table(seed=1, n=240):
    r = random.Random(seed)
    more = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = []
    for i in range(n):
        lang, source = r.choice(["en", "en", "en", "de", None, ""]), r.choices(["a", "b", "é", "z", None, "one"], [30, 5, 5, 5, 3, 1])[0]
        rows.append((i, r.choice([None, "", "12 3"]) if i % 11 == 0 else " ".join(r.choices(WORDS + more, k=r.randint(1, 60))), lang, source))
    rows += [(n, "alone " * 50, "xx", "s"), (n + 1, "1 2", "none", "s"), (n + 2, None, "none", "t"), (n + 3, "ab, cd", "few", "s"), (n + 3, "ab, cd", "few", "t")]
    return rows + rows[:5] * 3


@pytest.mark.parametrize(("block", "tile", "ranks"), [(1 << 18, 1024, 200), (50, 2, 7), (1, 1, 1)])
def test_against_brute_force(spark, block, tile, ranks):
    rows = table()
    docs = spark.createDataFrame([(*x, *["clash"] * 3) for x in rows], SCHEMA).repartition(4)
    got = divergence.audit(docs, ranks=ranks, block=block, tile=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, ranks)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_sources_in_one_language(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices([x for x in WORDS if x.isalpha()], k=9)), "en", f"s{i % 150}") for i in range(450)]
    docs = spark.createDataFrame([(*x, *["clash"] * 3) for x in rows], SCHEMA)
    got = divergence.audit(docs, tile=64)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_shares_are_exact():
    r = random.Random(2)
    n = [r.randrange(10**k) for k in range(1, 15) for _ in range(20)]
    total = [x + 1 + r.randrange(10**13) for x in n]
    assert divergence.scaled(np.array(n), np.array(total)).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n, total)]


def test_shares_in_columns_are_exact(spark):
    n = [0, 1, 10**12, 10**15]
    df = spark.createDataFrame([(x, x + 7 + x // 3) for x in n], "n long, total long")
    assert [r.p for r in df.select(divergence._share(F.col("n"), F.col("total")).alias("p")).collect()] == [1 + 10**9 * (x + 1) // (x + 7 + x // 3) for x in n]


def test_long_texts_are_counted_in_pieces(spark):
    text = "ab é " * 300_000 + "cd"
    docs = spark.createDataFrame([(text, "en", "s")], "text string, lang string, source string")
    got = {(r.term, r.n, r.documents, tuple(r.postings[0])) for r in divergence.term_major(divergence.counted(docs)).collect()}
    assert got == {(None, 0, 0, ("s", 0)), ("ab", 300_000, 1, ("s", 300_000)), ("é", 300_000, 1, ("s", 300_000)), ("cd", 1, 1, ("s", 1))}


@pytest.mark.parametrize("held", [1, 1 << 18])
def test_terms_handed_on_in_parts(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    docs = spark.createDataFrame([(t, lang, s) for lang in ("x", "y") for s in ("a", "b") for t in ("one two", "two", "", "two two 7 one")] * 50, "text string, lang string, source string").repartition(7)
    got = {(r.lang, r.term): (r.n, r.documents, sorted(map(tuple, r.postings))) for r in divergence.term_major(divergence.counted(docs)).collect()}
    assert got["x", "two"] == (400, 300, [("a", 200), ("b", 200)]) and got["y", "one"] == (200, 200, [("a", 100), ("b", 100)]) and got["x", None] == (0, 0, [("a", 0), ("b", 0)]) and len(got) == 6
