"""The ten operators against brute force, exact round trips and held-out accuracy, on small hard inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from annealjobs.llm import chat_format, decontaminate, language_id, mixing, quality, shared, simhash, suffix_dedup, token_counts, token_output, url_filter
from annealjobs.llm.components import components
from annealjobs.llm.shared import pieces, scratch
from annealjobs.llm.tokens import Words, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, size string, component string, target string, copies string"
VOCABULARY = [f"{a}{b}" for a in ("on", "the", "rea", "sti", "übe", "quo", "Ma", "lin") for b in ("da", "ner", "t.", "ß", "ing,", "o")]
ODD = [None, "", " ", "\n\n \t", "one", "one two", "one two three", "The END", "é" * 70, "a" * 300, "x\x00y z", "  double  blanks \n here  ", "<|endoftext|> in <|startoftext|>it", "nbsp\u00a0here and\u2028there \u0301x", "don't we're I'll", "12 345,678 .. ||| ***"]


def texts(seed: int, n: int = 60) -> list[str]:
    r = random.Random(seed)
    base = [" ".join(r.choices(VOCABULARY, k=r.randint(5, 120))) + r.choice(["", "\n", ".\nline\nline"]) for _ in range(n)]
    near = [" ".join(w if r.random() > 0.03 else "CHANGED" for w in t.split(" ")) for t in base[:20]]
    mixed = [base[i][: len(base[i]) // 2] + " " + base[i + 1][-90:] for i in range(20)]
    return base + near + mixed + base[5:9] * 4


def frame(spark, rows, parts=5):
    """Rows (doc_id, text, lang, source); the further columns have names that operators use inside."""
    return spark.createDataFrame([(*r, None, *["clash"] * 6) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def docs(spark):
    all_texts = texts(1) + ODD
    order = list(range(len(all_texts)))
    random.Random(2).shuffle(order)
    rows = [(i, all_texts[k], ["en", "de", None][k % 3], ["a", "b", "é", None][k % 7 % 4]) for i, k in enumerate(order)]
    return rows, frame(spark, rows).cache()


def words_of(text):
    return (text or "").encode().split()


def reference_fp(text, k=3):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reference_groups(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("chunk", [8192, 3])
def test_simhash(spark, docs, chunk):
    rows, df = docs
    fps = {d: reference_fp(t) for d, t, *_ in rows}
    groups = reference_groups(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df, chunk=chunk).collect()}
    assert got == {d: (fps[d], groups[d]) for d in fps}
    assert len(set(groups.values())) < len(groups)


@pytest.mark.parametrize(("n", "radius", "spread"), [(30, 3, 3), (700, 3, 4), (700, 5, 6), (300, 0, 1), (1, 3, 1), (65, 3, 40)])
def test_sliced_links(n, radius, spread):
    r = random.Random(n + radius)
    heads = [r.getrandbits(64) for _ in range(6)]
    fps = [r.choice(heads) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, spread))) for _ in range(n)]
    want = reference_groups(range(n), [(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius])
    edges = simhash.links(np.array(fps, np.uint64).reshape(n, 1), radius)
    assert all((fps[a] ^ fps[b]).bit_count() <= radius for a, b in edges)
    assert reference_groups(range(n), edges) == want and len(edges) < n


@pytest.mark.parametrize(("n", "radius"), [(40, 90), (400, 90), (130, 20)])
def test_wide_links(n, radius):
    r = random.Random(n)
    heads = [[r.getrandbits(64) for _ in range(8)] for _ in range(5)]
    fps = []
    for _ in range(n):
        f = list(r.choice(heads))
        for b in r.sample(range(512), r.randint(0, radius)):
            f[b >> 6] ^= 1 << (b & 63)
        fps.append(f)
    near = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(fps[a], fps[b])) <= radius
    want = reference_groups(range(n), [(a, b) for a in range(n) for b in range(a) if near(a, b)])
    edges = simhash.links(np.array(fps, np.uint64), radius)
    assert all(near(a, b) for a, b in edges) and reference_groups(range(n), edges) == want


@pytest.mark.parametrize("few", [48, 3])
@pytest.mark.parametrize(("words", "radius", "spread"), [(1, 3, 5), (1, 5, 8), (1, 0, 1), (8, 20, 30)])
def test_many_buckets_share_planes(monkeypatch, few, words, radius, spread):
    monkeypatch.setattr(simhash, "FEW", few)
    r = random.Random(words + radius)
    key = np.repeat(np.arange(90), [r.choice([1, 2, 2, 3, 7, 40, 70]) for _ in range(90)])
    heads = [r.getrandbits(64 * words) for _ in range(90)]
    fps = [heads[k] ^ sum(1 << b for b in r.sample(range(64 * words), r.randint(0, spread))) for k in key.tolist()]
    wide = np.array([[f >> 64 * i & (1 << 64) - 1 for i in range(words)] for f in fps], np.uint64)
    near = [(a, b) for k in range(90) for a, b in combinations(np.flatnonzero(key == k).tolist(), 2) if (fps[a] ^ fps[b]).bit_count() <= radius]
    assert reference_groups(range(len(fps)), zip(*(x.tolist() for x in simhash.linked(key, np.arange(len(fps)), wide, radius)))) == reference_groups(range(len(fps)), near) and near
    small = np.isin(key, np.flatnonzero(np.bincount(key) < 9))
    a, b = simhash._neighbours(wide[small], key[small], radius)
    at = np.flatnonzero(small)
    assert sorted(zip(at[a].tolist(), at[b].tolist())) == [p for p in near if small[p[0]]]


@pytest.mark.parametrize("n", [1, 2, 50, 400])
def test_labels(n):
    r = random.Random(n)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(n)] + [(i, i + 1) for i in range(n // 3)]
    got = simhash._labels(n, *np.array(pairs, np.int64).T)
    assert dict(enumerate(got.tolist())) == reference_groups(range(n), pairs)
    assert (simhash._labels(n, *np.zeros((2, 0), np.int64)) == np.arange(n)).all()


@pytest.mark.parametrize("batch", [1, 3, 7, 100])
@pytest.mark.parametrize("most", [1, 4, 1000])
def test_pieces(batch, most):
    r = random.Random(batch * most)
    key = sorted(r.choices(range(5), k=40) + [7] * 30 + [9])
    whole = pa.table({"key": pa.array(key, pa.int64()), "row": pa.array(range(len(key)), pa.int64())})
    got = list(pieces(whole.to_batches(max_chunksize=batch), "key", most))
    assert [x for _, t in got for x in t.column("row").to_pylist()] == list(range(len(key)))
    number = {}
    for n, t in got:
        keys = set(t.column("key").to_pylist())
        assert t.num_rows and (n < 0 or len(keys) == 1)
        for k in keys:
            assert n == (number[k] + 1 if k in number else min(n, 0)) and number.get(k, 0) >= 0  # in order, and whole groups once
            number[k] = n
    assert most < 1000 or all(n < 0 for n, _ in got)


@pytest.mark.parametrize("chunk", [8, 40])
def test_large_wide_buckets_lose_no_link(spark, chunk):
    """A walk whose neighbours alone are near: links across chunks stand between no groups' first members."""
    r = random.Random(chunk)
    f, rows = [0] * 8, []
    for i in range(150):
        for b in r.sample(range(64, 512), 20):  # the first word stays, so that the buckets hold all
            f[b >> 6] ^= 1 << (b & 63)
        rows.append((i, np.array(f, np.uint64).tobytes()))
    r.shuffle(rows)
    nodes = spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "node long, fp binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        found = {(x.u, x.v) for x in simhash.wide_links(nodes, 30, 1, 4, chunk=chunk).collect()}
        want = {(x.u, x.v) for x in simhash.wide_links(nodes, 30, 1, 4, chunk=10**6).collect()}
        none = simhash.wide_links(nodes.where("node < 0"), 30, 1, 4, chunk=chunk).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert reference_groups(range(150), found) == reference_groups(range(150), want) and len(set(reference_groups(range(150), want).values())) < 150 and not none


def jaccard(a, b, k=5):
    def s(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    return len(s(a) & s(b)) / len(s(a) | s(b))


@pytest.mark.parametrize("few", [48, 3])
def test_similar_documents(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(150):
        t = r.choices(words, k=200)
        near = list(t)
        for _ in range(3):
            near[r.randrange(200)] = "edit"
        rows += [(3 * i, " ".join(t), None, None), (3 * i + 1, " ".join(near), None, None), (3 * i + 2, " ".join(t[:100] + r.choices(words, k=100)), None, None)]
    for i in range(150):  # like the first, but not enough
        less = list(rows[3 * i][1].split(" "))
        for at in range(10, 190, 20):
            less[at + r.randrange(9)] = f"less{i}"
        rows.append((1000 + i, " ".join(less), None, None))
    assert all(0.55 < jaccard(rows[3 * i][1], rows[450 + i][1]) < 0.8 for i in range(150))
    odd = [(900, None, None, None), (901, "", None, None), (902, rows[0][1], None, None), (902, rows[0][1], None, None)]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(frame(spark, rows + odd)).collect()}
    assert np.mean([got[3 * i + 1] == 3 * i for i in range(150) if jaccard(rows[3 * i][1], rows[3 * i + 1][1]) >= 0.8]) > 0.93
    assert all(got[1000 + i] == 1000 + i for i in range(150))
    assert all(got[3 * i] == 3 * i and got[3 * i + 2] == 3 * i + 2 for i in range(150)) and got[901] == 900 and got[902] == 0


@pytest.mark.parametrize("piece", [1024, 100])
def test_template_group(spark, monkeypatch, piece):
    """Pages of one template just under the similarity: none goes, and pairs planted among them are found, every one."""
    monkeypatch.setattr(simhash, "PIECE", piece, raising=False)
    template, rows = [f"t{i}" for i in range(300)], []
    for i in range(320):
        at = 3 + 4 * (i % 60)
        rows.append((i, " ".join(template[:at] + [f"p{i}x{j}" for j in range(38)] + template[at + 38 :]), None, None))
    for i in range(20):  # other own words at the end
        w = rows[i][1].split()
        rows.append((1000 + i, " ".join(w[:-20] + [f"q{i}y{j}" for j in range(20)]), None, None))
    edges = [(a, b) for (a, x, *_), (b, y, *_) in combinations(rows, 2) if jaccard(x, y) >= 0.8]
    assert edges == [(i, 1000 + i) for i in range(20)]
    assert sum(jaccard(rows[i][1], rows[i + 60][1]) > 0.75 for i in range(60)) == 60
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(frame(spark, rows)).collect()}
    assert got == {d: d % 1000 for d, *_ in rows}


def test_repeated_lines_are_one(spark):
    """A line that stands 40 times in two unlike texts is a few distinct shingles, and no likeness."""
    line = " ".join(f"l{i}" for i in range(12)) + " "
    rows = [(i, line * 40 + " ".join(f"o{i}x{j}" for j in range(60)), None, None) for i in range(30)]
    rows += [(30, line * 20 + " ".join(f"o0x{j}" for j in range(60)), None, None)]  # the same shingles
    assert jaccard(rows[0][1], rows[1][1]) < 0.2 and jaccard(rows[0][1], rows[30][1]) == 1
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(frame(spark, rows)).collect()}
    assert got == {**{i: i for i in range(30)}, 30: 0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{200 + i: 100 for i in range(50)}, 301: 300}
    assert not components(spark.createDataFrame([], "u long, v long")).count()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("src", F.lit(1)).withColumn("score", F.lit(2.0))


def test_url_rules_and_hosts(spark):
    rows = [
        (0, "http://WWW.Example.com/en/x?q#f", None), (1, "http://a.example.com/en/x", ""), (2, "http://a.example.com/de", ""), (3, "https://x.net/es/1", ""), (4, "https://x.net/esx", ""),
        (5, None, None), (6, "no host", ""), (7, "http://notexample.com/en/", ""), (8, "ftp://host?x/y://z", ""), (9, "http://B.org#a/b", ""), (9, "http://B.org#a/b", ""), (10, "://", ""), (11, "http://h\nk.org/a\nb?c", ""),
    ]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages(spark, rows)).collect())
    assert got == [
        (0, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "a.example.com", "/de", "com/", "allow"), (3, "x.net", "/es/1", "net/es/", "block"), (4, "x.net", "/esx", None, "block"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "notexample.com", "/en/", "com/", "allow"), (8, "host", "", None, "allow"), (9, "b.org", "", None, "allow"), (9, "b.org", "", None, "allow"), (10, "", "", None, "allow"), (11, "h\nk.org", "/a\nb", None, "allow"),
    ]


def test_url_walk(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(0, "http://good.com/", link("fine.org", "BOTH.org", "far.org")), (1, "http://fine.org/", link("far.org")), (2, "http://spam.org/", link("bad.net", "both.org")), (3, "http://bad.net/es/", ""), (4, "http://far.org/", ""), (5, "http://both.org/", link("bad.net", "gone.org")), (6, "http://alone.org/", "")]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, rows)).collect()}
    assert [got[i].verdict for i in range(7)] == ["allow", "allow", "block", "block", "allow", "block", "allow"]
    # the same walk on dense matrices
    hosts = ["good.com", "fine.org", "spam.org", "bad.net", "far.org", "both.org", "alone.org"]
    edges = [(0, 1), (0, 5), (0, 4), (1, 4), (2, 3), (2, 5), (5, 3)]
    for name, seed, pairs in (("trust", 0, edges), ("distrust", 3, [(b, a) for a, b in edges])):
        m = np.zeros((7, 7))
        for a, b in pairs:
            m[a, b] = 1 / sum(x == a for x, _ in pairs)
        s = np.eye(7)[seed]
        p = s
        for _ in range(url_filter.ROUNDS):
            p = url_filter.DAMPING * p @ m + (1 - url_filter.DAMPING) * s
        assert [got[i][name] for i in range(len(hosts))] == pytest.approx(p.tolist())
    assert not url_filter.judge(pages(spark, [])).count()


def test_url_walk_goes_far(spark):
    """A chain to a blocked host is distrusted from end to end, with the scores of the walk's equations."""
    n = 14
    hosts = [f"h{i}.org" for i in range(n)] + ["bad.net"]
    rows = [(i, f"http://{h}/es/", f'<a href="http://{hosts[i + 1]}/">x</a>' if i < n else "") for i, h in enumerate(hosts)]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, rows)).collect()}
    m = np.eye(n + 1, k=-1)  # against the links
    want = np.linalg.solve(np.eye(n + 1) - url_filter.DAMPING * m.T, (1 - url_filter.DAMPING) * np.eye(n + 1)[n])
    assert [got[i].distrust for i in range(n + 1)] == pytest.approx(want.tolist()) and {x.verdict for x in got.values()} == {"block"}


def brute_ngrams(text):
    plain = " " + " ".join("".join(c if c.isalpha() or c not in "0123456789_" and c.isalnum() and not c.isdigit() else " " for c in text.lower()).split()) + " "
    c = Counter(plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1))
    c.pop(" ", None)
    return c


def test_ngrams_are_counted_whole(monkeypatch):
    text = "Die übermäßige Größe 12 of_the\nThing, die die " * 30
    want = brute_ngrams(text)
    for piece in (1 << 20, 7):
        monkeypatch.setattr(language_id, "_PIECE", piece)
        codes, counts = language_id.ngrams(text)
        read = lambda c: "".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0) if c >> s & 0x1FFFFF)
        assert {read(c): n for c, n in zip(codes.tolist(), counts.tolist())} == dict(want)


def test_language_id(spark):
    r = random.Random(4)
    kinds = {"en": ["the", "thing", "and", "with", "from"], "de": ["über", "und", "nicht", "schön", "haben"], "fr": ["été", "leur", "que", "français", "mais"]}
    rows = [(i, " ".join(r.choices(kinds[k], k=40)), k, "s") for i, k in enumerate(r.choices(list(kinds), k=300))]
    train = frame(spark, [*rows, (998, None, "en", "s"), (999, "lang is null", None, "s")])
    learned = language_id.profiles(train)
    odd = [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 !! ··", "en", "s"), (1003, "und haben", None, None)]
    got = {x.doc_id: x for x in language_id.predict(frame(spark, [*rows, *odd]), learned).collect()}
    assert len(got) == 304 and all(0 <= x.score <= 1 for x in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert np.mean([got[i].lang_pred == k for i, _, k, _ in rows]) > 0.97
    nothing = language_id.predict(frame(spark, rows[:2]), language_id.profiles(frame(spark, []))).collect()
    assert [x.lang_pred for x in nothing] == ["und", "und"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_encode_as_whole_texts(name, monkeypatch):
    monkeypatch.setattr("annealjobs.llm.tokens.MOST_PIECES", 150)
    monkeypatch.setattr("annealjobs.llm.tokens._LAID", 1000)
    monkeypatch.setattr("annealjobs.llm.tokens._SLICE", 5000)
    monkeypatch.setattr("annealjobs.llm.tokens._SIGNS", 3)
    known = Words(tokenizer_path(name))
    r = random.Random(9)
    pieces = ["a", "Bc", "ß", "é", "É", "×", "÷", "ÿ", "Þ", "Ma", "ª", "µ", "ß.", "on.,", ".,", "a×.", "e\u0301", "İ", "Σ", "12", ".", "''", "'s", "'S", " ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x00", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "_", "|", "中文", "😀", ",", "!?", "The", "ing"]
    wild = ["".join(r.choices(pieces, k=r.randint(1, 30))) for _ in range(3000)]
    some = wild + texts(5) + [t or "" for t in ODD] + ["on" + "!" * 40 + " on.,", "!" * 100]
    want = [np.array(e.ids, np.uint32).tobytes() for e in known.tokenizer.encode_batch(some, add_special_tokens=False)]
    assert known.kind != "whole" and known.ids(some) == want
    for at in range(0, len(some), 40):  # small batches, of slices with nulls
        column = pa.array([None, *some])[at : at + 40]
        ids, edges = known.encoded(column)
        each = [b"", *want][at : at + 40]
        assert ids.tobytes() == b"".join(each) and np.diff(edges).tolist() == [len(x) // 4 for x in each] == known.counts(column).tolist()


def test_token_output(spark, docs, monkeypatch):
    rows, df = docs
    tokenizer = Words(tokenizer_path("word_bpe_49k.json")).tokenizer
    want, start = [], 0
    for d, t, *_ in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    monkeypatch.setattr(token_output, "BLOCK_DOCS", 7)
    assert sorted(map(tuple, token_output.token_files(df).collect())) == want
    assert not token_output.token_files(frame(spark, [])).count()
    assert [tuple(r)[:3] for r in token_output.token_files(frame(spark, [(3, None, None, None)])).collect()] == [(3, 0, 1)]
    twice = token_output.token_files(frame(spark, [(3, "a b", None, None), (3, "a b", None, None), (None, "c", None, None)])).collect()
    assert sorted((r.doc_id is not None, r.start, r.n_tokens) for r in twice) == [(False, 0, 2), (True, 2, 3), (True, 5, 3)]


def test_token_files_know_their_dictionary(spark, docs):
    out = scratch(spark, "tokens")
    token_output.write_tokens(docs[1], tokenizer_path("word_bpe_49k.json"), out)
    other = scratch(spark, "tokens")
    spark.read.parquet(f"{out}/dictionary").withColumn("dict_hash", F.lit("0")).write.parquet(f"{other}/dictionary")
    spark.read.parquet(f"{out}/shards").write.parquet(f"{other}/shards")
    with pytest.raises(Exception, match="needs dictionary"):
        token_output.read_tokens(spark, other).collect()


def test_chats(spark):
    marks = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "\\", "<", "[", " [/INST] ", "é\n", "[INST] x [/INST]", "s>", "$1"]
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "a</s>b", ""]), r.choice([None, "", *("".join(r.choices(marks, k=r.randint(1, 6))) for _ in range(8))])) for c in range(60) for t in range(r.randint(1, 5))]
    rows += [(60, 1, "b", "x"), (60, 1, "a", "x"), (60, 1, "a", "x"), (60, None, "z", "first"), (None, 0, "user", "q"), (61, 0, "assistant", "long " * 200_000 + "</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")).withColumn("plain", F.lit("clash"))
    out = chat_format.format_chats(df.repartition(7))
    assert out.where("NOT exact").count() == 0 and out.where("escaped").count() and out.where("NOT escaped").count()
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0, (x[2] or "").encode(), (x[3] or "").encode())):
        want[c].append((role or "", text or ""))
    got = {x.conv_id: ([tuple(t) for t in x.turns], x.loss) for x in chat_format.read_chats(out).collect()}
    assert got == {c: (t, "".join(x for role, x in t if role == "assistant")) for c, t in want.items()}
    assert not chat_format.format_chats(df.limit(0)).count()


def test_mixing(spark, docs):
    rows, df = docs
    got = mixing.copies(df, mixing.n_words(F.col("text"))).collect()
    sizes, weights = Counter(), {}
    for _, t, _, s in rows:
        sizes[s] += len(words_of(t))
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = (5, 2, 1)[i % 3]
    total, full = sum(sizes.values()), {}
    while True:  # as the contract says it: stop, and share the excess again
        rest = total - sum(full.values())
        goal = {s: rest * weights[s] / sum(w for x, w in weights.items() if x not in full) for s in sizes if s not in full}
        over = {s: 3.0 * sizes[s] for s in goal if goal[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    goal |= full
    source = {d: s for d, _, _, s in rows}
    assert all(r.target == pytest.approx(goal[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]] for r in got)
    assert all(int(goal[source[r.doc_id]] / r.source_size) <= r.copies <= 3 for r in got) and len(got) == len(rows)
    again = mixing.copies(df.repartition(9), mixing.n_words(F.col("text"))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert not mixing.copies(frame(spark, []), mixing.n_words(F.col("text"))).count()
    assert [r.copies for r in mixing.copies(frame(spark, [(1, None, None, "a"), (2, " ", None, "b")]), mixing.n_words(F.col("text"))).collect()] == [0, 0]


def brute_dedup(rows, length):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(d, first.get(s, d))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize(("length", "width", "piece"), [(50, 16, 1 << 19), (20, 8, 64), (50, 50, 1 << 19), (8, 3, 1 << 19)])
def test_suffix_dedup(spark, docs, length, width, piece, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(suffix_dedup, "_PIECE", piece)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup_spans(df, length, width).collect()}
    assert got == brute_dedup([(d, t) for d, t, *_ in rows], length)


@pytest.mark.parametrize(("rows_of_a_trigger", "least"), [(20_000, 2), (3, 10_000), (3, 2), (40, 2)])
def test_suffix_dedup_of_a_passage_everywhere(spark, monkeypatch, rows_of_a_trigger, least):
    """A passage, and a shorter expression in ever other surroundings, in all documents: frequent phrases and triggers."""
    monkeypatch.setattr(suffix_dedup, "MOST_ROWS", rows_of_a_trigger)
    monkeypatch.setattr(suffix_dedup, "LEAST_FREQUENT", least)
    r = random.Random(least)
    passage, short = " ".join(r.choices(VOCABULARY, k=40)), "an expression of under fifty bytes"
    some = [" ".join([*r.choices(VOCABULARY, k=r.randint(0, 9)), passage, *r.choices(VOCABULARY[:3], k=2), short, *r.choices(VOCABULARY[:4], k=6)]) for _ in range(120)]
    order = r.sample(range(500), len(some))
    rows = [(d, t, None, None) for d, t in zip(order, some)]
    triggers, pairs = suffix_dedup.frequent(suffix_dedup._rows(frame(spark, rows)))
    assert (len(triggers) > 0 and len(pairs) > 0) == (least == 2)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.dedup_spans(frame(spark, rows)).collect()}
    assert got == brute_dedup([(d, t) for d, t, *_ in rows], 50)


def test_suffix_dedup_edges(spark):
    period = [(i, ("ab" * 40)[i % 2 :] + "c" * i, None, None) for i in range(9)]
    zeros = [(20, "\x00" * 60, None, None), (21, "\x00" * 59 + "x", None, None), (22, "x" * 49, None, None), (23, "x" * 49, None, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup_spans(frame(spark, period + zeros)).collect()}
    assert got == brute_dedup([(d, t) for d, t, *_ in period + zeros], 50)
    assert not suffix_dedup.dedup_spans(frame(spark, [])).count()
    twice = suffix_dedup.dedup_spans(frame(spark, [(5, "y" * 60, None, None)] * 2 + [(None, "y" * 60, None, None)])).collect()
    assert [r.n_removed for r in twice] == [0, 0, 0]


def brute_stats(text):
    text = text or ""
    w = words_of(text)
    chars = sum(len(x.decode()) for x in w)
    lines = text.split("\n")
    worded = [line for line in lines if words_of(line)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), chars, sum(text.count(c) for c in "#*$%&|<>"), len(worded) - len(set(worded)), len(inside)


def test_quality_base(spark, docs):
    rows, df = docs
    repeated = [(900, "a b c a b c a b c " * 20, None, None), (901, "l one\nl one\n \n \nl one", None, None)]
    df = df.unionByName(frame(spark, repeated))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    for d, t, *_ in rows + repeated:
        r, want = got[d], brute_stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert not quality.judge(frame(spark, []), labels).count()


def test_quality_rules_are_learned(spark):
    r = random.Random(8)
    good = [" ".join(r.choices(VOCABULARY, k=90)) for _ in range(260)]
    junk = [" ".join(x + "%%%" for x in r.choices(VOCABULARY, k=90)) for _ in range(60)] + [" ".join(x.upper() for x in r.choices(VOCABULARY, k=90)) for _ in range(60)]
    df = frame(spark, [(i, t, None, None) for i, t in enumerate(good + junk)])
    labels = spark.createDataFrame([(i, int(i < 260), 0) for i in range(380) if i % 3] + [(1, None, None), (5000, 0, 0)], "doc_id long, quality int, toxic int").withColumn("n_words", F.lit(0))
    kept = {x.doc_id: x.kept for x in quality.judge(df, labels).collect()}
    assert np.mean([kept[i] for i in range(260)]) > 0.99 and np.mean([kept[i] for i in range(260, 380)]) < 0.05


def brute_leaks(docs, items, threshold=0.8):
    out = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        for item, x in items:
            v = x.encode().lower().split() if x else []
            if not v:
                continue
            best = max(((decontaminate.similarity(w[i : i + len(v)], v), -i) for i in range(len(w) - len(v) + 1)), default=(0, 0))
            if best[0] >= threshold:
                out[d, item] = (-best[1], len(v), pytest.approx(best[0]))
    return out


def test_decontamination(spark):
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(12, 60)))) for i in range(40)] + [(90, "the the"), (91, None), (92, ""), (93, "A b a b a b a b a b a b a b"), (94, "five words is not much")]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 200))), None, None) for i in range(60)]
    for i in range(60):
        t = items[i % 40][1].split()
        if i % 3:
            t[r.randrange(len(t))] = "other"
        rows.append((100 + i, " ".join([*r.choices(vocabulary, k=30), *[x.upper() if i % 2 else x for x in t], *r.choices(vocabulary, k=20)]), None, None))
    rows += [(300, None, None, None), (301, "the the", None, None), (302, "a b " * 9, None, None), (303, "x five words is not much y", None, None), (304, items[3][1], None, None), (304, items[3][1], None, None)]
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("fp", F.lit("clash"))
    want = brute_leaks([x[:2] for x in rows], items)
    for words in (1_000_000, 300):  # one pass, and several
        got = {(x.doc_id, x.item_id): (x.start, x.n_words, x.similarity) for x in decontaminate.contaminated(frame(spark, rows), bench, slice_words=words).collect()}
        assert got == want
    assert len(want) > 30
    assert not decontaminate.contaminated(frame(spark, []), bench).count() and not decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count()


def test_short_documents_leak(spark):
    """A document shorter than an item is compared as a whole."""
    r = random.Random(13)
    items = [(i, " ".join(r.choices([f"w{i}" for i in range(400)], k=k))) for i, k in enumerate((59, 59, 40, 24, 12, 7, 5))]
    cuts = [(i, n, w[at : len(w) - n + at]) for i, t in items for w in [t.split()] for n in range(1, min(16, len(w))) for at in (0, n // 2)]
    rows = [(k, " ".join(w), None, None) for k, (_, _, w) in enumerate(cuts)]
    want = {(d, i): s for d, t, *_ in rows for i, x in items if len(t.split()) < len(x.split()) and (s := decontaminate.similarity(t.encode().split(), x.encode().split())) >= 0.8}
    got = {(x.doc_id, x.item_id): (x.start, x.n_words, x.similarity) for x in decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: (0, len(cuts[k[0]][2]), pytest.approx(s)) for k, s in want.items()} and len(want) > 40


def test_token_counts_and_their_cache(spark, docs, monkeypatch):
    rows, df = docs
    cache = scratch(spark, "cache")
    tokenizer = Words(tokenizer_path("byte_bpe_50k.json")).tokenizer
    want = {d: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows}
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, cache).collect()}
        assert got == want
        stored = spark.read.parquet(cache)
        assert stored.count() == len({(t or "") for _, t, *_ in rows})
    other = token_counts.count_tokens(df, cache, tokenizer_path("word_bpe_49k.json")).count()
    assert other == len(rows) and spark.read.parquet(cache).select("version").distinct().count() == 2
    more = token_counts.count_tokens(frame(spark, [(1, "new one", None, None), (1, "new one", None, None)]), cache, limit=1).collect()
    assert [(r.n_tokens, r.over_limit) for r in more] == [(2, True)] * 2
    assert not token_counts.count_tokens(frame(spark, []), cache).count()


def test_pipeline_as_a_whole(spark, tmp_path):
    """run() against each stage by brute force; copies of the mix may be the floor or the ceiling of a source's rate."""
    import corpus_pipeline

    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(r.choices(vocabulary, k=20))) for i in range(6)]
    made = [r.choices(vocabulary, k=r.randint(55, 150)) for _ in range(90)]
    made += [["edit", *made[i][1:]] for i in range(25)] + [list(made[30])] * 4  # near and exact copies
    made += [[*r.choices(vocabulary, k=40), *items[i % 6][1].split(), *r.choices(vocabulary, k=40)] for i in range(12)]  # leaks
    made += [r.choices(vocabulary, k=12) for _ in range(5)] + [["again"] * 90]  # too short, repeated
    all_texts = [" ".join(w) for w in made] + [None, "", "\n "]
    order = r.sample(range(1000), len(all_texts))
    rows = [(d, t, None, r.choice(["a", "a", "a", "b", "c", None])) for d, t in zip(order, all_texts)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    stats = {d: brute_stats(t) for d, t, *_ in rows}
    left = {d: (t, s) for d, t, _, s in rows if stats[d][0] >= 50 and 100 * stats[d][4] <= 50 * stats[d][0]}
    like = [(a, b) for a in left for b in left if a < b and jaccard(left[a][0], left[b][0]) >= 0.8]
    left = {d: left[d] for d, first in reference_groups(left, like).items() if d == first}
    leaks = {d for d, _ in brute_leaks([(d, t) for d, (t, _) in left.items()], items)}
    left = {d: x for d, x in left.items() if d not in leaks}
    assert len(like) >= 25 and len(leaks) >= 12 and 80 <= len(left) < len(rows) - 40
    sizes = Counter()
    for t, s in left.values():
        sizes[s] += len(words_of(t))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full, over = {}, {None}
    while over:
        rest = sum(sizes.values()) - sum(full.values())
        goal = {s: rest * weights[s] / sum(w for x, w in weights.items() if x not in full) for s in sizes if s not in full}
        over = {s: 3.0 * sizes[s] for s in goal if goal[s] > 3 * sizes[s]}
        full |= over
    rate = {s: x / sizes[s] for s, x in (goal | full).items()}

    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda x: x.start)
    times = Counter(x.doc_id for x in got)
    assert set(times) <= set(left) and [x.doc_id for x in got] == sorted(x.doc_id for x in got)
    assert all(int(rate[s] + 1e-9) <= times[d] <= int(rate[s] - 1e-9) + 1 for d, (_, s) in left.items())
    tokenizer, start = Words(tokenizer_path("word_bpe_49k.json")).tokenizer, 0
    for x in got:
        ids = [*tokenizer.encode(left[x.doc_id][0], add_special_tokens=False).ids, 2]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


@pytest.mark.parametrize("slots", [1, 7, 1 << 20])
def test_verified_pairs(spark, monkeypatch, slots):
    """Few slots let more texts through, and change no pair."""
    monkeypatch.setattr(shared, "SLOTS", slots)
    rows = [(i, t, None, None) for i, t in enumerate(t for t in texts(31) if len(t.split()) > 5)] + [(-5, None, None, None), (None, "null id", None, None)]
    known = [(a, b) for a in range(0, 70, 3) for b in range(60, 75) if a < b]
    of = {d: t for d, t, *_ in rows}
    digest = lambda d: bytearray(simhash._digest(simhash.shingle_set(of[d].encode(), 5)))
    pairs = spark.createDataFrame([(a, a, digest(a), b, b, digest(b)) for a, b in known], "u long, doc_u long, digest_u binary, v long, doc_v long, digest_v binary")
    got = {(x.u, x.v) for x in simhash.verified(pairs, frame(spark, rows + [(known[0][0], "another text of one id", None, None)]), 5, 0.8).collect()}
    assert got == {(a, b) for a, b in known if jaccard(of[a], of[b]) >= 0.8} and got


def test_rank_order_by_brute_force(spark):
    """Profiles, distances and predictions of texts that were not trained on."""
    r = random.Random(14)
    kinds = {k: ["".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(60)] for k, letters in (("en", "abcdefgh"), ("de", "efghijüö"), ("fr", "hijklmné"))}
    rows = [(i, " ".join(r.choices(kinds[k], k=r.randint(1, 60))), k, "s") for i, k in enumerate(r.choices(list(kinds), k=150))]
    train, test, top = rows[:90], rows[90:] + [(900, "xyz", None, None)], 40
    rank = {}
    for k in kinds:
        counts = sum((brute_ngrams(t) for _, t, lang, _ in train if lang == k), Counter())
        rank[k] = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:top])}
    learned = language_id.profiles(frame(spark, train), top)
    assert {(x.lang, x.code): x.rank for x in learned.collect()} == {(k, code(g)): i for k, p in rank.items() for g, i in p.items()}
    got = {x.doc_id: x for x in language_id.predict(frame(spark, test), learned, top).collect()}
    right = 0
    for d, t, lang, _ in test:
        counts = brute_ngrams(t)
        own = sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]
        far = {k: sum(abs(p[g] - i) if g in p else top for i, g in enumerate(own)) / (top * len(own)) for k, p in rank.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert got[d].lang_pred == best and got[d].score == pytest.approx(1 - far[best])
        right += best == lang
    assert right > 0.9 * (len(test) - 1)


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_conditions_in_spark_and_in_numpy(spark):
    """The ordered expression rejects what the learner's conditions hold for."""
    r = np.random.default_rng(4)
    n = 400
    rows = r.integers(0, 40, (n, len(quality._COUNTS)))
    df = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(rows)], quality.STATS)
    column = {c: rows[:, i].astype(float) for i, c in enumerate(quality._COUNTS)}
    x = {f: column[a] / np.maximum(column[b], 1) if b else column[a] for f, (a, b) in quality.FEATURES.items()}
    rules = [tuple(quality.Condition(f, bool(r.integers(2)), float(r.choice(x[f]))) for f in r.choice(list(x), 2)) for _ in range(6)]
    want = np.zeros(n, bool)
    for rule in rules:
        want |= np.logical_and.reduce([c.holds(x) for c in rule])
    got = df.select("doc_id", quality.rejects(rules).alias("no")).collect()
    assert {g.doc_id: g.no for g in got} == dict(enumerate(want.tolist())) and 0 < want.sum() < n
    nested = df.select("doc_id", F.struct(*quality._COUNTS).alias("s")).select("doc_id", quality.rejects(rules, "s").alias("no"), quality.base_failed("s").alias("base"))
    assert {g.doc_id: (g.no, g.base) for g in nested.collect()} == {i: (bool(w), True) for i, w in enumerate(want)}  # under 50 words, all
    assert [g.no for g in df.limit(2).select(quality.rejects([]).alias("no")).collect()] == [False, False]


def test_mixing_comes_near_its_targets(spark):
    """Within five standard deviations of the draw, and never over three times a document."""
    r = random.Random(16)
    rows = [(i, " ".join(["w"] * r.randint(1, 40)), None, r.choice("aaaaaaaabbbbcde")) for i in range(6000)]
    got = mixing.copies(frame(spark, rows), mixing.n_words(F.col("text"))).collect()
    taken, squares, goal, source = Counter(), Counter(), {}, {d: s for d, _, _, s in rows}
    for x in got:
        s = source[x.doc_id]
        taken[s] += x.copies * x.size
        rate = x.target / x.source_size
        squares[s] += x.size**2 * (rate % 1) * (1 - rate % 1)
        goal[s] = x.target
        assert 0 <= x.copies <= 3
    assert all(abs(taken[s] - goal[s]) <= 5 * squares[s] ** 0.5 + 1e-6 for s in goal) and sum(taken.values()) == pytest.approx(sum(x.size for x in got), rel=0.03)
    whole = Counter(x.doc_id for x in mixing.mixed(frame(spark, rows), mixing.n_words(F.col("text"))).collect())
    assert {x.doc_id: x.copies for x in got if x.copies} == dict(whole)


HARD = [("ambiguous", "string"), ("row", "int"), ("key", "string"), ("times", "int"), ("copy__", "int"), ("s", "string"), ("rate", "double"), ("n_words", "int"), ("slot", "int"), ("doc.id", "string")]


def hard_documents(spark, rows):
    """Rows (doc_id, text, source) with columns named as stages might name theirs."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` {t}" for n, t in HARD)
    fill = [{"string": "clash", "int": 3, "double": 0.5}[t] for _, t in HARD]
    return spark.createDataFrame([(d, t, None, s, 7, *fill) for d, t, s in rows], schema)


def small_folder(spark, path, rows, labels=(), items=()):
    hard_documents(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "http://a.com/en/x", "<a href='http://b.net/es/'>"), (2, None, None), (3, "http://b.net/es/", "")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(5, 0, "user", "hi"), (5, 1, "assistant", "</s>"), (6, 0, "user", None)], "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")


def test_stages_and_their_hard_cases(spark, tmp_path):
    """Null ids, repeated rows, clashing columns, odd texts: each stage by itself, and all of them."""
    import corpus_pipeline

    r = random.Random(17)
    words = [f"w{i}" for i in range(900)]
    long = [" ".join(r.choices(words, k=80)) for _ in range(12)]
    item = " ".join(r.choices(words, k=15))
    rows = [(i, t, "abc"[i % 3]) for i, t in enumerate(long)]
    rows += [(3, long[3], "a"), (3, "too short", "a"), (None, "too short", None), (None, long[0], "b"), (None, f"{long[5]} {item}", None), (20, f"{long[6]} {item}", "a"), (21, long[7], None), (22, None, "a"), (23, "", "b"), (24, " \n", "a")]
    rows += [(None, None, None)]
    small_folder(spark, tmp_path, rows, items=[(1, item), (2, None), (3, "the")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    told = lambda df: sorted(((x.doc_id, x.text, x.source) for x in df.collect()), key=str)
    at = dict(corpus_pipeline.STAGES)
    want = {
        "quality rules": [x for x in rows if len((x[1] or "").split()) >= 50],
        "simhash near-dedup": [x for x in rows if x[0] not in (20, 21, 23, 24)],
        "benchmark decontamination": [x for x in rows if item not in (x[1] or "")],
    }
    # null, empty and blank texts are one group; 20 is document 6 and an item: more than 0.8
    assert jaccard(rows[6][1], f"{long[6]} {item}") >= 0.8
    for name, left in want.items():
        out = at[name](spark, docs, str(tmp_path))
        assert told(out) == sorted(left, key=str) and out.columns == docs.columns, name
    mixed = at["mixing sources"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and set(told(mixed)) <= set(rows)
    tokens = at["token output"](spark, docs, str(tmp_path)).collect()
    assert sorted(str(x.doc_id) for x in tokens) == sorted(str(d) for d, *_ in rows)
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {d for d, t, _ in rows if d is None or (len((t or "").split()) >= 50 and d not in (20, 21))}
    assert {x.doc_id for x in done} <= kept
    for name, stage in corpus_pipeline.STAGES:
        assert not stage(spark, docs.limit(0), str(tmp_path)).count(), name


def test_every_query_on_a_small_folder(spark, tmp_path):
    from annealjobs.llm import registry

    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts(41, 24) + ODD)]
    small_folder(spark, tmp_path, rows, [(i, i % 2, 0) for i in range(20)], [(1, rows[0][1]), (2, "a b")])
    columns = {
        "op1": ["doc_id", "fingerprint", "component_id"], "op2": ["page_id", "host", "path", "rule", "verdict"], "op3": ["doc_id", "held_out", "lang_pred", "score"], "op4": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op5": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], "op6": ["doc_id", "size", "source_size", "target", "taken"], "op7": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op8": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op9": ["doc_id", "item_id"], "op10": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op11": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"], "op12": ["lang", "source", "part", "item", "value", "rank"], "op13": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    }
    out = {}
    for name, f in registry.QUERIES.items():
        df = f(spark, str(tmp_path))
        assert set(columns[name.split("_")[0]]) <= set(df.columns)
        out[name.split("_")[0]] = df.collect()
    assert all(len(out[k]) == len(rows) for k in ("op1", "op3", "op4", "op6", "op7", "op8", "op10", "op11", "op13")) and len(out["op2"]) == len(out["op5"]) == 3
    assert {x.doc_id: x.fingerprint for x in out["op1"]} == {d: f"{reference_fp(t):016x}" for d, t, _ in rows}
    assert {x.doc_id: x.held_out for x in out["op3"]} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, *_ in rows}
    assert {x.doc_id: x.kept_sha256 for x in out["op7"]} == {d: hashlib.sha256(x[3]).hexdigest() for d, x in brute_dedup([(d, t) for d, t, _ in rows], 50).items()}
    assert all(x.doc_id == 0 and x.item_id == 1 or jaccard(rows[x.doc_id][1], rows[0][1]) > 0 for x in out["op9"]) and out["op9"]
    assert all(x.over_limit == (x.n_tokens > 1024) for x in out["op10"])
