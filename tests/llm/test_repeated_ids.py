"""Rows of one doc_id with different texts: each is judged by its own, and none is lost for another's."""

import random

import pytest

import corpus_pipeline
from annealjobs.llm import decontaminate, simhash, suffix_dedup, token_output, url_filter


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n))


A, B, C = words(1, 60), words(2, 60), words(3, 60)
SCHEMA = "doc_id long, text string, content string, variant string, doc string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 3) for r in rows], SCHEMA).repartition(3)


def removed(rows, length=50):
    """By brute force: bytes that go from each row."""
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        before = {(x or "").encode()[i : i + length] for e, x in rows if d is not None and e is not None and e < d for i in range(len((x or "").encode()) - length + 1)}
        gone = set()
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in before:
                gone.update(range(i, i + length))
        out.append((d, len(raw), len(gone), bytes(x for i, x in enumerate(raw) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_several", [0, 100_000])
@pytest.mark.parametrize(("most_rows", "least"), [(20_000, 100), (2, 1)])
def test_suffix_dedup(spark, monkeypatch, most_rows, least, most_several):
    monkeypatch.setattr(suffix_dedup, "MOST_ROWS", most_rows)
    monkeypatch.setattr(suffix_dedup, "LEAST_FREQUENT", least)
    monkeypatch.setattr(suffix_dedup, "MOST_SEVERAL", most_several)
    shared = words(9, 12)
    rows = [(1, A), (2, A), (2, B), (2, None), (3, f"{B[:200]} {C}"), (3, f"x {shared} y"), (4, f"{C[60:]} {shared}"), (4, words(4, 40)), (None, A), (5, f"{shared}{A[40:160]}"), (5, f"{shared}{A[50:170]}")]
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.dedup_spans(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == removed(rows)
    assert (2, len(B), 0, B.encode()) in got


def test_simhash_links_a_documents_texts(spark):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame(spark, [(1, A), (2, A), (2, B), (3, B), (4, C), (None, B), (5, words(5, 9)), (5, C)])).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 1), (5, 4)}


def test_near_dedup_keeps_unlike_texts(spark):
    near = A + " more"
    rows = [(1, A), (2, A), (2, B), (3, near), (3, C), (4, B), (4, None), (5, ""), (None, A), (2, A)]
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert kept.columns == ["doc_id", "text", "content", "variant", "doc"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, A), (2, B), (3, C), (4, None), (None, A)], key=repr)


def test_near_dedup_of_texts_linked_to_an_earlier_document(spark):
    """Document 2's first text goes, its second, which nothing is like, stays."""
    rows = [(1, A + " end"), (2, A), (2, B), (7, B + " end")]
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert kept == {(1, A + " end"), (2, B)}


def test_token_files_have_a_row_for_every_text(spark):
    got = token_output.token_files(frame(spark, [(2, "a b c"), (2, "d"), (1, None), (2, "d")])).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 2, 2] and len({(r.doc_id, r.start) for r in got if r.n_tokens}) == 4


def test_short_items(spark):
    items = spark.createDataFrame([(1, "who wrote hamlet play"), (2, "Yes"), (3, ""), (4, None), (5, "two words"), (6, words(6, 5))], "item_id long, text string")
    rows = [(1, "who wrote hamlet play"), (1, "no"), (2, "x WHO  wrote\nhamlet play? y"), (3, "so who wrote Hamlet play then"), (4, "yes yes"), (5, "two, words"), (6, "a two words b two words"), (7, words(6, 5)), (8, None), (9, "who wrote hamlet")]
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in decontaminate.contaminated(frame(spark, rows), items).collect()}
    assert got == {(1, 1): (0, 4, 1.0), (3, 1): (1, 4, 1.0), (4, 2): (0, 1, 1.0), (6, 5): (1, 2, 1.0), (7, 6): (0, 5, 1.0)}


@pytest.mark.parametrize("more", [20, 200_000])
def test_verdicts_do_not_depend_on_the_size_of_the_crawl(spark, more):
    """A host two links from a blocked one is blocked, however many other pages are."""
    link = lambda h: f'<a href="http://{h}/">x</a>'
    pages = spark.createDataFrame([(1, "http://two.org/", link("one.org")), (2, "http://one.org/", link("a.net")), (3, "http://a.net/es/", ""), (4, None, None), (5, "nothing", "x")], "page_id long, url string, html string")
    far = spark.range(more).selectExpr("id + 10 AS page_id", "concat('http://h', id, '.net/fr/') AS url", "'' AS html")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages.unionByName(far)).where("page_id < 10").collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}
