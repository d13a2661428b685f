"""Operator 13 against brute force over all starts of all templates, and on odd tables."""

import random
import re

import pytest

from annealjobs.llm import licenses

SCHEMA = "doc_id long, text string, lang string, word string, labels string, n string"


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def stands(words, phrase, lo, hi):
    k = words_of(phrase)
    return any(words[s : s + len(k)] == k for s in range(max(0, lo), min(len(words), hi) - len(k) + 1))


def brute(text, share=licenses.SHARE):
    words, labels, score, places, base = words_of(text), set(), 0.0, [], set()
    for phrase, label in licenses.PHRASES:
        k = words_of(phrase)
        own = [i for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k]
        places += own
        base |= {label} if own else set()
    for t in licenses.TEMPLATES:
        own = words_of(t.text)
        n, d = len(own), len(own) // 10
        for o in range(-n - d, len(words) + d):
            hit = sum(own[j] in words[max(0, o + j - d) : max(0, o + j + d + 1)] for j in range(n))
            if hit >= share * n and all(stands(words, k, o - d, o + n + d) for k in t.keys):
                labels.add(t.label)
                score = max(score, hit / n)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score


def texts():
    r = random.Random(5)
    filler = ["lorem", "the", "of", "License", "software", "and", "é", "GNU", "public", "v", "2", "0", "rights"]
    out = [None, "", "  ", "Mit", "under THE mit-License!", "CC BY-NC 4.0 cc by nc by nc", "apache license version 2" * 3, "apache license, version 2.0", "underthe mit license", "ALL RIGHTS RESERVED", "all rights were reserved", "GNU General Public License version 3"]
    for t in licenses.TEMPLATES:
        w = t.text.split(" ")
        out.append(t.text)
        out.append("before " * 30 + t.text + " after" * 30 + "\n" + r.choice(licenses.TEMPLATES).text)
        for p in (0.05, 0.1, 0.2, 0.3):
            out.append(" ".join(x for x in w if r.random() > p))  # words that are gone
            out.append(" ".join(x if r.random() > p else r.choice(filler) for x in w))  # others in their place
            out.append(" ".join(y for x in w for y in ([r.choice(filler)] if r.random() < p else []) + [x]))  # more words
        out.append(" ".join(r.sample(w, len(w))))  # out of order
    out += [" ".join(r.choices(filler, k=r.randint(1, 80))) for _ in range(60)]
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_against_brute_force(spark, parts):
    rows = [(i if i % 7 else None, t, *["clash"] * 4) for i, t in enumerate(texts())]
    rows += rows[:6]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)


def test_rare_words_are_those_of_few_documents(spark):
    docs = spark.createDataFrame([("software public domain",)] * 5 + [("unencumbered",), (None,)], "text string")
    n = licenses.document_frequencies(docs, [b"software", b"public", b"unencumbered", b"free"])
    assert n == {b"software": 5, b"public": 5, b"unencumbered": 1}
    scanner = licenses.Scanner(licenses.TEMPLATES[-1:], (), n)
    indexed = {w for w, k in scanner.number.items() if scanner.is_rare[k]}
    assert b"software" not in indexed and b"public" not in indexed and len(indexed) == 11 - 9 + 1


def test_empty_and_long(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "word, " * 300_000 + licenses.TEMPLATES[3].text + " ß" * 300_000 + " under the MIT license"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tuple(licenses.scan(docs).first()) == (1, 600_025, 1, 600_021, 600_021, "mit", "bsd,mit", 1.0)
