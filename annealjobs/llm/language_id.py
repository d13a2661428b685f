"""Operator 3: language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3 letters, words padded by
a blank). A document's own most frequent n-grams are compared with each profile by out-of-place
distance: the sum of rank differences, with a fixed penalty for n-grams that the profile lacks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annealjobs.llm.shared import small_batches, table, unsigned_crc32

TOP, SIZES, TRAIN_ROWS = 300, (1, 2, 3), 4000
#: Languages whose profiles go to every task.
MOST_LANGUAGES = 10_000
_BREAKS = re.compile(r"[\W\d_]+")
_BITS = 21  # a code point; n-grams of up to three fit 63 bits
_PIECE = 1 << 20


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a lower-cased text whose non-letters are single blanks."""
    plain = f" {_BREAKS.sub(' ', text.lower()).strip()} "
    codes, counts = [], []
    for at in range(0, len(plain), _PIECE):  # bounds the memory of very long texts; pieces overlap so that none is lost
        c = np.frombuffer(plain[at : at + _PIECE + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        own = min(_PIECE, len(plain) - at)
        for n in SIZES:
            code = c[: max(0, len(c) - n + 1)].copy()
            for i in range(1, n):
                code = code << _BITS | c[i : len(c) - n + 1 + i]
            # an n-gram is of letters with a blank at its ends at most; a blank alone says nothing
            code = code[:own]
            found, k = np.unique(code[c[: len(code)] != 32] if n == 1 else code, return_counts=True)
            codes.append(found)
            counts.append(k)
    if len(codes) <= len(SIZES):
        return np.concatenate(codes), np.concatenate(counts)
    all_codes, where = np.unique(np.concatenate(codes), return_inverse=True)
    return all_codes, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The top most frequent codes, most frequent first; ties by code."""
    return codes[np.lexsort((codes, -counts))[:top]]


def _letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def profiles(labelled: DataFrame, top: int = TOP, train_rows: int = TRAIN_ROWS, seed: int = 1) -> DataFrame:
    """(lang, code, rank) from labelled (doc_id, text, lang): n-gram counts summed over the texts of a language.

    The fit reads a bounded sample: train_rows documents of each language in expectation, chosen by a
    hash of doc_id. Null languages and null texts are left out.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    share = rows.groupBy("lang").agg((F.lit(float(train_rows)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # one row a language: where they are few (checked), texts need not move to meet them
    share = F.broadcast(share) if len(share.take(10_001)) <= 10_000 else share
    sample = rows.select("doc_id", "text", "lang").join(share, "lang").where(draw < F.col("share")).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if _letters(text):
                    codes, counts = ngrams(text)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

    totals = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return totals.withColumn("rank", place - 1).where(F.col("rank") < top).select("lang", "code", "rank")


def distances(codes: np.ndarray, known: dict[str, tuple[np.ndarray, np.ndarray]], top: int) -> list[tuple[float, str]]:
    """Out-of-place distance, over the worst there is, to each language."""
    out = []
    for lang, (sorted_codes, ranks) in known.items():
        at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
        hit = sorted_codes[at] == codes
        apart = np.where(hit, np.abs(ranks[at] - np.arange(len(codes))), top)
        out.append((float(apart.sum()) / (top * len(codes)), lang))
    return sorted(out)


def predict(docs: DataFrame, learned: DataFrame, top: int = TOP) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs (doc_id, text) under profiles (lang, code, rank).

    und with score 0 where the text is null or has no letter, or nothing was learned; ties go to the
    first language by code point. The score is 1 minus the distance over the worst there is. Texts are read
    whole; rows that repeat are predicted alike, also without a doc_id; other columns are ignored; an empty
    table gives an empty result. The profiles, top rows a language, are a model: they go to every task, and
    over MOST_LANGUAGES of them are an error.
    """
    small_batches(docs.sparkSession)
    rows = learned.limit(MOST_LANGUAGES * top + 1).collect()  # the fit runs once
    if len({r.lang for r in rows}) > MOST_LANGUAGES or len(rows) > MOST_LANGUAGES * top:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    by_lang: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append((r.code, r.rank))
    for lang, pairs in by_lang.items():
        both = np.array(sorted(pairs), np.int64)
        known[lang] = both[:, 0].copy(), both[:, 1].copy()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = [], []
            for text in b.column(1).to_pylist():
                if not known or text is None or not _letters(text):
                    lang.append("und")
                    score.append(0.0)
                    continue
                best, name = distances(ranked(*ngrams(text), top), known, top)[0]
                lang.append(name)
                score.append(min(1.0, max(0.0, 1.0 - best)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(unsigned_crc32(F.col("doc_id")) % 5 == 0, F.lit(True))
    learned = profiles(docs.where(~held_out))
    return predict(docs, learned).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
