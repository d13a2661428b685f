"""Operator 9: benchmark decontamination by SimHash of item-sized windows.

Every window of a document with as many words as a benchmark item has a fingerprint over its 5-word
shingles, taken from running sums of the shingles' bits; only windows that hold no shingle of any item of
that many words get none, as their similarity is zero. Multi-index Hamming search finds items: with four
16-bit blocks, two fingerprints within RADIUS = 4 * 5 - 1 bits differ by at most 4 bits in some block, so
each item enters the index under all values within 4 bits of each of its blocks, and each different
fingerprint looks up its own four. Candidates are then verified by the exact weighted Jaccard similarity
of their shingle multisets, in the documents that have any.

A document shorter than an item is one window, all of it, looked up among items of each number of words
that the similarity allows. An item of fewer than five words is one shingle, which stands or does not.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from annealjobs.llm.shared import lowered_words, majority, saved, shingles, small_batches, table, texts_of, utf8

SHINGLE, SIMILARITY, RADIUS, SEED = 5, 0.8, 19, 42
#: Words of benchmark text that one pass over the documents takes to every task; more text, more passes.
SLICE_WORDS = 1_000_000
#: Windows whose bits one step sums.
_PIECE = 8192
_STEP = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(words: list[bytes], k: int = SHINGLE) -> int:
    joined, starts, ends = shingles(words, k)
    return majority(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def similarity(a: list[bytes], b: list[bytes], k: int = SHINGLE) -> float:
    """Weighted Jaccard similarity: shared over united shingles, each as often as it stands there."""
    x, y = (Counter(j[s:e] for s, e in zip(starts, ends)) for j, starts, ends in (shingles(a, k), shingles(b, k)))
    return (x & y).total() / max(1, (x | y).total())


class _Items:
    """What tasks need of a slice of the benchmark: its vocabulary, and its shingles by number of words."""

    def __init__(self, texts: list[bytes]):
        self.number: dict[bytes, int] = {}
        by_size: dict[int, set[int]] = defaultdict(set)
        for text in texts:
            words = lowered_words(text)
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.uint64)
            by_size[len(words)].update(self.codes(ids, min(len(words), SHINGLE)).tolist())
        self.short = {size: np.sort(np.fromiter(by_size[size], np.uint64)) for size in range(1, SHINGLE) if by_size.get(size)}
        by_size = {size: c for size, c in by_size.items() if size >= SHINGLE}
        codes = np.concatenate([np.fromiter(c, np.uint64, len(c)) for c in by_size.values()] or [np.zeros(0, np.uint64)])
        sizes = np.concatenate([np.full(len(c), size) for size, c in by_size.items()] or [np.zeros(0, int)])
        order = np.lexsort((sizes, codes))
        self.codes_, self.sizes = codes[order], sizes[order]  # each shingle under every size of item that has it

    @staticmethod
    def codes(ids: np.ndarray, k: int = SHINGLE) -> np.ndarray:
        """A rolling code of each k words; 64 bits, so that a rare collision only lets a window pass."""
        out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) * _STEP + ids[i : i + len(out)]
        return out

    def windows(self, words: list[bytes], threshold: float) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
        """(first words, number of words, number of the item's words, fingerprints) of windows that share a shingle with an item."""
        ids = np.fromiter((self.number.get(w, 0) for w in words), np.uint64, len(words))
        for size, codes in self.short.items():  # as many words as the item has, and one shingle
            starts = np.flatnonzero(np.isin(self.codes(ids, size), codes))
            for i in range(0, len(starts), _PIECE):
                part = starts[i : i + _PIECE]
                yield part, size, size, np.array([fingerprint(words[a : a + size]) for a in part.tolist()], np.uint64)
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        at = np.flatnonzero(known[SHINGLE:] - known[:-SHINGLE] == SHINGLE) if len(ids) >= SHINGLE else []
        if not len(at) or not len(self.codes_):
            return
        codes = self.codes(ids)[at]
        lo, hi = np.searchsorted(self.codes_, codes, "left"), np.searchsorted(self.codes_, codes, "right")
        n = hi - lo
        where = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        hits, sizes = np.repeat(at, n), self.sizes[where]
        for size in np.unique(sizes).tolist():
            s, mine = size - SHINGLE + 1, hits[sizes == size]
            if len(words) < size:
                own = len(words) - SHINGLE + 1
                if own >= threshold * s - 1e-9:  # the similarity is at most own / s
                    yield np.zeros(1, np.int64), len(words), size, np.array([fingerprint(words)], np.uint64)
                continue
            edge = np.zeros(len(words) - size + 2, np.int64)
            np.add.at(edge, np.maximum(mine - s + 1, 0), 1)
            np.add.at(edge, np.minimum(mine, len(words) - size) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for i in range(0, len(run), _PIECE):
                    part = run[i : i + _PIECE]
                    yield part, size, size, rolling_fingerprints(words[part[0] : part[-1] + size], s)


def rolling_fingerprints(words: list[bytes], s: int) -> np.ndarray:
    """The fingerprint of every s shingles of the words that follow one another."""
    joined, starts, ends = shingles(words, SHINGLE)
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(2 * (sums[s:] - sums[:-s]) > s, axis=1, bitorder="little").view(np.uint64).ravel()


_WINDOWS = "start int, n_words int, item_words int, fp long"


def window_fingerprints(docs: DataFrame, items: list[bytes], threshold: float) -> DataFrame:
    """doc_id and _WINDOWS of docs (doc_id, text) that share a shingle with an item of so many words."""
    small_batches(docs.sparkSession)
    held = _Items(items)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, size = [], 0
            for row, text in enumerate(utf8(b.column(1))):
                for part in held.windows(lowered_words(text), threshold):
                    parts.append((row, *part))
                    size += len(part[0])
                    if size >= 1 << 16:
                        yield batch(b.column(0), parts)
                        parts, size = [], 0
            yield batch(b.column(0), parts)

    def batch(ids: pa.Array, parts: list[tuple]) -> pa.RecordBatch:
        rows, starts, own, sizes, fps = zip(*parts) if parts else [()] * 5
        n = np.array([len(x) for x in starts], np.int64)
        flat = lambda x, kind: pa.array(np.repeat(np.array(x, kind), n))
        start, fp = (np.concatenate([np.zeros(0, k), *x]).astype(k) for x, k in ((starts, np.int32), (fps, np.uint64)))
        return pa.RecordBatch.from_arrays([ids.take(flat(rows, np.int64)), pa.array(start), flat(own, np.int32), flat(sizes, np.int32), pa.array(fp.view(np.int64))], ["doc_id", "start", "n_words", "item_words", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {_WINDOWS}")


def _block(fp: str, i: str | int) -> str:
    return f"CAST(shiftrightunsigned({fp}, 16 * {i}) & 65535 AS INT)"


def _verified(near: DataFrame, docs: DataFrame, items: list[list[bytes]], numbers: list[int], threshold: float) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity) of near (doc_id, start, n_words, item: position in items) that hold the similarity."""
    wanted = near.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n_words", "item")).alias("near"))
    texts = texts_of(docs, wanted)
    rows = texts.join(wanted.withColumnRenamed("doc_id", "near_id"), F.col("doc_id").eqNullSafe(F.col("near_id"))).select("doc_id", "text", "near")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, int], float] = {}
        for b in batches:
            row, out = [], []
            for i, (text, some) in enumerate(zip(utf8(b.column(1)), b.column(2).to_pylist())):
                words = lowered_words(text)
                for w in some:
                    part = words[w["start"] : w["start"] + w["n_words"]]
                    key = b" ".join(part), w["item"]
                    if key not in seen:
                        if len(seen) >= 4096:
                            seen.clear()
                        seen[key] = similarity(part, items[w["item"]])
                    if seen[key] >= threshold - 1e-12:
                        row.append(i)
                        out.append((numbers[w["item"]], w["start"], w["n_words"], seen[key]))
            cols = list(zip(*out)) or [[]] * 4
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *arrays], ["doc_id", "item_id", "start", "n_words", "similarity"])

    return rows.mapInArrow(run, f"doc_id {kind}, item_id long, start int, n_words int, similarity double")


def candidates(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(item_words, fp, item) of fingerprints within the radius; windows (item_words, fp), items (item, item_words, item_fp).

    Each different fingerprint is looked up once, however many windows have it.
    """
    per_block = radius // 4
    flips = F.lit(np.array([f for f in range(1 << 16) if f.bit_count() <= per_block], np.int32))
    blocks = F.explode(F.array(*[F.lit(b) for b in range(4)])).alias("block")
    index = items.select("*", blocks).select("*", F.explode(flips).alias("flip"))
    index = index.select("item", "item_words", "item_fp", "block", F.expr(f"{_block('item_fp', 'block')} ^ flip").alias("value"))
    looked = windows.select("item_words", "fp").distinct().select("*", blocks).withColumn("value", F.expr(_block("fp", "block")))
    near = looked.join(index, ["item_words", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    return near.select("item_words", "fp", "item").distinct()  # several blocks may find a pair


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): each document's best window for each item it holds.

    docs (doc_id: an integer or a string, text), benchmark (item_id, text). Words are runs of anything but
    ASCII white space, A-Z lower-cased. A document with fewer words than an item is one window. An item of fewer
    than five words matches where its words stand one after the other; items without a word, and null texts, match
    nothing; ties go to the first window; repeated items each count under their ids; rows of one doc_id, or of none, are one document, of which
    any text counts; other columns are ignored; empty tables give an empty result. Benchmarks over
    slice_words take several passes, each with a slice of items chosen by hash, so that what goes to the
    tasks is bounded.
    """
    spark = docs.sparkSession
    doc_id = F.col("doc_id") if docs.schema["doc_id"].dataType == StringType() else F.col("doc_id").cast("long")
    docs = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    words = texts.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    slices, found = max(1, -(-int(words) // slice_words)), None
    for i in range(slices):
        some = texts if slices == 1 else texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i)
        rows = [(r.item_id, lowered_words(r.text.encode())) for r in some.collect()]  # a bounded slice
        rows = [(item, w) for item, w in rows if w]
        windows = saved(window_fingerprints(docs, [b" ".join(w) for _, w in rows], threshold), "windows")
        items = spark.createDataFrame([(k, len(w), int(np.uint64(fingerprint(w)).astype(np.int64))) for k, (_, w) in enumerate(rows)], "item int, item_words int, item_fp long")
        near = windows.join(candidates(windows, items, radius), ["item_words", "fp"])
        sure = _verified(near, docs, [w for _, w in rows], [item for item, _ in rows], threshold)
        found = sure if found is None else found.unionByName(sure)
    best = F.max_by(F.struct("start", "n_words", "similarity"), F.struct(F.col("similarity"), -F.col("start"))).alias("w")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "w.start", "w.n_words", "w.similarity")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
