"""Operator 1: SimHash near-dedup by bit-sliced comparison.

Fingerprints are compared only within buckets: 64 bits are cut in radius + 2 blocks, two of which must
agree for every pair within the radius, so each fingerprint enters one bucket per pair of blocks and no
pair is lost. The fingerprints of buckets are stored as vertical bit planes (one 64-bit word holds
one bit of 64 fingerprints); distances of many lanes are updated at once by carry-save counters made of
bitwise operations, and words whose 64 lanes all exceed the radius are abandoned. Small buckets share
one set of planes, compared with itself shifted by 1, 2, ... lanes; a larger one is compared with each of
its fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annealjobs.llm.components import components
from annealjobs.llm.shared import forget, lowered_words, majority, pieces, runs, saved, scratch, shingles, small_batches, table, texts_of, utf8

RADIUS = 3
#: Fingerprints of a bucket that one task compares at once; larger buckets are dealt out as pairs of chunks.
CHUNK = 8192
#: Fingerprints of whole buckets that are compared in one step.
TOGETHER = 1 << 15
#: Fingerprints of a bucket that shares its planes with others.
FEW = 48
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_QUERIES = 256
#: Words of 64 bits of the fingerprints that stand for a similarity rather than a radius.
WIDE = 8
#: Standard deviations that pairs of just the similarity may stand off: farther is out, nearer is verified.
SIGMAS = 3.0
#: Nodes, and shingles of nodes, of a piece of a group; a task compares two pieces.
PIECE, PIECE_SHINGLES = 1024, 1 << 20


def simhash(text: bytes, k: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text: bitwise majority of the XXH64 of its k-word shingles."""
    joined, starts, ends = shingles(lowered_words(text), k)
    h = xxhash.xxh64_intdigest
    return majority(np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every row of docs (doc_id, text); texts without a word (null, empty) have 0.

    A text is read whole, however long: its bits are summed by 32,768 shingles at a time.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t, k, seed) for t in utf8(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """Vertical storage of fingerprints (n, words): row b holds bit b of all, 64 to a word (the last word is padded)."""
    lanes = np.zeros((-(-len(fps) // 64) * 64, fps.shape[1]), np.uint64)
    lanes[: len(fps)] = fps
    bits = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _counted(x: Callable[..., np.ndarray], at: tuple[np.ndarray, ...], over: np.ndarray, bits: list[int], radius: int) -> tuple[np.ndarray, ...]:
    """Of words of lanes at `at`: which the counters can't rule out, and masks of their lanes within the radius.

    x(bit, *at) has the lanes that differ in a bit; over marks lanes that are out from the start.
    """
    live = over != _ALL
    at, over = tuple(a[live] for a in at), over[live]
    digits = [np.zeros(len(over), np.uint64) for _ in range(max(1, radius.bit_length()))]  # binary counters, one bit plane each
    for done in range(0, len(bits), 2):
        one = x(bits[done], *at)
        two = x(bits[done + 1], *at) if done + 1 < len(bits) else np.zeros_like(one)
        # carry-save adder: ones + one + two = new ones + 2 * carry
        either = digits[0] ^ one
        carry = (digits[0] & one) | (either & two)
        digits[0] = either ^ two
        for d in range(1, len(digits)):
            digits[d], carry = digits[d] ^ carry, digits[d] & carry
        over = over | carry
        if done % 8 == 6:
            live = over != _ALL  # abandon words whose lanes all exceed the radius
            if not live.all():
                at, over, digits = tuple(a[live] for a in at), over[live], [d[live] for d in digits]
                if not len(over):
                    break
    # lanes whose counter exceeds the radius without having run over: compare digit by digit
    above, equal = np.zeros_like(over), np.full_like(over, _ALL)
    for d in reversed(range(len(digits))):
        if radius >> d & 1:
            equal = equal & digits[d]
        else:
            above, equal = above | (equal & digits[d]), equal & ~digits[d]
    over = over | above
    live = over != _ALL
    return (*(a[live] for a in at), ~over[live])


def _lanes(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, lane) of each bit that is set."""
    return np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def _within(queries: np.ndarray, planes: np.ndarray, varying: list[int], radius: int) -> tuple[np.ndarray, ...]:
    """Query numbers, word numbers and masks of the lanes within the radius."""
    flips = {b: np.uint64(0) - (queries[:, b >> 6] >> np.uint64(b & 63) & np.uint64(1)) for b in varying}
    q, w = (i.ravel() for i in np.indices((len(queries), planes.shape[1])))
    return _counted(lambda b, q, w: planes[b][w] ^ flips[b][q], (q, w), np.zeros(len(q), np.uint64), varying, radius)


def _neighbours(fps: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of all pairs within the radius that share a key; equal keys stand together."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(key):
        return a[0], b[0]
    planes = _planes(fps)
    bits, words = list(range(len(planes))), np.arange(planes.shape[1])
    padded = np.pad(planes, ((0, 0), (0, len(key) // 64 + 2)))

    def shifted(bit: int, w: np.ndarray, off: int) -> np.ndarray:
        """Words of a plane whose lane i is lane i + off."""
        w, r = w + (off >> 6), np.uint64(off & 63)
        return (padded[bit][w] >> r) | (padded[bit][w + 1] << (np.uint64(64) - r)) if r else padded[bit][w]

    for off in range(1, len(key)):
        same = np.zeros(64 * len(words), bool)
        same[: len(key) - off] = key[off:] == key[:-off]
        if not same.any():
            break
        w, mask = _counted(lambda bit, w, off=off: planes[bit][w] ^ shifted(bit, w, off), (words,), ~np.packbits(same, bitorder="little").view(np.uint64), bits, radius)
        k, lane = _lanes(mask)
        i = w[k] * 64 + lane
        a.append(i)
        b.append(i + off)
    return np.concatenate(a), np.concatenate(b)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches over the links a - b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Positions (a, b) of a spanning forest of the graph that links fingerprints (n, words) within the radius."""
    label, out = np.arange(len(fps)), []
    for i, js in _sliced(fps, radius) if len(fps) > 1 else ():
        for root in np.unique(label[js]).tolist():
            mine = label[i]
            if root != mine:
                out.append((i, int(js[np.argmax(label[js] == root)])))
                label[label == max(root, mine)] = min(root, mine)
    return out


def _sliced(fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each position with those after it that are within the radius."""
    planes = _planes(fps)
    differ = np.bitwise_or.reduce(fps ^ fps[0])
    varying = np.flatnonzero(np.unpackbits(differ.view(np.uint8), bitorder="little")).tolist()
    for at in range(0, len(fps), _QUERIES):
        q, w, mask = _within(fps[at : at + _QUERIES], planes[:, at // 64 :], varying, radius)
        for some in np.array_split(np.arange(len(q)), max(1, len(q) // 4096)):
            k, lane = _lanes(mask[some])
            i, j = q[some][k] + at, (w[some][k] + at // 64) * 64 + lane
            keep = (j > i) & (j < len(fps))
            i, j = i[keep], j[keep]
            cuts = np.flatnonzero(np.diff(i)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)]):
                if s < e:
                    yield int(i[s]), j[s:e]


def linked(key: np.ndarray, node: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) of nodes that connect, in each bucket, what fingerprints (n, words) within the radius connect.

    Stars of what small buckets connect, forests in others; equal keys stand together.
    """
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    size = np.repeat(np.diff(starts), np.diff(starts))
    few = np.flatnonzero((size > 1) & (size <= FEW))
    label = _labels(len(few), *_neighbours(fps[few], key[few], radius))
    own = np.flatnonzero(label != np.arange(len(few)))
    u, v = [node[few[own]]], [node[few[label[own]]]]
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if e - s > FEW:
            pairs = np.array(links(fps[s:e], radius), np.int64).reshape(-1, 2)
            u.append(node[s + pairs[:, 0]])
            v.append(node[s + pairs[:, 1]])
    return np.concatenate(u), np.concatenate(v)


def _bucket_keys(fp: Column, radius: int) -> Column:
    """One key for each pair of blocks: the pair's number and the bits of both blocks."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for t, pair in enumerate(combinations(range(blocks), 2)):
        mask = sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in pair)
        keys.append(F.xxhash64(F.lit(t), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def _chunk_pairs(large: DataFrame) -> DataFrame:
    """Rows of large (key, chunk, ...) once for each pair of chunks of their key; key becomes the pair's."""
    chunks = large.groupBy("key").agg((F.max("chunk") + 1).alias("n"))
    pairs = large.join(chunks, "key").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return pairs.withColumn("key", F.xxhash64("key", F.least("chunk", "o"), F.greatest("chunk", "o"))).drop("chunk", "n", "o")


def bucket_links(keyed: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) that connect, in each bucket, what fingerprints within the radius connect; keyed: (key long, fp binary, node long).

    Buckets over chunk fingerprints leave the first pass as chunks, each pair of which is a group of the
    second, so that no link is lost in them and no task holds more than two chunks and a batch.
    """
    small_batches(keyed.sparkSession)

    def of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(t.num_rows, -1)
        return linked(t.column("key").to_numpy(), t.column("node").to_numpy(), fps, radius)

    def compared(tables: list[pa.Table]) -> pa.RecordBatch:
        u, v = of(pa.concat_tables(tables))
        none = [pa.nulls(len(u), k) for k in (pa.int64(), pa.int32(), pa.binary())]
        return pa.RecordBatch.from_arrays([*none, pa.array(u), pa.array(v)], ["key", "chunk", "fp", "u", "v"])

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[pa.Table] = []
        for number, t in pieces(batches, "key", chunk):
            if number < 0:
                whole.append(t)
                if sum(x.num_rows for x in whole) >= TOGETHER:
                    yield compared(whole)
                    whole = []
            else:
                own = t.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), pa.array(np.full(len(own), number, np.int32)), t.column("fp").combine_chunks(), own, own], ["key", "chunk", "fp", "u", "v"])
        if whole:
            yield compared(whole)

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "key"):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in of(t)], ["u", "v"])

    found = saved(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(first, "key long, chunk int, fp binary, u long, v long"), "links")
    edges, large = found.where("key IS NULL").select("u", "v"), found.where("key IS NOT NULL")
    if large.isEmpty():
        return edges
    pairs = _chunk_pairs(large).select("key", "fp", F.col("u").alias("node"))
    return edges.unionByName(pairs.repartition("key").sortWithinPartitions("key").mapInArrow(second, "u long, v long"))


def near_links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) that connect what fingerprints within the radius connect; nodes: (node, fp long), distinct."""
    little = F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp")  # the order of bytes does not matter to distances
    return bucket_links(nodes.select(F.explode(_bucket_keys(F.col("fp"), radius)).alias("key"), little, "node"), radius, chunk)


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = RADIUS, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of docs (doc_id, text): groups linked within the radius.

    component_id is the smallest doc_id that links reach, the document itself included. Null and empty
    texts have fingerprint zero and link like any other; a null doc_id takes the smallest doc_id of its
    group (null if there is none); rows that repeat a doc_id keep one row each, and where their texts differ the
    document links what any of them does; other columns are ignored. Copies of a fingerprint are folded into one
    node before comparing, so hot groups cost one row.
    """
    fps = saved(fingerprints(docs, k, seed), "fingerprints")
    by_fp = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    edges = near_links(by_fp.where("node IS NOT NULL"), radius, chunk)
    several = fps.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("doc_id")
    own = fps.join(several, "doc_id", "left_semi").select("doc_id", "fp").distinct().join(by_fp, "fp")
    groups = components(edges.unionByName(own.select(F.col("doc_id").alias("u"), F.col("node").alias("v"))))
    ids = by_fp.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def _angle(similarity: float) -> float:
    """Share of bits that differ, in expectation, between texts of this Jaccard similarity and equal length."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_radius(similarity: float, words: int = WIDE, sigmas: float = SIGMAS) -> int:
    """Bits within which texts of the similarity stand, but for chance beyond so many standard deviations.

    Negative sigmas: bits within which hardly any pair of less than the similarity stands.
    """
    p, bits = _angle(similarity), 64 * words
    return int(p * bits + sigmas * math.sqrt(bits * p * (1 - p)))


def table_shape(n: int, similarity: float, miss: float = 0.005) -> tuple[int, int]:
    """Bits of a key, so that unlike texts seldom share one of n buckets, and tables, so that like texts miss all with that chance."""
    bits = max(16, math.ceil(math.log2(max(2, n))))
    return bits, math.ceil(math.log(miss) / math.log(1 - (1 - _angle(similarity)) ** bits))


def shingle_set(text: bytes, k: int, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct k-word shingles of a text, sorted."""
    joined, starts, ends = shingles(lowered_words(text), k)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def _digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def content(docs: DataFrame) -> Column:
    """Tells the texts of rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def wide_fingerprints(docs: DataFrame, k: int, words: int = WIDE, seed: int = 42) -> DataFrame:
    """(doc_id, content, fp binary, digest binary, n int): fingerprints of words x 64 bits over distinct shingles; the set's digest and size.

    Further words are majorities of remixed shingle hashes.
    """
    small_batches(docs.sparkSession)

    def one(text: bytes) -> tuple[bytes, bytes, int]:
        h = own = shingle_set(text, k, seed)
        out = []
        for _ in range(words):
            out.append(majority(h))
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return np.array(out, np.uint64).tobytes(), _digest(own), len(own)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, digest, n = zip(*map(one, utf8(b.column(2)))) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.binary()), pa.array(digest, pa.binary()), pa.array(n, pa.int32())], ["doc_id", "content", "fp", "digest", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), content(docs).alias("content"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, content long, fp binary, digest binary, n int")


def wide_links(nodes: DataFrame, radius: int, bits: int, tables: int, words: int = WIDE, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) that connect, in each bucket of each table, what fingerprints within the radius connect; nodes: (node, fp binary).

    A table's key is its own choice of bits.
    """
    rng = np.random.default_rng(bits)
    chosen = [np.sort(rng.choice(64 * words, bits, replace=False)) for _ in range(tables)]
    place = 1 << np.arange(bits, dtype=np.int64)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):  # a row a table: bounds what a batch becomes
                part = b.slice(at, 500)
                fps = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, 8 * words)
                on = np.unpackbits(fps, axis=1, bitorder="little")
                key = np.concatenate([(on[:, c].astype(np.int64) @ place) + (t << bits) for t, c in enumerate(chosen)])
                again = pa.array(np.tile(np.arange(part.num_rows), tables))
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column(1).take(again), part.column(0).take(again)], ["key", "fp", "node"])

    small_batches(nodes.sparkSession)
    return bucket_links(nodes.select("node", "fp").mapInArrow(keys, "key long, fp binary, node long"), radius, chunk)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    return texts_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), wanted)


def verified(pairs: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """(u, v) of those of pairs (u, doc_u, digest_u, v, doc_v, digest_v) whose texts have the Jaccard similarity: distinct k-word shingles, shared over united.

    A node's text is that of its doc whose shingles have its digest. Texts of hash slots that no pair falls in
    are left out before texts are shuffled.
    """
    small_batches(docs.sparkSession)
    texts = _texts(docs, pairs.select(F.explode(F.array("doc_u", "doc_v")).alias("doc_id")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like = []
            for x, y, dx, dy in zip(utf8(b.column(2)), utf8(b.column(3)), b.column(4).to_pylist(), b.column(5).to_pylist()):
                x, y = shingle_set(x, k), shingle_set(y, k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                like.append(both >= similarity * (len(x) + len(y) - both) - 1e-9 and (_digest(x), _digest(y)) == (dx, dy))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(like, pa.bool_()))

    both = pairs.join(texts.toDF("doc_u", "a"), "doc_u").join(texts.toDF("doc_v", "b"), "doc_v")
    return both.select("u", "v", "a", "b", "digest_u", "digest_v").mapInArrow(run, "u long, v long")


def _like(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Positions (a, b) of a forest that connects what pairs of the similarity do, beyond equal labels.

    Where sets of both sides are given, only pairs of two sides count. Sets are not empty.
    """
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    starts = ends - size
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    label, mark, out = label.copy(), np.zeros(flat.max() + 1, bool), []
    two = len(np.unique(side)) > 1
    for i in range(len(sets) - 1):
        other = label[i + 1 :] != label[i]
        if two:
            other &= side[i + 1 :] != side[i]
        other &= np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i]) - 1e-9
        js = np.flatnonzero(other) + i + 1
        if not len(js):
            continue
        mark[flat[starts[i] : ends[i]]] = True
        for at in range(0, len(js), 256):  # bounds memory, and spares sets that a link has joined
            some = js[at : at + 256]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            on = mark[np.concatenate([flat[starts[j] : ends[j]] for j in some.tolist()])]
            both = np.add.reduceat(on, np.cumsum(size[some]) - size[some], dtype=np.int64)
            for j in some[both >= similarity * (size[some] + size[i] - both) - 1e-9].tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
        mark[flat[starts[i] : ends[i]]] = False
    return out


def exact_links(members: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Edges (u, v) that connect what pairs of the similarity connect within each group, every pair compared.

    members: (node, doc, digest, label, group, chunk, chunks); a node's text is that of its doc whose shingles have
    the digest, and pairs of one label are connected beforehand. Each pair of a group's chunks is a task's work: no pair is a row.
    """
    small_batches(docs.sparkSession)

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, k) for t in utf8(b.column(0))]
            same = [_digest(x) == d for x, d in zip(sets, b.column(1).to_pylist())]
            kept = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in sets], pa.binary()), *b.columns[2:]], ["own", *b.schema.names[2:]])
            yield kept.filter(pa.array(same, pa.bool_()))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "key"):
            key, node, label, side = (t.column(c).to_numpy() for c in ("key", "node", "label", "side"))
            sets = t.column("own")
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            u, v = [], []
            for s, e in zip(cuts, cuts[1:]):
                found = _like([np.frombuffer(x, np.uint64) for x in sets.slice(s, e - s).to_pylist()], label[s:e], side[s:e], similarity)
                u += [node[s + i] for i, _ in found]
                v += [node[s + j] for _, j in found]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    texts = _texts(docs, members.select(F.col("doc").alias("doc_id")))
    both = texts.join(members, texts["doc_id"] == members["doc"]).drop("doc_id", "doc").distinct()  # repeated rows once
    held = both.select("text", "digest", "node", "label", "group", "chunk", "chunks").mapInArrow(own, "own binary, node long, label long, group long, chunk int, chunks int")
    pairs = held.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = pairs.select(F.xxhash64("group", F.least("chunk", "o"), F.greatest("chunk", "o")).alias("key"), "node", "label", F.expr("CAST(chunk > o AS INT)").alias("side"), "own")
    return pairs.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "u long, v long")


def similar_documents(docs: DataFrame, k: int = 5, similarity: float = 0.8, words: int = WIDE, seed: int = 42) -> DataFrame:
    """(doc_id, content, component_id) for every row of docs: groups linked at a similarity of k-word shingles.

    64 bits can't tell a similarity of 0.8: its pairs differ by ten bits, more or less by three. Here
    fingerprints have words x 64 bits, and what shares a bucket in one of table_shape(n, similarity) tables and
    stands within the similarity's distance is connected to a group. Inside each group every pair that other
    links leave open is compared by the exact similarity of its texts: no other link counts. Groups over a piece
    first have the links that made them verified, and are compared only where those do not join them whole.
    Texts of the same shingles are one node. Nulls, repeats and other columns as in near_duplicates, but
    that texts of one doc_id that differ are nodes of their own, and rows take the component of their own text;
    content(docs) tells them apart.
    """
    spark = docs.sparkSession
    paths: list[str] = []

    def kept(df: DataFrame, what: str) -> DataFrame:
        paths.append(scratch(spark, what))
        return saved(df, what, paths[-1])

    fps = saved(wide_fingerprints(docs, k, words, seed), "fingerprints")
    # a node is a number of its own, as a doc_id may have several texts
    folded = fps.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.min("fp").alias("fp"), F.min("n").alias("n"))
    nodes = saved(folded.select("*", F.monotonically_increasing_id().alias("node")), "nodes")
    known = nodes.where("doc IS NOT NULL")
    by_fp = kept(known.groupBy("fp").agg(F.min("node").alias("first")), "by-fp")
    bits, tables = table_shape(by_fp.count(), similarity)
    radius = wide_radius(similarity, words)
    near = kept(wide_links(by_fp.select(F.col("first").alias("node"), "fp"), radius, bits, tables, words).distinct(), "near")
    grouped = by_fp.join(components(near).toDF("first", "least"), "first", "left").select("fp", F.coalesce("least", "first").alias("group"))
    grouped = kept(known.where("n > 0").join(grouped, "fp").select("node", "doc", "digest", "n", "group"), "grouped")
    chunks = F.ceil(F.greatest(F.count("*") / F.lit(PIECE), F.sum("n") / F.lit(PIECE_SHINGLES))).cast("int").alias("chunks")
    sizes = kept(grouped.groupBy("group").agg(chunks, F.count("*").alias("members")).where("members > 1"), "groups")
    # the links of groups over a piece, to tell those that are whole
    large = grouped.join(sizes.where("chunks > 1"), "group")
    side = lambda x: large.select(F.col("node").alias(x), F.col("doc").alias(f"doc_{x}"), F.col("digest").alias(f"digest_{x}"))
    made = near.join(side("u"), "u").join(side("v"), "v")
    joined = kept(components(verified(made, docs, k, similarity)), "joined")
    label = F.coalesce("component", "node")
    labelled = kept(grouped.join(sizes, "group").join(joined, "node", "left").withColumn("label", label), "labelled")
    whole = labelled.groupBy("group").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a = b").select("group")
    chunk = F.pmod(F.xxhash64("node", "digest"), F.col("chunks")).cast("int").alias("chunk")
    members = labelled.join(whole, "group", "left_anti").select("node", "doc", "digest", "label", "group", chunk, "chunks")
    groups = components(joined.toDF("u", "v").unionByName(exact_links(members, docs, k, similarity)))
    for path in paths:
        forget(spark, path)
    found = nodes.join(groups, "node", "left").select("digest", "doc", F.coalesce("component", "node").alias("component"))
    least = found.groupBy("component").agg(F.min("doc").alias("component_id"))
    return fps.join(found.join(least, "component"), "digest").select("doc_id", "content", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
