"""Operator 7: suffix-array dedup by prefix-free parsing.

A rolling hash picks triggers: the smallest of the trigger-width windows inside each `length`-byte string.
Strings with the same trigger, taken together, are one phrase, so phrases overlap, no phrase is a proper
prefix of what another cut of the same bytes would give, and equal bytes give equal phrases wherever
they stand. The parse is a table (trigger, phrase, document, place). A string never leaves its phrase, so
the parse's suffixes need ordering by their first phrase only: where a whole phrase stands in an earlier
document, that order (trigger, phrase, document) answers for all strings in it. Only triggers with several
different phrases need more: the suffixes of those phrases, the dictionary, are sorted per trigger, and
equal neighbours of `length` bytes are matched. Both orders together are the corpus order of all suffixes
cut at `length` bytes, but copies cost one phrase, not one suffix each.

Frequent triggers and phrases are found first, all of them, and their rows are dealt out further: phrases
of a frequent trigger by the phrase, rows of a frequent phrase by the document. Triggers with more phrases
than one task sorts are parted by what stands about the trigger: a string holds either the bytes after it
or those before it, half of what the string has besides. What even then is too much for one task has its
suffixes grouped by Spark instead.

Phrases are taken as equal where the 64-bit hashes of both trigger and phrase are: among 10^14 phrases two
different ones agree in those 128 bits with a chance under 10^-10.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annealjobs.llm.shared import runs, saved, small_batches, table, utf8

LENGTH, TRIGGER = 50, 16
_STEP = 0x9E3779B97F4A7C15  # odd, so powers can be undone modulo 2**64
_UNDO = pow(_STEP, -1, 1 << 64)
_PLACES = 20  # bits of a place within a piece; pieces are shorter than 2**20 bytes
_PIECE = 1 << 19
_WHOLE = -1
#: Rows of a trigger in the parse that one task sorts; what has more is grouped by Spark.
MOST_ROWS = 20_000
#: A trigger or phrase is frequent with this share of the parse's rows, and this many rows: at most 4,000 of each are named.
FREQUENT, LEAST_FREQUENT, SALTS = 1 / 2000, 100, 256
#: Doc_ids of several texts that may be sent to every task.
MOST_SEVERAL = 100_000


def _byte_values(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)


_VALUES = _byte_values(7)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of the rolling hash's step and of its inverse, as far as pieces reach."""

    def __init__(self, n: int):
        self.up, self.down = np.full(n + 1, _STEP, np.uint64), np.full(n + 1, _UNDO, np.uint64)
        for a in (self.up, self.down):
            a[0] = 1
            np.cumprod(a, out=a)


def parse(data: np.ndarray, ends: np.ndarray, powers: _Powers, length: int = LENGTH, width: int = TRIGGER) -> tuple[np.ndarray, ...]:
    """Phrases of texts that stand one after the other in data; ends: where each text ends.

    Arrays trigger hash, phrase hash, number of the text, first start, number of starts, and the trigger's
    place after the first start: the phrase covers the strings of length bytes at those starts, all of which
    share the trigger.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers.up[:n], out=sums[1:])
    h = _mixed((sums[width:] - sums[:-width]) * powers.down[: n - width + 1])
    low = np.uint64((1 << _PLACES) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    span, reach, count = length - width + 1, 1, n - length + 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:count], least[span - reach : span - reach + count])
    trigger = (least & low).astype(np.int64)
    text = np.searchsorted(ends, np.arange(count), "right")
    valid = np.arange(count) + length <= ends[text]
    cut = np.ones(count + 1, bool)
    cut[1:-1] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    edges = np.flatnonzero(cut)
    lo, hi = edges[:-1], edges[1:]
    lo, hi = lo[valid[lo]], hi[valid[lo]]
    phrase = (sums[hi - 1 + length] - sums[lo]) * powers.down[lo] + (hi - lo).astype(np.uint64) * np.uint64(_UNDO)
    return h[trigger[lo]], _mixed(phrase), text[lo], lo, hi - lo, trigger[lo] - lo


def _parsed(b: pa.RecordBatch, powers: _Powers, length: int, width: int, piece: int) -> Iterator[tuple[np.ndarray, ...]]:
    """trigger, phrase, doc_id, variant and place (first start * 64 + number of starts) of the phrases of a batch (doc_id, variant, text).

    Of equal texts in one batch only the smallest doc_id is parsed; the others give one row with place -1.
    """
    first: dict[bytes, tuple[int, int]] = {}
    copies: list[tuple[int, int]] = []
    for doc_id, variant, text in sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)))):
        if len(text) >= length and first.setdefault(text, (doc_id, variant))[0] < doc_id:
            copies.append((doc_id, variant))
    pieces: list[tuple[tuple[int, int], int, bytes]] = [(d, at, t[at : at + piece // 2 + length - 1]) for t, d in first.items() for at in range(0, len(t) - length + 1, piece // 2)]
    while pieces:
        some, size = [], 0
        while pieces and (not some or size + len(pieces[-1][2]) <= piece):
            some.append(pieces.pop())
            size += len(some[-1][2])
        data = np.frombuffer(b"".join(p[2] for p in some), np.uint8)
        ends = np.cumsum([len(p[2]) for p in some])
        trigger, phrase, text, lo, n, _ = parse(data, ends, powers, length, width)
        ids, base = np.array([p[0] for p in some], np.int64)[text], (np.array([p[1] for p in some]) - ends + [len(p[2]) for p in some])[text]
        yield trigger, phrase, ids[:, 0].copy(), ids[:, 1].copy(), (base + lo) << 6 | n
    if copies:
        own, variant = np.array(copies, np.int64).T.copy()
        yield _mixed(own.view(np.uint64)), own.view(np.uint64), own, variant, np.full(len(own), _WHOLE)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, variant, text) of docs: variant is 0, but for doc_ids of several texts, which it tells apart."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = rows.select("doc_id", own.alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    several = saved(texts.where("doc_id IS NOT NULL AND a != b").select(F.col("doc_id").alias("several")), "several")
    n = several.count()
    if not n:
        return rows.select("doc_id", F.lit(0).cast("long").alias("variant"), "text")
    marked = rows.join(F.broadcast(several) if n <= MOST_SEVERAL else several, F.col("doc_id") == F.col("several"), "left")
    return marked.select("doc_id", F.when(F.col("several").isNull(), F.lit(0).cast("long")).otherwise(own).alias("variant"), "text")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.where("doc_id IS NOT NULL AND text IS NOT NULL")


def frequent(rows: DataFrame, length: int = LENGTH, width: int = TRIGGER) -> tuple[np.ndarray, np.ndarray]:
    """Triggers, and hashes of (trigger, phrase), with at least the share FREQUENT of all rows of the parse.

    Batches name what has half that share of them. What has the share over all is named for at least half of its
    rows, so nothing is missed, and asking for so many named rows bounds the number of what is found.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers(_PIECE + 2 * length)
        for b in batches:
            parts = list(_parsed(b, powers, length, width, _PIECE))
            if not parts:
                continue
            trigger, phrase = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            least = max(1, len(trigger) * FREQUENT / 2)
            kind, key, n = [2], [0], [len(trigger)]
            for k, keys in enumerate((trigger, _mixed(trigger ^ phrase))):
                found, count = np.unique(keys, return_counts=True)
                kind += [k] * int((count >= least).sum())
                key += found[count >= least].view(np.int64).tolist()
                n += count[count >= least].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["kind", "key", "n"])

    named = saved(_texts(rows).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "frequent")
    n = named.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    found = named.where((F.col("kind") < 2) & (F.col("n") >= max(LEAST_FREQUENT, n * FREQUENT / 2))).collect()
    return tuple(np.array(sorted(r.key for r in found if r.kind == k), np.int64).view(np.uint64) for k in (0, 1))


_PARSE = "part long, trigger long, phrase long, doc_id long, variant long, place long, frequent int"


def phrases(rows: DataFrame, length: int = LENGTH, width: int = TRIGGER) -> DataFrame:
    """_PARSE of every row of _rows. Rows of a part are to meet: those of a trigger, of a frequent trigger's phrase (frequent = 1), or of a document's salt of a frequent phrase (2)."""
    triggers, pairs = frequent(rows, length, width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers(_PIECE + 2 * length)
        for b in batches:
            for trigger, phrase, ids, variant, place in _parsed(b, powers, length, width, _PIECE):
                pair = _mixed(trigger ^ phrase)
                kind = np.where(np.isin(pair, pairs), 2, np.where(np.isin(trigger, triggers), 1, 0))
                salt = ids.view(np.uint64) % np.uint64(SALTS)
                part = np.where(kind == 2, _mixed(pair + salt), np.where(kind == 1, pair, trigger))
                columns = [part.view(np.int64), trigger.view(np.int64), phrase.view(np.int64), ids, variant, place, kind.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "trigger", "phrase", "doc_id", "variant", "place", "frequent"])

    return _texts(rows).mapInArrow(run, _PARSE)


_SUFFIXES = "doc_id long, variant long, lo long, mask long, key long, bytes binary"


def _halves(t: pa.Table, length: int, width: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """doc_id, variant, place, key and bytes of the phrases' parts: strings that hold what follows the trigger, and others.

    Equal strings have their trigger at one place, so they are in parts of one key.
    """
    raw = t.column("bytes").to_pylist()
    doc, variant, place = (t.column(c).to_pylist() for c in ("doc_id", "variant", "place"))
    half = (length - width) // 2
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])
    trigger, _, text, _, _, rel = parse(data, ends, _Powers(len(data) + length), length, width)  # a phrase each
    for k, h, r in zip(text.tolist(), trigger.tolist(), rel.tolist()):
        lo, n = place[k] >> 6, place[k] & 63
        after, before = raw[k][r + width : r + length - half], raw[k][max(0, r - half - 1) : r]
        for side, about, i, j in ((b"a", after, max(0, r - half), n), (b"b", before, 0, min(n, r - half))):
            if i < j:
                key = xxhash.xxh3_64_intdigest(side + h.to_bytes(8, "little") + about)
                yield doc[k], variant[k], (lo + i) << 6 | (j - i), key - (1 << 64) if key >> 63 else key, raw[k][i : j - 1 + length]


def _sort_suffixes(length: int, width: int, then: str):
    """Groups of a key to _SUFFIXES without key and bytes: which starts of a phrase an earlier document has.

    then: what becomes of rows marked large: their halves (with key, the place as lo, and bytes), or each of
    their strings with its start, to be grouped by Spark.
    """

    def windows(t: pa.Table) -> tuple[np.ndarray, ...]:
        """Row, offset in the row and bytes of each string of the phrases."""
        n = t.column("place").to_numpy() & 63
        data = np.frombuffer(b"".join(utf8(t.column("bytes").combine_chunks())) or b"\0", np.uint8)
        at = np.cumsum(n + length - 1) - (n + length - 1)
        row = np.repeat(np.arange(len(n)), n)  # one suffix a start
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        own = np.lib.stride_tricks.sliding_window_view(data, length)[at[row] + offset] if len(row) else np.zeros((0, length), np.uint8)
        return row, offset, own

    def sorted_groups(t: pa.Table) -> pa.RecordBatch:
        key, doc, variant, place = (t.column(c).to_numpy() for c in ("key", "doc_id", "variant", "place"))
        row, offset, own = windows(t)
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        # the dictionary's suffix array: by trigger, then by the bytes of the suffix, then by document
        keys = np.empty((len(row), length + 12), np.uint8)
        keys[:, :4] = group[row].astype(">u4").view(np.uint8).reshape(-1, 4)
        keys[:, 4:-8] = own
        keys[:, -8:] = (doc[row].astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
        order = np.argsort(keys.view(f"V{length + 12}").ravel())
        suffixes = keys[order, :-8].copy().view(f"V{length + 4}").ravel()
        fresh = np.concatenate([[True], suffixes[1:] != suffixes[:-1]])
        sorted_doc = doc[row][order]
        least = sorted_doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        late = order[sorted_doc > least]
        mask = np.zeros(t.num_rows, np.int64)
        np.bitwise_or.at(mask, row[late], np.int64(1) << offset[late])
        some = mask != 0
        return batch(doc[some], variant[some], (place >> 6)[some], mask[some], pa.nulls(int(some.sum()), pa.int64()), pa.nulls(int(some.sum()), pa.binary()))

    def strings(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for i in range(0, t.num_rows, 5000):
            part = t.slice(i, 5000)
            row, offset, own = windows(part)
            doc, variant, place = (part.column(c).to_numpy() for c in ("doc_id", "variant", "place"))
            raw = pa.Array.from_buffers(pa.binary(length), len(own), [None, pa.py_buffer(np.ascontiguousarray(own))])
            yield batch(doc[row], variant[row], (place >> 6)[row] + offset, np.ones(len(row), np.int64), pa.nulls(len(row), pa.int64()), raw.cast(pa.binary()))

    def halves(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for i in range(0, t.num_rows, 5000):
            doc, variant, place, key, raw = zip(*_halves(t.slice(i, 5000), length, width))
            yield batch(np.array(doc, np.int64), np.array(variant, np.int64), np.array(place, np.int64), np.zeros(len(doc), np.int64), pa.array(key, pa.int64()), pa.array(raw, pa.binary()))

    def batch(doc: np.ndarray, variant: np.ndarray, lo: np.ndarray, mask: np.ndarray, key: pa.Array, raw: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, (doc, variant, lo, mask)), key, raw], ["doc_id", "variant", "lo", "mask", "key", "bytes"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "key"):
            large = t.column("large")
            some = t.filter(pc.invert(large))
            if some.num_rows:
                yield sorted_groups(some)
            yield from (halves if then == "halves" else strings)(t.filter(large))

    return run


def _late_strings(strings: DataFrame) -> DataFrame:
    """(doc_id, variant, lo, mask) of rows (doc_id, variant, lo, mask, bytes) whose bytes stand in an earlier document.

    The least document of a string is a pre-aggregated minimum; those of frequent strings, at most 1,000, go to
    every task.
    """
    least = saved(strings.groupBy("bytes").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "strings")
    many = F.col("n") >= max(LEAST_FREQUENT, strings.count() / 1000)
    often = F.broadcast(least.where(many).select("bytes", "least"))
    rare = strings.join(F.broadcast(least.where(many).select("bytes")), "bytes", "left_anti").join(least.where(~many), "bytes")
    both = rare.select(*_MARKS, "least").unionByName(strings.join(often, "bytes").select(*_MARKS, "least"))
    return both.where("doc_id > least").select(_MARKS)


_MARKS = ["doc_id", "variant", "lo", "mask"]


def repeated_starts(rows: DataFrame, length: int = LENGTH, width: int = TRIGGER) -> DataFrame:
    """_MARKS of _rows: starts lo + i, for each bit i of mask, of strings that an earlier document has; lo -1: all."""
    parsed = phrases(rows, length, width).repartition("part")
    of_phrase, of_trigger = Window.partitionBy("part", "trigger", "phrase"), Window.partitionBy("part", "trigger")
    seen = parsed.withColumn("first", F.min("doc_id").over(of_phrase)).withColumn("many", (F.col("frequent") > 0) | (F.min("phrase").over(of_trigger) != F.max("phrase").over(of_trigger)))
    seen = seen.withColumn("large", (F.col("frequent") > 0) | (F.count("*").over(of_trigger) > MOST_ROWS))
    seen = saved(seen.where("place = -1 OR doc_id > first OR many").select("trigger", "doc_id", "variant", "place", "first", "large", F.when(F.col("frequent") == 2, F.col("phrase")).alias("phrase")), "phrases")
    # the first document of a frequent phrase, over its parts: as few rows as there are such phrases
    firsts = seen.where("phrase IS NOT NULL").groupBy(F.col("trigger").alias("t"), F.col("phrase").alias("p")).agg(F.min("first").alias("f"))
    all_seen = seen.join(F.broadcast(firsts), (F.col("trigger") == F.col("t")) & (F.col("phrase") == F.col("p")), "left")
    all_seen = all_seen.select("trigger", "doc_id", "variant", "place", "large", (F.expr("place = -1") | (F.col("doc_id") > F.coalesce("f", "first"))).alias("known"))
    known = all_seen.where("known")
    # n ones; a phrase has at most length - width + 1 < 63 starts
    whole = known.select("doc_id", "variant", F.when(F.expr("place = -1"), F.lit(-1).cast("long")).otherwise(F.expr("place div 64")).alias("lo"), F.expr("CASE WHEN place = -1 THEN 1L ELSE shiftleft(1L, CAST(place % 64 AS INT)) - 1 END").alias("mask"))
    open_ = all_seen.where("NOT known").groupBy("doc_id", "variant").agg(F.collect_list(F.struct("trigger", "place", "large")).alias("open"))  # as long as a text at most
    texts = _texts(rows).select("doc_id", "variant", F.col("text").cast("binary").alias("raw"))
    cut = F.expr(f"transform(open, o -> struct(o.trigger AS trigger, o.place AS place, o.large AS large, substring(raw, CAST(o.place div 64 + 1 AS INT), CAST(o.place % 64 + {length - 1} AS INT)) AS bytes))")
    dictionary = texts.join(open_, ["doc_id", "variant"]).select("doc_id", "variant", F.explode(cut).alias("o")).select("o.trigger", "doc_id", "variant", "o.place", "o.large", "o.bytes").where(f"length(bytes) = place % 64 + {length - 1}")
    keyed = dictionary.withColumn("key", F.when(F.col("large"), F.xxhash64("bytes")).otherwise(F.col("trigger"))).drop("trigger")
    columns = ["key", "doc_id", "variant", "place", "large", "bytes"]
    sort = lambda rows, then: rows.select(columns).repartition("key").sortWithinPartitions("key").mapInArrow(_sort_suffixes(length, width, then), _SUFFIXES)
    suffixes = saved(sort(keyed, "halves"), "suffixes")
    out = whole.unionByName(suffixes.where("bytes IS NULL").select(_MARKS))
    halves = suffixes.where("bytes IS NOT NULL").select("key", "doc_id", "variant", F.col("lo").alias("place"), "bytes")
    if halves.isEmpty():
        return out
    # the few keys that still have too much: each stands for over MOST_ROWS rows
    many = saved(halves.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS).select("key", F.lit(True).alias("large")), "large")
    many = F.broadcast(many) if many.count() <= 100_000 else many
    marked = halves.join(many, "key", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    marked = marked.withColumn("key", F.when(F.col("large"), F.xxhash64("bytes")).otherwise(F.col("key")))
    again = saved(sort(marked, "strings"), "suffixes")
    out = out.unionByName(again.where("bytes IS NULL").select(_MARKS))
    strings = again.where("bytes IS NOT NULL").drop("key")
    return out if strings.isEmpty() else out.unionByName(_late_strings(strings))


def _remove(text: bytes, lo: np.ndarray, mask: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what stays."""
    if not len(lo):
        return 0, 0, text
    if (lo < 0).any():
        return len(text), 1, b""
    k, i = np.nonzero((mask[:, None] >> np.arange(63)) & 1)
    starts = lo[k] + i
    starts = starts[starts + length <= len(text)]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def dedup_spans(docs: DataFrame, length: int = LENGTH, width: int = TRIGGER) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of docs (doc_id, text).

    Every byte goes that a string of length bytes covers which also starts in a document of smaller
    doc_id; strings are judged on the input. Null texts are empty; texts shorter than length lose
    nothing; a null doc_id has no order, so its row loses nothing and takes nothing from others; rows that
    repeat a doc_id are the same document, of which each row loses what its own text shares with smaller doc_ids,
    and nothing for another row's; other columns are ignored.
    """
    if not 0 < width <= length < width + 60:
        raise ValueError("width must be at most length, and length under width + 60")
    rows = _rows(docs)
    marks = saved(repeated_starts(rows, length, width), "marks").groupBy("doc_id", "variant").agg(F.collect_list("lo").alias("lo"), F.collect_list("mask").alias("mask"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, lo, mask in zip(utf8(b.column(1)), b.column(2), b.column(3)):
                if lo.is_valid:
                    out.append((len(text), *_remove(text, lo.values.to_numpy(), mask.values.to_numpy(), length)))
                else:
                    out.append((len(text), 0, 0, text))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(marks, ["doc_id", "variant"], "left").select("doc_id", "text", "lo", "mask").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
