"""Helpers that several operators of this subpackage use: tables, shared scratch space, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as every contract here defines them: runs of anything but the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash slots of doc_ids whose texts are read again: bounds what is broadcast to spare other texts the shuffle.
SLOTS = 1 << 20
#: Upper bound of the Arrow batches that go to a Python worker, so that long texts bound memory.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir set.

    A folder of this machine only where both are unset and the master is local.
    """
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        top = context.getCheckpointDir()
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """The rows of df written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = path or scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of scratch() that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def bounded_sample(rows: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """About n rows, chosen by a hash of the key columns alone; never more than 2 n. Nothing but those rows moves.

    Where keys repeat so that more pass, those of least hash stay: reruns choose the same.
    """
    share = min(1.0, n / max(1, rows.count()))
    draw = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < share).orderBy(draw, F.xxhash64(*rows.columns)).limit(2 * n)


def texts_of(docs: DataFrame, wanted: DataFrame, slots: int | None = None) -> DataFrame:
    """(doc_id, text) of the documents in the hash slots of wanted's doc_ids: a few too many, for an exact join.

    No more than `slots` numbers are broadcast, and other texts are spared the shuffle.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots or SLOTS)).alias("slot")
    return docs.select("doc_id", "text", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi").drop("slot")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes: a batch of 10,000 long texts would not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives b''."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def lowered_words(text: bytes) -> list[bytes]:
    """WORDs of a text with A-Z (only) lower-cased: bytes.lower and bytes.split know ASCII alone."""
    return text.lower().split()


def runs_of(kind: str, text: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The longest runs of bytes of a class, such as a-z, in their order: a list for each piece of a text, cut between runs."""
    inside, outside = re.compile(b"[" + kind.encode("latin-1") + b"]+"), re.compile(b"[^" + kind.encode("latin-1") + b"]")
    at = 0
    while at < len(text):
        cut = outside.search(text, min(len(text), at + piece))
        end = cut.start() if cut else len(text)
        yield inside.findall(text, at, end)
        at = end


def shingles(words: list[bytes], k: int) -> tuple[bytes, list[int], list[int]]:
    """Space-joined words, and where each k-word shingle starts and ends in them.

    Fewer than k words give the whole sequence as one shingle, no word gives none.
    """
    joined = b" ".join(words)
    if not words:
        return joined, [], []
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    if len(words) <= k:
        return joined, [0], [len(joined)]
    return joined, at[:-k].tolist(), (at[k:] - 1).tolist()


def majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """SimHash: a bit is 1 if it is set in over half (by weight) of the 64-bit hashes; none: zero."""
    total, count = 0, np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if weights is None:
            count += bits.sum(0, dtype=np.int64)
            total += len(bits)
        else:
            count += weights[i : i + (1 << 15)] @ bits
            total += int(weights[i : i + (1 << 15)].sum())
    return int(np.packbits(2 * count > total, bitorder="little").view(np.uint64)[0])


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of a key from batches sorted by it: as many groups at once as have come."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.names.index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(column, column[-1], "left"))
        if held:
            last = held[-1].column(held[-1].schema.names.index(key))[-1].as_py()
            if cut or column[-1] != last:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def pieces(batches: Iterable[pa.RecordBatch], key: str, most: int) -> Iterator[tuple[int, pa.Table]]:
    """(-1, whole groups of a key) from batches sorted by it, or (0, 1, ..., rows) of one group too large to hold.

    No more than about most rows and a batch are held at once.
    """
    held: list[pa.RecordBatch] = []
    last, given = None, 0  # the open group, and how many pieces of it have gone
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.names.index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(column, column[-1], "left"))
        if cut or column[-1] != last:  # the open group ends here
            more = int(np.searchsorted(column, last, "right")) if given else 0
            if given and (held or more):
                yield given, pa.Table.from_batches([*held, batch.slice(0, more)])
                held = []
            if held or cut > more:
                yield -1, pa.Table.from_batches([*held, batch.slice(more, cut - more)])
            held, last, given = [], column[-1], 0
        held.append(batch.slice(cut))
        if sum(b.num_rows for b in held) > most:
            yield given, pa.Table.from_batches(held)
            held, given = [], given + 1
    if held:
        yield given or -1, pa.Table.from_batches(held)


def unsigned_crc32(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))
