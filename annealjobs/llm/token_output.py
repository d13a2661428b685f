"""Operator 4: token ids as binary files, each document compressed by itself under a shared dictionary.

File format, held in Parquet so that any store Spark writes will do: `dictionary` has one row (hash,
bytes) with a zstandard dictionary trained on serialized id arrays; `shards` has rows (shard, block,
dictionary hash, doc_ids, n_tokens, offsets, starts, payload). payload is the frames of the block's
documents, one after the other; offsets is the index: document i is payload[offsets[i]:offsets[i+1]],
a zstandard frame of little-endian unsigned 32-bit ids. Shards are ranges of doc_id, blocks within a
shard are in order; starts count from the shard's first token, and shard totals give the rest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annealjobs.llm.shared import bounded_sample, scratch, small_batches, table
from annealjobs.llm.tokens import tokenizer_path, words

END_ID, LEVEL = 2, 3
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1500, 4000, 64 << 10
#: Bytes of text in a shard: at most so many where there is more of it than shuffle partitions would hold, and not less than the second number.
SHARD_BYTES, LEAST_SHARD_BYTES = 128 << 20, 4 << 20
#: A block ends at this many bytes of payload or documents; a larger document is a block alone.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 4096
_SHARD = "shard int, block int, dict_hash string, doc_ids array<long>, n_tokens array<long>, offsets array<long>, starts array<long>, payload binary"


def train_dictionary(docs: DataFrame, path: str, size: int = DICTIONARY_BYTES, sample: int = SAMPLE_DOCS) -> bytes:
    """Dictionary bytes from a bounded sample of documents, chosen by hash: SAMPLE_CHARS of each, at a place chosen by hash.

    Too little text to train on gives the sample itself as a raw dictionary; no text gives none (b'').
    The sample shapes only the compression; every document is encoded whole.
    """
    some = bounded_sample(docs.where("text IS NOT NULL"), ["doc_id"], sample, 5)
    place = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    rows = some.select(F.col("text").substr(place, F.lit(SAMPLE_CHARS)).alias("t")).collect()
    arrays = [x for x in words(path).ids(sorted(r.t for r in rows)) if x]
    if not arrays:
        return b""
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int | None = END_ID, level: int = LEVEL) -> None:
    """Write the ids of every row of docs (doc_id, text) under out, in ascending doc_id order.

    Null texts are empty, texts of any length are one frame, null doc_ids stand first, rows that repeat a
    doc_id stand together in the order of their texts' hashes, other columns are ignored, and an empty table
    gives no shard.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = train_dictionary(rows, path)
    digest = hashlib.sha256(raw).hexdigest()
    spark.range(1).select(F.lit(digest).alias("dict_hash"), F.lit(raw).alias("bytes")).write.parquet(f"{out}/dictionary")
    shared = _dictionary(raw)
    raw_bytes = shared.as_bytes() if shared else b""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw_bytes), write_content_size=True)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, starts, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            offsets = [0, *np.cumsum([len(f) for f in frames]).tolist()]
            values = [[shard], [block], [digest], [ids], [counts], [offsets], [starts], [b"".join(frames)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.list_(pa.int64())] * 4, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["shard", "block", "dict_hash", "doc_ids", "n_tokens", "offsets", "starts", "payload"])

        for b in batches:
            whole, at = words(path).encoded(b.column(1))
            whole, at = memoryview(whole.astype("<u4", copy=False)).cast("B"), (4 * at).tolist()
            for doc_id, i, j in zip(b.column(0).to_pylist(), at, at[1:]):
                tokens = bytes(whole[i:j]) + end
                frame = packer.compress(tokens)
                if frames and (held + len(frame) > BLOCK_BYTES or len(frames) >= BLOCK_DOCS):
                    yield flush()
                    block, ids, counts, frames, starts, held = block + 1, [], [], [], [], 0
                ids.append(doc_id)
                counts.append(len(tokens) // 4)
                starts.append(start)
                frames.append(frame)
                start, held = start + len(tokens) // 4, held + len(frame)
        if frames:
            yield flush()

    # rows that share a doc_id, were they many, part by their texts
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // SHARD_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_SHARD_BYTES)))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, _SHARD).write.option("compression", "none").parquet(f"{out}/shards")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, decompressed through the index.

    start is the number of ids of all documents before it. A dictionary that is not the one the shards
    name, or a frame that does not hold the ids its index says, is an error.
    """
    small_batches(spark)
    found = spark.read.parquet(f"{out}/dictionary").first()
    raw, digest = bytes(found.bytes), found.dict_hash
    shards = spark.read.schema(_SHARD).parquet(f"{out}/shards")
    totals = shards.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    base = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for b in batches:
            for r in b.to_pylist():
                if r["dict_hash"] != digest or hashlib.sha256(raw).hexdigest() != digest:
                    raise ValueError(f"shard {r['shard']} needs dictionary {r['dict_hash']}")
                payload, crcs = memoryview(r["payload"]), []
                for i, n in enumerate(r["n_tokens"]):
                    ids = unpacker.decompress(payload[r["offsets"][i] : r["offsets"][i + 1]])
                    if len(ids) != 4 * n:
                        raise ValueError(f"document {r['doc_ids'][i]}: {len(ids)} bytes for {n} ids")
                    crcs.append(zlib.crc32(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * len(crcs), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["starts"], pa.int64()), pa.array(r["n_tokens"], pa.int64()), pa.array(crcs, pa.int64())],
                    ["shard", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    rows = shards.mapInArrow(run, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Write the token files of docs to the shared folder and read them back."""
    out = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path or tokenizer_path("word_bpe_49k.json"), out, end_id)
    return read_tokens(docs.sparkSession, out)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
