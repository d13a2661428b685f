"""Operator 10: token counts through a digest cache.

Counts are stored by (content digest, tokenizer digest). Documents are joined with the store by digest;
only contents that it lacks are encoded, each once however many documents hold it, and appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annealjobs.llm.shared import saved, scratch, small_batches, table
from annealjobs.llm.tokens import tokenizer_path, words

LIMIT = 1024
#: A content is frequent with this share of the rows, and this many: at most 1,000 are, and their counts go to every task.
FREQUENT, LEAST_FREQUENT = 1 / 1000, 100
_CACHE = "digest binary, version string, n_tokens long"


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _read(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(_CACHE).parquet(cache)
    except Exception as e:  # a cache that was never written is empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _CACHE)


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text); the cache at `cache` grows.

    Content is normalised to its UTF-8 bytes, null as empty: anything further would change counts. A text of
    any length is counted whole. Rows that repeat, or have no doc_id, give a row each; other columns are
    ignored; an empty table appends nothing. Rows of a frequent content meet its count without a shuffle.
    """
    spark, path = docs.sparkSession, path or tokenizer_path("byte_bpe_50k.json")
    small_batches(spark)
    version = version_of(path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    rows = docs.select(text.alias("text"), digest)
    sized = saved(docs.select("doc_id", digest, F.octet_length(text).cast("long").alias("n_bytes")), "sized")
    known = _read(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # folded before they move: an anti-join would be moved below the fold
    misses = rows.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left").where("n_tokens IS NULL").select("digest", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = words(path).counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    misses.mapInArrow(run, _CACHE).write.mode("append").parquet(cache)
    known = _read(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    often = sized.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") >= max(LEAST_FREQUENT, sized.count() * FREQUENT))
    often = saved(often.join(known, "digest").select("digest", "n_tokens"), "frequent")
    rare = sized.join(F.broadcast(often.select("digest")), "digest", "left_anti").join(known, "digest")
    return rare.unionByName(sized.join(F.broadcast(often), "digest")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), scratch(spark, "token-counts"))
