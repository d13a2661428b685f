"""From documents to token files: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir); run() writes what it returns as Parquet and reads it again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annealjobs.llm import decontaminate, mixing, quality, simhash, token_output
from annealjobs.llm.shared import saved, table

#: Near-duplicates: words of a shingle, and similarity.
SHINGLE, SIMILARITY = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules reject go; the list is learned from labels of the documents given.

    Every row is judged by its own text, whatever its doc_id: null and empty texts go, repeated rows are
    judged alike, other columns stay as they are, an empty table stays empty.
    """
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id stays of each group; a row goes by its own text.

    Null and empty texts are one group. Rows without a doc_id stay, as no order tells which is first;
    rows that repeat stay or go together, and rows of one doc_id with other texts are judged one by one;
    other columns play no part; an empty table stays empty.
    """
    groups = simhash.similar_documents(docs, SHINGLE, SIMILARITY)
    dropped = groups.where("doc_id != component_id").select("doc_id", "content").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), simhash.content(docs).alias("content"))
    return rows.join(dropped, ["doc_id", "content"], "left_anti").select("row.*")


def _row_key(docs: DataFrame) -> DataFrame:
    """docs as a struct `row`, with a key: the doc_id, or the text's digest where there is none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.sha2(text, 256))).alias("key"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their doc_id; rows without one are judged by their texts.

    Null and empty texts hold nothing and stay, as all do where the benchmark is empty; other columns play no part.
    """
    rows = _row_key(docs)
    held = decontaminate.contaminated(rows.select(F.col("key").alias("doc_id"), "row.text"), table(spark, sf_dir, "benchmark"))
    return rows.join(held.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, with its columns.

    Rows of one doc_id draw alike, rows without one by their texts; texts without a word have size 0 and may
    stay; a null source is a source; an empty table stays empty.
    """
    return mixing.mixed(docs, mixing.n_words(F.col("text")))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32 of every copy.

    Rows without a doc_id stand first; null texts are empty; other columns are not read; an empty table gives none.
    """
    return token_output.token_files(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix_sources),
    ("token output", token_files),
]

#: Learned rules, fingerprints and token ids are not SQL. tests/llm holds run(), and the operators that the
#: stages call one by one, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
