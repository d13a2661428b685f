"""Cutting lineage, and files, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and the master is local, as in tests."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(top := tempfile.mkdtemp(prefix="spark-"))
    return top


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """The rows of df written to the shared folder and read again: what several plans read is computed once."""
    path = path or new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of new_path() that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df dealt out by keys over as many partitions as shuffles have: rows that make much work of few bytes are not put together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def gathered(frames: Iterable[pd.DataFrame], most: int = 1 << 18) -> Iterator[pd.DataFrame]:
    """Small frames of a task put together to some of about `most` rows, as each costs its way to Spark."""
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= most:
            yield pd.concat(held)
            held, n = [], 0
    if held:
        yield pd.concat(held)
