"""Connected components over an edge table, by alternating large and small stars.

Every round is two pre-aggregated minima and two equi-joins; a star whose centre is hot is split by
AQE's skew join, and no neighbourhood is gathered in one task. Each round is cut by a written table,
and the tables before it are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annealjobs.llm.shared import forget, saved, scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (u, v: long, no nulls) reaches.

    Nodes without an edge to another node, and components' smallest nodes themselves, may be absent;
    an empty edge table gives an empty result. Loops, repeated and reversed edges do no harm.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame, what: str) -> tuple[DataFrame, str]:
        path = scratch(spark, what)
        return saved(df, what, path), path

    now, held = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, between = kept(large.distinct(), "large")
        forget(spark, held)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, held = kept(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        forget(spark, between)
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
