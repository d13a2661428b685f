"""The rows before and after a row of a long group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a group that one task orders.
CHUNK = 1 << 16


def with_neighbours(rows: DataFrame, key: str, order: str, value: str, before: str = "_before", after: str = "_after", chunk: int = CHUNK) -> DataFrame:
    """rows with the value of the rows before and after by an integer order within each key; null at the ends, and for null values.

    Chunks of positions are ordered apart, and a chunk's first and last row come to the chunks beside it by a
    join on the chunk, so that a key may hold any share of the rows. Orders need not be gapless; they are
    unique within a key, and keys are not null.
    """
    cut = rows.withColumn("_c", F.floor(F.col(order) / chunk))
    kept = F.struct(F.col(value).alias("v"))
    ends = cut.groupBy(key, "_c").agg(F.min_by(kept, order).alias("_first"), F.max_by(kept, order).alias("_last"))
    beside = Window.partitionBy(key).orderBy("_c")  # a row a chunk
    halo = ends.select(key, "_c", F.lag("_last").over(beside).alias("_last"), F.lead("_first").over(beside).alias("_first"))
    within = Window.partitionBy(key, "_c").orderBy(order)
    out = cut.join(halo, [key, "_c"]).withColumn(before, F.coalesce(F.lag(kept).over(within), "_last")["v"]).withColumn(after, F.coalesce(F.lead(kept).over(within), "_first")["v"])
    return out.select(*rows.columns, before, after)
