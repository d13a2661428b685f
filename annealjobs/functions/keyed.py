"""Uniform numbers from keys: results do not depend on partitioning, retries or the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """In [0, 1), from seed and integer or string keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed: int, *keys: str) -> str:
    """The same number in DuckDB."""
    return "(('0x' || substr(md5('" + str(seed) + "|' || " + " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "), 1, 8))::BIGINT / 4294967296.0)"
