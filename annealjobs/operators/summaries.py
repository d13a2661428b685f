"""Weighted summaries of particle tables."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annealjobs.functions.selection import select


def weighted_counts(df: DataFrame, keys: list[str], projection: Column, w: str = "w") -> DataFrame:
    return df.groupBy(*keys, projection.alias("item")).agg(F.sum(w).alias("weight"))


def map_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The item of largest weight; ties go to the smallest item."""
    return counts.groupBy(*keys).agg(F.min_by("item", F.struct(-F.col("weight"), F.col("item"))).alias("item"), F.max("weight").alias("weight"))


def map_particle(df: DataFrame, key: str, w: str = "w", id_col: str = "particle_id") -> DataFrame:
    """The particle of largest weight; the first of several."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(-F.col(w), F.col(id_col))).alias("x")).select(key, "x.*")


def centroid(counts: DataFrame, keys: list[str], loss: Callable[[Column, Column], Column], metric: bool = False, digits: int | None = None) -> DataFrame:
    """(keys, item, loss): the observed item of least expected loss; ties go to the smallest. Pairs are of unique items of a group only.

    digits: losses are rounded to so many decimals, as those of weights that are themselves rounded tie only up to that.
    metric: the loss is symmetric and keeps the triangle inequality. Then a group's heaviest item p, of expected
    loss E, bounds all others: item x loses at least W loss(x, p) - E, with W the group's weight, so that
    only items with W loss(x, p) <= 2 E are paired with the rest. Keys are not null.
    """
    mine = counts.select(*keys, "item")
    if metric:
        pivot = map_of_counts(counts, keys).select(*keys, F.col("item").alias("_p"))
        near = counts.join(pivot, keys).withColumn("_d", loss(F.col("item"), F.col("_p")))
        bound = near.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("_d")).alias("_e"), F.sum("weight").alias("_w"))
        slack = F.col("_e") * 2 * F.lit(1 + 1e-9).cast(dict(counts.dtypes)["weight"])  # sums of doubles in no fixed order
        mine = near.join(bound, keys).where(F.col("_w") * F.col("_d") <= slack).select(*keys, "item")
    others = counts.select(*keys, F.col("item").alias("_y"), F.col("weight").alias("_wy"))
    cost = F.sum(F.col("_wy") * loss(F.col("item"), F.col("_y")))
    costs = mine.join(others, keys).groupBy(*keys, "item").agg((cost if digits is None else F.round(cost, digits)).alias("loss"))
    return costs.groupBy(*keys).agg(F.min_by("item", F.struct("loss", "item")).alias("item"), F.min("loss").alias("loss"))


def centroid_on_line(counts: DataFrame, keys: list[str], position: Column, slack: float = 0.0) -> DataFrame:
    """(keys, item, loss): the observed item of least expected distance of positions, numbers; ties go to the smallest item.

    slack: the share of a group's weight by which rounded weights may miss its half and still tie.

    The weighted medians have it: positions up to which, and from which, at least half of the weight stands.
    They are selected by histograms, so that no group is ordered in one task and no items are paired.
    """
    rows = counts.withColumn("_at", position.cast("double")).where("weight > 0")
    half = rows.groupBy(*keys).agg((F.sum("weight") / 2 if not slack else F.sum("weight") / 2 * F.lit(Decimal(repr(1 - 2 * slack)) if "decimal" in dict(rows.dtypes)["weight"] else 1 - 2 * slack)).alias("target"))
    low = select(rows, keys, "_at", "weight", half).withColumnRenamed("selected", "_low")
    high = select(rows.withColumn("_at", -F.col("_at")), keys, "_at", "weight", half).select(*keys, (-F.col("selected")).alias("_high"))
    both = rows.join(low, keys).join(high, keys)
    at = lambda c: F.sum(F.col("weight") * F.abs(F.col("_at") - F.col(c)).cast(dict(counts.dtypes)["weight"]))
    # every position between the two medians loses the same; at most two positions are observed there
    best = both.where((F.col("_at") >= F.least("_low", "_high")) & (F.col("_at") <= F.greatest("_low", "_high"))).groupBy(*keys).agg(F.min("item").alias("item"))
    return best.join(both.groupBy(*keys).agg(at("_low").alias("loss")), keys)


def store(df: DataFrame, keys: list[str], **summaries: Column) -> DataFrame:
    """Several summaries of the same groups in one pass."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in summaries.items()])


def fork(df: DataFrame, groupings: dict[str, list[str]], **summaries: Column) -> DataFrame:
    """(grouping, all keys of any grouping, summaries): the summaries of several groupings from one scan.

    Rows are expanded once, with a number for the grouping, and all groupings are one aggregation, combined
    before it moves; a key that a grouping does not have is null.
    """
    keys = list(dict.fromkeys(k for g in groupings.values() for k in g))
    bits = {name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in g) for name, g in groupings.items()}
    if len(set(bits.values())) < len(bits):
        raise ValueError("two groupings have the same keys")
    out = df.groupingSets([[F.col(k) for k in g] for g in groupings.values()], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_g"), *[c.alias(n) for n, c in summaries.items()])
    name = F.coalesce(*[F.when(F.col("_g") == b, F.lit(n)) for n, b in bits.items()])
    return out.select(name.alias("grouping"), *keys, *summaries)


def weights_list(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Weights of a counter joined by commas, in the order of items."""
    return counts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "weight"))), lambda x: x["weight"].cast("string")), ",").alias("weights"))


def population_fingerprint(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, fingerprint, n): order-free hash of a population's rows, by the text of the columns; equal for equal runs.

    A multiset's hash: two 64-bit hashes of a row, each summed modulo 2^64, so that copies count.
    """
    text = F.concat(*[F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns])
    h = F.md5(text.cast("binary"))
    part = lambda at: F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(20,0)")
    total = lambda at: (F.sum(part(at)) % F.lit(Decimal(1 << 64))).cast("decimal(20,0)").cast("string")
    return df.groupBy(key).agg(F.concat_ws("-", total(1), total(17)).alias("fingerprint"), F.count("*").alias("n"))
