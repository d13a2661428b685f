"""Operator 11: Merkle manifest of a dataset by nested-struct rollup.

Leaves are ranked in their tree, and a rank's base-8 digits are grouped away from the lowest up: each
grouping nests the children of a run as an array of structs under their digest. A block, 512 leaves, is
one row of three nested levels, shuffled once; blocks are leaves of the next pass, until each tree is one block.
Going down, a block gets the siblings above it by a union and a grouping, and transform and explode
unfold it to one row a leaf with the siblings of its whole path: no leaf takes part in a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from annealjobs.llm.shared import saved, table, unsigned_crc32

#: Nodes of a run, and levels that a block nests.
FANOUT, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(column: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 length, a colon, its text; a dash if it is null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """Lower-case hex SHA-256 of the fields, one after the other."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, node, item, ...) with rank, from 0 in each tree (string, may be null) by order; nulls first.

    Rows are range-partitioned by tree and order, so a tree may hold any share of them, and numbered where
    they then are; what a tree has in earlier partitions concerns the first tree of a partition alone, so
    that the offsets, broadcast, are no more than there are partitions.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    at = rows.columns.index("tree")

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(at).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            sizes = np.diff([*cuts.tolist(), len(codes)])
            place = np.arange(len(codes)) - np.repeat(cuts, sizes)
            first, end = (b.column(at)[i].as_py() for i in (0, -1))
            if n and first == last:
                place[: sizes[0]] += n
            last, n = end, int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64()), pa.array(np.full(len(place), part), pa.int32())], [*b.schema.names, "place", "part"])

    schema = StructType([*rows.schema.fields, StructField("place", LongType()), StructField("part", IntegerType())])
    numbered = saved(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, schema), "ranked")
    sizes = numbered.groupBy("part", "tree").agg(F.count("*").alias("n"))
    sizes = sizes.selectExpr("part AS p", "tree AS t", "SUM(n) OVER (PARTITION BY tree ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    heads = F.broadcast(sizes.where("before > 0"))  # one a partition at most
    out = numbered.join(heads, (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t")), "left")
    return out.withColumn("rank", F.col("place") + F.coalesce("before", F.lit(0))).drop("place", "part", "p", "t", "before")


def _rolled(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, rank, node, item) of blocks, from those of nodes: item nests what the block is made of.

    The one node of a tree is its own parent; any other run, of one node too, is hashed.
    """
    size = FANOUT**levels
    x = nodes.select("tree", F.expr(f"rank div {size}").alias("block"), (F.col("rank") % size).alias("at"), "node", "item").repartition("tree", "block")
    for _ in range(levels):
        kid = F.struct((F.col("at") % FANOUT).alias("at"), "node", "item")
        x = x.groupBy("tree", "block", F.expr(f"at div {FANOUT}").alias("up")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        alone = F.expr("size(kids) = 1 AND block = 0 AND up = 0")
        node = F.when(alone, F.col("kids.node")[0]).otherwise(F.sha2(F.array_join("kids.node", ""), 256))
        x = x.select("tree", "block", F.col("up").alias("at"), node.alias("node"), F.struct((~alone).alias("hashed"), "kids").alias("item"))
    return x.select("tree", F.col("block").alias("rank"), "node", "item")


def _passes(nodes: DataFrame, what: str) -> list[DataFrame]:
    """Tables of blocks, each over the one before, until every tree is one block; empty for no nodes."""
    out = []
    while True:
        blocks = saved(_rolled(nodes), what)
        most = blocks.agg(F.max("rank")).first()[0]
        if most is None:
            return []
        out.append(blocks)
        if most == 0:
            return out
        nodes = blocks.select("tree", "rank", "node", F.lit(None).cast("int").alias("item"))


def _unrolled(blocks: DataFrame, carry: list[str], levels: int = LEVELS) -> DataFrame:
    """(tree, rank, item, steps, carry) of what blocks (tree, rank, item, steps, carry) nest; steps from the bottom up."""
    x = blocks
    for _ in range(levels):
        x = x.select("tree", "rank", "steps", *carry, F.col("item.hashed").alias("hashed"), F.col("item.kids").alias("kids"), F.col("item.kids.node").alias("nodes"))
        side = lambda start, n: F.array_join(F.slice("nodes", start, n), "")
        step = lambda i: F.struct(side(F.lit(1), i).alias("before"), side(i + 2, F.lit(FANOUT)).alias("after"))
        kid = lambda k, i: F.struct((F.col("rank") * FANOUT + k["at"]).alias("rank"), k["item"].alias("item"), F.when(F.col("hashed"), F.concat(F.array(step(i)), "steps")).otherwise(F.col("steps")).alias("steps"))
        x = x.select("tree", *carry, F.explode(F.transform("kids", kid)).alias("k")).select("tree", "k.*", *carry)
    return x


def _handed(blocks: DataFrame, above: DataFrame, carry: list[str]) -> DataFrame:
    """blocks (tree, rank, item) with what stands above them (tree, rank, steps, carry)."""
    both = blocks.select("tree", "rank", "item").unionByName(above.select("tree", "rank", "steps", *carry), allowMissingColumns=True)
    return both.groupBy("tree", "rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("item", "steps", *carry)])


_STEPS = "array<struct<before:string,after:string>>"


def proofs(leaves: DataFrame, order: list[str]) -> DataFrame:
    """(tree, item, subroot, root, steps) for every row of leaves (tree string, node string, item, and order's columns).

    Leaves stand by order within their tree, where every 8 nodes that follow one another have a parent, until
    one is left, the tree's subroot; subroots by tree (null first, bytewise) likewise have the root. steps:
    what stands before and after the node in its run, at each level that hashes, from the leaf to the root.
    """
    nodes = ranked(leaves, order).select("tree", "rank", "node", "item")
    inner = _passes(nodes, "blocks")
    if not inner:
        return leaves.select("tree", "item", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(_STEPS).alias("steps"))
    tops = inner[-1].select(F.lit("").alias("tree"), "node", F.struct(F.col("tree").alias("name"), F.col("node").alias("subroot")).alias("item"), F.col("tree").alias("name"))
    outer = _passes(ranked(tops, ["name"]).select("tree", "rank", "node", "item"), "tops")
    x = _unrolled(outer[-1].select("tree", "rank", "item", F.array().cast(_STEPS).alias("steps"), F.col("node").alias("root")), ["root"])
    for blocks in reversed(outer[:-1]):
        x = _unrolled(_handed(blocks, x, ["root"]), ["root"])
    x = x.select(F.col("item.name").alias("tree"), F.lit(0).cast("long").alias("rank"), "steps", "root", F.col("item.subroot").alias("subroot"))
    for blocks in reversed(inner):
        x = _unrolled(_handed(blocks, x, ["root", "subroot"]), ["root", "subroot"])
    return x.select("tree", "item", "subroot", "root", "steps")


def folded(node: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(steps, node, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def manifest(docs: DataFrame, changed: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs, one tree a lang.

    changed: what a row's text has become (null: as it was); verified tells whether the row, as it is now,
    still folds to the root. Null fields count as such; a null lang is a tree, a null doc_id stands first; rows
    that repeat are leaves of their own, in the order of their digests; other columns are not read; an empty
    table gives an empty result.
    """
    own = [F.col(f"`{c}`") for c in fields]
    now = [changed if c == "text" else F.col(f"`{c}`") for c in fields]
    tampered = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf(*now))
    ids = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("tree"), leaf(*own).alias("node"), tampered.alias("tampered")]
    # a row's number parts equal rows, which may be many, and does not matter to the result
    rows = saved(docs.select(*ids, F.monotonically_increasing_id().alias("row")), "leaves")
    leaves = rows.select("tree", "node", F.struct("doc_id", "node", "tampered").alias("item"), "doc_id", "row")
    x = proofs(leaves, ["doc_id", "node", "row"])
    x = x.select("item.doc_id", F.col("item.node").alias("leaf"), "subroot", "root", F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), ""), 256).alias("proof_sha256"), folded(F.coalesce("item.tampered", "item.node"), F.col("steps")).alias("folded_root"))
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampering = F.when(unsigned_crc32(F.col("doc_id")) % 3 == 0, F.translate("text", _UPPER, _LOWER))
    return manifest(table(spark, sf_dir, "documents"), tampering)


def oracle(levels: int = 7, tops: int = 3) -> str:
    """DuckDB SQL for op11_merkle_manifest, unrolled for trees of up to 8 ** levels leaves and 8 ** tops languages."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf_sql = lambda text: "sha256(" + " || ".join(value(c) for c in FIELDS[:-1]) + f" || {value(text)})"
    # the checksum's register takes a byte, and then eight single steps
    bits = "list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(substr(s, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])))"
    crc = f"xor(list_reduce({bits}, lambda c, e: xor(xor(c, e) >> 1, 3988292384::BIGINT * (xor(c, e) & 1))), 4294967295::BIGINT)"
    ctes = [
        "d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)",
        f"n AS (SELECT doc_id, lang, {leaf_sql('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered FROM d)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM n)",
        "a0 AS (SELECT lang, r, leaf AS node FROM leaves)",
    ]

    def level(name: str, group: str, i: int) -> list[str]:
        run = f"PARTITION BY {group}, r // 8"
        side = lambda rows: f"coalesce(string_agg(node, '') OVER ({run} ORDER BY r ROWS BETWEEN {rows}), '')"
        return [
            f"{name}s{i} AS (SELECT {group}, r, NOT (r = 0 AND count(*) OVER ({run}) = 1) AS hashed, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a FROM {name}{i})",
            f"{name}{i + 1} AS (SELECT {group}, r // 8 AS r, CASE WHEN count(*) = 1 AND r // 8 = 0 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY r)) END AS node FROM {name}{i} GROUP BY {group}, r // 8)",
        ]

    for i in range(levels):
        ctes += level("a", "lang", i)
    ctes += [f"sub AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM a{levels})", "t0 AS (SELECT 0 AS g, r, subroot AS node FROM sub)"]
    for i in range(tops):
        ctes += level("t", "g", i)
    # a leaf's node on the way up, and the siblings' text
    ctes.append(f"w0 AS (SELECT l.*, coalesce(tampered, leaf) AS f, '' AS p, u.subroot, u.r AS u, (SELECT node FROM t{tops}) AS root FROM leaves l JOIN sub u ON l.lang IS NOT DISTINCT FROM u.lang)")
    steps = [(f"as{i}", f"s.lang IS NOT DISTINCT FROM w.lang AND s.r = w.r // {8**i}") for i in range(levels)] + [(f"ts{i}", f"s.r = w.u // {8**i}") for i in range(tops)]
    for k, (name, on) in enumerate(steps):
        ctes.append(f"w{k + 1} AS (SELECT w.* REPLACE (CASE WHEN hashed THEN sha256(b || f || a) ELSE f END AS f, p || CASE WHEN hashed THEN b || a ELSE '' END AS p) FROM w{k} w JOIN {name} s ON {on})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM w{len(steps)}"
