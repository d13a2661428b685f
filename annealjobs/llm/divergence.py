"""Operator 12: source divergence audit by Gustavson row accumulation.

Terms are counted by language and source, and what a language keeps becomes a term-major index: one row a
term with its postings (source, count). Hash blocks of a language's terms are independent, as divergences
are sums over terms. In a block each source, a row of the sparse matrix, takes its terms through the index
and scatters what postings add into one dense accumulator over its peers; no pair of postings is a row.
Terms that a source lacks have the probability of count zero, so accumulators start from all terms as if
lacking on both sides, and are corrected for terms that one side has (by distinct probabilities) or both
have (by the scatter). Integers throughout: sums do not depend on order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from annealjobs.llm.shared import runs_of, saved, small_batches, table, utf8

#: A term's bytes once A-Z are lower-cased: letters, and whatever is not ASCII.
TERM = "a-z\x80-\xff"
LEAST_DOCUMENTS, SCALE, RANKS = 3, 10**9, 200
#: Counts of terms by source that a task holds before it hands them on; postings of a block; rows of accumulators that a task holds.
HELD, BLOCK, TILE = 1 << 20, 1 << 18, 1024
#: Rows of a table that may be broadcast: languages, or groups.
FEW = 100_000


def counted(docs: DataFrame) -> DataFrame:
    """(lang, term, sources, n, documents): postings of docs (lang, source, text), some rows a term; the null term has every group, with 0.

    A task adds up what it reads, term by term, so that a row that moves is a term with all of its sources.
    """
    small_batches(docs.sparkSession)

    def rows(lang: str, documents: Counter, by_source: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        names, terms = list(by_source), list(documents)
        number = dict(zip(terms, range(len(terms))))
        term = np.concatenate([np.fromiter(map(number.__getitem__, c), np.int64, len(c)) for c in by_source.values()])
        n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in by_source.values()])
        order = np.argsort(term, kind="stable")
        source = np.repeat(np.arange(len(names)), [len(c) for c in by_source.values()])[order]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))]).astype(np.int32)
        columns = [
            pa.array([lang]).take(pa.array(np.zeros(len(terms) + 1, np.int64))),
            pa.array([*terms, None], pa.binary()).cast(pa.string()),
            pa.ListArray.from_arrays(pa.array([*offsets.tolist(), offsets[-1] + len(names)], pa.int32()), pa.array(names).take(pa.array(np.concatenate([source, np.arange(len(names))])))),
            pa.ListArray.from_arrays(pa.array([*offsets.tolist(), offsets[-1] + len(names)], pa.int32()), pa.array(np.concatenate([n[order], np.zeros(len(names), np.int64)]))),
            pa.array([*documents.values(), 0], pa.int64()),
        ]
        whole = pa.RecordBatch.from_arrays(columns, ["lang", "term", "sources", "n", "documents"])
        yield from (whole.slice(at, 20_000) for at in range(0, len(whole), 20_000))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Counter, dict[str, Counter]]] = {}
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                documents, by_source = held.setdefault(lang, (Counter(), {}))
                n, own = by_source.setdefault(source, Counter()), set()
                for some in runs_of(TERM, text.lower()):
                    n.update(some)
                    own.update(some)
                documents.update(own)
            if sum(len(n) for _, by_source in held.values() for n in by_source.values()) > HELD:
                for lang, counts in held.items():
                    yield from rows(lang, *counts)
                held.clear()
        for lang, counts in held.items():
            yield from rows(lang, *counts)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, term string, sources array<string>, n array<long>, documents long")


def term_major(partial: DataFrame) -> DataFrame:
    """(lang, term, postings, n, documents) of counted: rows of a term meet once, and are added up and gathered where they are."""
    each = partial.repartition("lang", "term").select("lang", "term", "documents", F.posexplode(F.arrays_zip("sources", "n")).alias("at", "c"))
    # a row's documents count with its first posting alone
    cells = each.groupBy("lang", "term", "c.sources").agg(F.sum("c.n").alias("n"), F.sum(F.when(F.col("at") == 0, F.col("documents")).otherwise(0)).alias("documents"))
    return cells.groupBy("lang", "term").agg(F.collect_list(F.struct(F.col("sources").alias("source"), "n")).alias("postings"), F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _some(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def scaled(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), exact, for n + 1 of at most total: long division in base 1,000."""
    rest, out = n + 1, np.zeros(len(n), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def accumulated(offsets: np.ndarray, peer: np.ndarray, n: np.ndarray, total: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum over a block's terms of f of each of rows' groups against every group.

    The postings of term i are peer[offsets[i]:offsets[i + 1]], with counts n; total: each group's denominator.
    """
    terms, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((len(rows), len(total)), np.int64)
    if not terms:
        return out
    p, zero = scaled(n, total[peer]), scaled(np.zeros(len(total), np.int64), total)
    order = np.lexsort((p, peer))  # row-major: a group's postings, and in them equal probabilities
    by_peer, by_p = peer[order], p[order]
    fresh = np.flatnonzero(np.concatenate([[True], (by_peer[1:] != by_peer[:-1]) | (by_p[1:] != by_p[:-1])]))
    times = np.diff([*fresh.tolist(), len(order)])
    of, distinct = by_peer[fresh], by_p[fresh]
    term = np.repeat(np.arange(terms), size)
    starts, firsts = np.searchsorted(by_peer, np.arange(len(total) + 1)), np.searchsorted(of, np.arange(len(total) + 1))
    for i, g in enumerate(rows.tolist()):
        acc = out[i]
        none = _f(zero[g], zero)
        acc += terms * none
        for k in range(firsts[g], firsts[g + 1]):  # terms that g has, as if no peer had them
            acc += times[k] * (_f(distinct[k], zero) - none)
        np.add.at(acc, of, times * (_f(zero[g], distinct) - none[of]))  # terms that peers have, as if g had none
        mine = order[starts[g] : starts[g + 1]]
        own = size[term[mine]]  # g's terms through the index: all postings of each
        at = np.repeat(offsets[:-1][term[mine]] - np.cumsum(own) + own, own) + np.arange(own.sum())
        h, ph, pg = peer[at], p[at], np.repeat(p[mine], own)
        np.add.at(acc, h, _f(pg, ph) - _f(pg, zero[h]) - _f(zero[g], ph) + none[h])
    return out


def _divergences(index: DataFrame, groups: DataFrame, stats: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each group and every other source of its language."""
    of = _some(stats.select("lang", "blocks", "tiles"))
    tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    left = index.join(of, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), tile, F.col("postings.source").alias("source"), F.col("postings.n").alias("n"))
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    right = groups.select("lang", "source", "total", "blocks", tile).select("lang", "source", "total", "tile", block)

    def run(terms: pa.Table, peers: pa.Table) -> pa.Table:
        names = pc.sort_indices(peers, [("source", "ascending")])
        peers = peers.take(names)
        source, total = peers.column("source").combine_chunks(), peers.column("total").to_numpy()
        tile = peers.column("tile")[0].as_py()
        rows = np.arange(tile * TILE, min(len(total), (tile + 1) * TILE))
        lists, n = terms.column("source").combine_chunks(), terms.column("n").combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        peer = pc.index_in(lists.flatten(), source).to_numpy(zero_copy_only=False).astype(np.int64)
        acc = accumulated(offsets, peer, n.flatten().to_numpy(zero_copy_only=False).astype(np.int64), total, rows)
        g, h = (x.ravel() for x in np.indices(acc.shape))
        other = rows[g] != h
        lang = peers.column("lang").combine_chunks().take(pa.array(np.zeros(int(other.sum()), np.int64)))
        return pa.Table.from_arrays([lang, source.take(pa.array(rows[g[other]])), source.take(pa.array(h[other])), pa.array(acc.ravel()[other])], ["lang", "source", "item", "value"])

    keys = ["lang", "block", "tile"]
    parts = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(n: Column, total: Column) -> Column:
    """scaled() of columns."""
    return F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE), total) + 1


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of docs (text, lang, source).

    part pair: the group against each other source of its language; part term: the terms that it has more of
    than its language, ranked, the first `ranks`. A language keeps terms of least_documents rows or more.
    Null text, lang and source are ''; rows that repeat count again; ties go to the smallest item, bytewise; a
    group alone in its language has no pair, and one without a kept term has value 0 for all; other columns are
    not read; an empty table gives an empty result. A term's postings, no more than a language has sources, are a row.
    """
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    kept_terms = (F.col("documents") >= least_documents) & F.col("term").isNotNull()
    both = saved(term_major(counted(docs.select(text))).where(kept_terms | F.col("term").isNull()), "index")
    index = both.where(kept_terms).drop("documents")
    kept = index.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("words"), F.sum(F.size("postings")).alias("size"))
    known = both.where("term IS NULL").select("lang", F.explode("postings.source").alias("source"))
    stats = known.groupBy("lang").agg(F.count("*").alias("sources")).join(kept, "lang", "left").select(
        "lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("words", F.lit(0)).alias("words"), F.ceil(F.greatest(F.lit(1), F.coalesce("size", F.lit(0)) / block)).cast("int").alias("blocks"), F.ceil(F.col("sources") / tile).cast("int").alias("tiles")
    )
    stats = saved(stats, "languages")
    own = index.select("lang", F.explode("postings").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("words"))
    groups = known.join(own, ["lang", "source"], "left").join(stats.withColumnRenamed("words", "all"), "lang")
    groups = saved(groups.select("lang", "source", (F.coalesce("words", F.lit(0)) + F.col("terms")).alias("total"), (F.col("all") + F.col("terms")).alias("all"), "blocks", "tiles"), "groups")
    pairs = _divergences(index, groups, stats).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    cell = index.select("lang", F.col("term").alias("item"), F.col("n").alias("everywhere"), F.explode("postings").alias("c")).select("lang", "item", "everywhere", "c.source", "c.n")
    cell = cell.join(_some(groups.select("lang", "source", "total", "all")), ["lang", "source"])
    cell = cell.select("lang", "source", "item", _share(F.col("n"), F.col("total")).alias("p"), _share(F.col("everywhere"), F.col("all")).alias("q")).where("p > q")
    own_rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    terms = cell.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    # the rank is limited where rows are, before they move
    return pairs.select("*", own_rank).unionByName(terms.select("*", own_rank).where(F.col("rank") <= ranks))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS id FROM documents),
  w AS (SELECT lang, source, id, unnest({_TERMS}) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
  c AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL),
  grid AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
  p AS (SELECT *, 1 + ({SCALE}::HUGEINT * (c + 1)) // (sum(c) OVER g + count(*) OVER g) AS p FROM grid WINDOW g AS (PARTITION BY lang, source)),
  q AS (SELECT *, 1 + ({SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER g + count(*) OVER g) AS q FROM kept WINDOW g AS (PARTITION BY lang)),
  s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  g AS (SELECT DISTINCT lang, source FROM d),
  x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= {RANKS}"""
