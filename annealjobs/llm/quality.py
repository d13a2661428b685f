"""Operator 8: quality rules: base statistics, and a decision list learned from labelled ones.

Sequential covering: a rule for rejecting grows condition by condition (feature, side, threshold) by
information gain on two thirds of the labelled rows, is pruned on the rest, and is kept while it is
precise there; the rows it covers leave, and the next rule is grown. The list becomes one ordered Spark
conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from annealjobs.llm.shared import bounded_sample, saved, small_batches, table, utf8

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
TRAIN_ROWS, MIN_PRECISION, MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 20_000, 0.9, 12, 4, 40
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_bytes"]
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)
#: Ratios that conditions test, as (numerator, denominator); a zero denominator counts as one.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "chars_per_word": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "n_bytes"),
    "digit_share": ("n_digits", "n_bytes"),
    "words": ("n_words", None),
}


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows that stand in the text twice or more, and the number of distinct words."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(ids) < 3:
        return 0, len(number)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:  # three numbers would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    inside = np.zeros(len(ids), bool)
    for i in range(3):
        inside[i : i + len(twice)] |= twice
    return int(inside.sum()), len(number)


def text_stats(text: bytes) -> tuple[int, ...]:
    """_COUNTS of one text, given as UTF-8."""
    words = text.split()
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            duplicates += line in seen
            seen.add(line)
    repeats, distinct = repeated_words(words)
    a = np.frombuffer(text, np.uint8)
    continuation = int(((a & 0xC0) == 0x80).sum())
    inner = len(a) - continuation - sum(text.count(bytes([c])) for c in SPACES)
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    upper, digits = int(((a >= 65) & (a <= 90)).sum()), int(((a >= 48) & (a <= 57)).sum())
    return len(words), inner, symbols, duplicates, repeats, lines, distinct, upper, digits, len(a)


@F.arrow_udf(StructType([StructField(c, LongType()) for c in _COUNTS]))
def _stats_of(text: pa.Array) -> pa.Array:
    rows = np.array([text_stats(t) for t in utf8(text)], np.int64).reshape(-1, len(_COUNTS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(_COUNTS))], _COUNTS)


_stats_of = _stats_of.asNondeterministic()  # evaluated once, before anything that reads it


def stats(docs: DataFrame) -> DataFrame:
    """STATS of every row of docs (doc_id, text); a null text has no word."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _stats_of(F.col("text").cast("string")).alias("s"))
    return rows.select("doc_id", "s.*")


def base_failed(within: str = "") -> Column:
    """The base rules on columns of STATS, or on fields of the struct column `within`."""
    words, repeats = (F.col(f"{within}.{c}" if within else c) for c in ("n_words", "n_repeat_words"))
    return (words < 50) | (100 * repeats > 50 * words)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, within: str = "") -> Column:
        top, bottom = (c and (f"{within}.{c}" if within else c) for c in FEATURES[self.feature])
        value = F.col(top).cast("double")
        if bottom:
            value = value / F.greatest(F.col(bottom), F.lit(1)).cast("double")
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """At most so many conditions, added by FOIL's gain until no good row is covered."""
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while len(rule) < most and (live & ~bad).any():
        p0, n0 = int((live & bad).sum()), int((live & ~bad).sum())
        best, choice = 0.0, None
        for name, values in x.items():
            v, b = values[live], bad[live]
            edges = np.unique(np.concatenate([np.quantile(v[b], np.linspace(0, 1, THRESHOLDS)), np.quantile(v[~b], np.linspace(0, 1, THRESHOLDS))]))
            edges = (edges[1:] + edges[:-1]) / 2  # between what was seen: nearest to neither kind
            if not len(edges):
                continue
            order = np.sort(v[b]), np.sort(v[~b])
            for above in (True, False):
                at = [np.searchsorted(o, edges, "right") for o in order]
                p, n = (len(o) - i if above else i for o, i in zip(order, at))
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), -1.0)
                i = int(np.argmax(gain))
                if gain[i] > best + 1e-9:
                    best, choice = float(gain[i]), Condition(name, above, float(edges[i]))
        if choice is None:
            break
        rule.append(choice)
        live &= choice.holds(x)
    return tuple(rule)


def learn(rows: np.ndarray, bad: np.ndarray, prune: np.ndarray, min_precision: float = MIN_PRECISION, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> list[Rule]:
    """Rules for the bad among rows (columns as _COUNTS); prune marks the rows that rules are pruned on.

    max_rules and max_conditions bound the list so that people can read it.
    """
    column = {c: rows[:, i].astype(float) for i, c in enumerate(_COUNTS)}
    x = {f: column[a] / np.maximum(column[b], 1) if b else column[a] for f, (a, b) in FEATURES.items()}
    out: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(out) < max_rules:
        grow, check = left & ~prune, left & prune
        if not (grow & bad).any() or not (grow & ~bad).any() or not check.any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_conditions)
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            c = _covered(rule[:k], x, len(bad)) & check
            p, n = int((c & bad).sum()), int((c & ~bad).sum())
            worth.append(((p - n) / (p + n) if p + n else -1.0, p, -k))
        value, hits, size = max(worth)
        if hits == 0 or (value + 1) / 2 < min_precision:
            break
        out.append(rule[:-size])
        left &= ~_covered(rule[:-size], x, len(bad))
    return out


def labelled(labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 3) -> DataFrame:
    """(doc_id, quality): about train_rows labelled documents, chosen by hash, at most twice as many."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return bounded_sample(known, ["doc_id"], train_rows, seed)


def fit(rows: DataFrame, seed: int = 3) -> list[Rule]:
    """The decision list from STATS of labelled documents with their quality, a bounded number of them.

    Rows that the base rules reject are left out, of several rows of one doc_id the smallest speaks;
    without labels of both kinds there are no rules.
    """
    one = F.min(F.struct(*_COUNTS)).alias("s")
    found = rows.where(~base_failed()).groupBy("doc_id").agg(one, F.min("quality").alias("quality")).select(F.xxhash64(F.lit(seed + 1), "doc_id").alias("h"), "quality", "s.*").collect()
    found.sort(key=lambda r: (r.h, r.n_bytes))
    if not found:
        return []
    bad = np.array([r.quality == 0 for r in found])
    return learn(np.array([[r[c] for c in _COUNTS] for r in found], float), bad, np.array([r.h % 3 == 0 for r in found]))


def rejects(rules: list[Rule], within: str = "") -> Column:
    """The ordered conditional expression: the first rule that holds rejects."""
    out = None
    for rule in rules:
        all_of = rule[0].column(within)
        for c in rule[1:]:
            all_of = all_of & c.column(within)
        out = F.when(all_of, True) if out is None else out.when(all_of, True)
    return F.lit(False) if out is None else out.otherwise(False)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """STATS, base_failed and kept for every row of docs (doc_id, text), learning from labels (doc_id, quality).

    Null and empty texts have no word and fail the base rules; a text of any length is read whole; rows
    that repeat are judged alike, and each by its own text where they share a doc_id; other columns are
    ignored; an empty table gives an empty result. Labels that are null, or of no document, count for nothing.
    """
    found = saved(stats(docs), "stats")
    rules = fit(found.join(F.broadcast(labelled(labels)), "doc_id"))  # bounded by the sample
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejects(rules))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge keeps, whole and where they are: nothing but the labelled sample moves.

    Cases as in judge; as every row is judged by its own text, a null doc_id makes no difference.
    """
    small_batches(docs.sparkSession)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labelled(labels)), "doc_id")
    known = saved(sample.select("doc_id", "quality", _stats_of(F.col("text").cast("string")).alias("s")).select("doc_id", "quality", "s.*"), "labelled")
    rules = fit(known)
    rows = docs.select(F.struct("*").alias("row"), _stats_of(F.col("text").cast("string")).alias("s"))
    return rows.where(~base_failed("s") & ~rejects(rules, "s")).select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
