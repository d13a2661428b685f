"""Operator 2: URL filters: rules first, then trust and distrust propagated over the host graph.

DataFrame and SQL functions only. Hosts that allow rules fit seed a personalised PageRank along host
edges; hosts that block rules fit seed the same walk along the reversed edges (who points at a blocked
host is distrusted). A url that no rule fits takes its host's verdict: block where distrust exceeds trust.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annealjobs.llm.shared import saved, table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
#: Rounds that the oracle's SQL unrolls; the query goes on until the scores stand.
ROUNDS = 8
#: Largest share of its score by which a host's may still change over STEP rounds.
TOLERANCE, STEP = 1e-6, 4
#: Scores sum to 1 over all hosts, so they are compared by their ratio: sums of doubles in no fixed order differ by far less.
SLACK = 1e-9
#: Host names in markup: what an absolute link, or a mention such as a footer's, points at.
HOSTNAME = r"(?i)[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,24}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no '://'."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    # [\s\S] and no anchor at the end: a host or path may hold line breaks.
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (ties: the first by text), or null.

    A rule is host + path; it fits its host and all subdomains where the path starts with the rule's.
    The list is a literal of the job, so it is a chain of conditions rather than a join.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): each crawled host's edges to other crawled hosts, weighted by pages that name them."""
    named = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(HOSTNAME), F.lit(0)), lambda h: F.translate(h, _UPPER, _LOWER))))
    raw = pages.where("host != '' AND html IS NOT NULL").select(F.col("host").alias("src"), named.alias("dst")).where("src != dst")
    raw = raw.groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.where("host != ''").select(F.col("host").alias("dst")).distinct()
    edges = raw.join(hosts, "dst", "left_semi")
    return edges.select("src", "dst", "n")


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float, damping: float, what: str) -> DataFrame:
    """(host, score): personalised PageRank of seeds (host, seed) along edges (src, dst, n); the seeds sum to 1.

    The walk goes on until no host's score changes by over the tolerance's share of it, nor any host is newly reached.
    """
    total = edges.groupBy("src").agg(F.sum("n").alias("all"))
    step = saved(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), f"{what}-edges")
    restart = seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))
    before = seeds.select("host", F.col("seed").alias("score"))
    while True:
        score = before
        for _ in range(STEP):
            moved = score.join(step, score["host"] == step["src"]).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("score") * F.col("share")) * damping).alias("score"))
            score = moved.unionByName(restart).groupBy("host").agg(F.sum("score").alias("score"))
        score = saved(score, f"{what}-scores")
        both = score.join(before.select("host", F.col("score").alias("old")), "host", "left")
        if both.where(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))) > F.col("score") * tolerance).isEmpty():
            return score
        before = score


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, tolerance: float = TOLERANCE, damping: float = DAMPING, margin: float = 0.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of pages (page_id, url, html).

    Null urls and urls without '://' have empty host and path and, as they fit no rule and no host, are
    allowed; null html gives no edges; repeated pages each get a row and count as repeated evidence.
    Hosts that no seed reaches have no distrust and are allowed. Empty tables give empty results.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    ruled = urls.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r"))
    counts = saved(ruled.where("host != ''").groupBy("host").agg(F.count_if(F.col("r.verdict") == "allow").alias("allowed"), F.count_if(F.col("r.verdict") == "block").alias("blocked")), "hosts")
    sums = counts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    edges = saved(host_edges(urls), "host-edges")
    seeds = {k: counts.where(F.col(k) > 0).select("host", (F.col(k) / F.lit(float(n or 1))).alias("seed")) for k, n in (("allowed", sums.a), ("blocked", sums.b))}
    trust = propagate(edges, seeds["allowed"], tolerance, damping, "trust").withColumnRenamed("score", "trust")
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(against, seeds["blocked"], tolerance, damping, "distrust").withColumnRenamed("score", "distrust")
    scores = saved(counts.select("host").join(trust, "host", "left").join(distrust, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "scores")
    by_method = F.when(F.col("distrust") > (F.col("trust") + margin) * (1 + SLACK), F.lit("block")).otherwise(F.lit("allow"))
    # urls without a host, which may be many, have no score to be joined with
    out = ruled.where("host != ''").join(scores, "host", "left").unionByName(ruled.where("host = ''"), allowMissingColumns=True)
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), by_method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the result carries the verdicts that the scores give, not the scores
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle(rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """DuckDB SQL for op2_url_filters: the rounds of the walk are unrolled."""
    lower = "translate({}, '" + _UPPER + "', '" + _LOWER + "')"
    case = []
    for verdict, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        case.append((f"(host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '{slash + rest}')", rule, verdict))
    rule_sql = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in case) + " END"
    verdict_sql = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in case) + " END"
    ctes = [
        "rests AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"urls AS (SELECT page_id, html, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)",
        f"ruled AS (SELECT page_id, host, path, {rule_sql} AS rule, {verdict_sql} AS verdict FROM urls)",
        "hosts AS (SELECT host, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked FROM ruled WHERE host <> '' GROUP BY host)",
        f"named AS (SELECT page_id, host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{HOSTNAME}'), lambda h: {lower.format('h')}))) AS dst FROM urls WHERE host <> '')",
        "edges AS (SELECT src, dst, count(*) AS n FROM named WHERE src <> dst AND dst IN (SELECT host FROM hosts) GROUP BY src, dst)",
    ]
    for name, seed, a, b in (("t", "allowed", "src", "dst"), ("d", "blocked", "dst", "src")):
        ctes.append(f"{name}e AS (SELECT {a} AS src, {b} AS dst, n / sum(n) OVER (PARTITION BY {a}) AS share FROM edges)")
        ctes.append(f"{name}s AS (SELECT host, {seed}::DOUBLE / (SELECT sum({seed}) FROM hosts) AS seed FROM hosts WHERE {seed} > 0)")
        ctes.append(f"{name}0 AS (SELECT host, seed AS score FROM {name}s)")
        for i in range(rounds):
            ctes.append(f"{name}{i + 1} AS (SELECT host, sum(score) AS score FROM (SELECT e.dst AS host, {damping} * p.score * e.share AS score FROM {name}{i} p JOIN {name}e e ON p.host = e.src UNION ALL SELECT host, {1 - damping} * seed FROM {name}s) GROUP BY host)")
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT r.page_id, r.host, r.path, r.rule, coalesce(r.verdict, CASE WHEN coalesce(d.score, 0) > coalesce(t.score, 0) * {1 + SLACK!r} THEN 'block' ELSE 'allow' END) AS verdict "
        f"FROM ruled r LEFT JOIN t{rounds} t ON r.host = t.host LEFT JOIN d{rounds} d ON r.host = d.host"
    )
