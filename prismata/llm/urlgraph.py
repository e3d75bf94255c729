"""URL filters: allow and block rules, and trust propagated over the graph of hosts (DataFrame operations only).

Rules name a host and a path prefix; a rule fits its host and all subdomains, the longest
fitting rule (as a string) decides. Urls without a rule get the verdict of their host:
personalised PageRank spreads trust from hosts with allowed pages along links, and
distrust from hosts with blocked pages against them; a host is blocked if its distrust
exceeds THRESHOLD times its trust. Hosts without either are allowed.

Null urls and urls without ``://`` have an empty host and path, no rule, and are allowed;
they are no node of the graph. Links of a page to its own host carry nothing. Repeated
pages count as often as they occur; a dangling host gives nothing on. Each round is
written to shared storage; rounds end when ranks hardly change, so a trust reaches hosts at
any distance. A graph without links needs none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismata.session import materialize, small_side

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING = 0.85
#: Ranks change by less than this in all when the rounds end; each round leaves DAMPING of the change before it, so so many rounds suffice.
TOLERANCE = 1e-3
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
THRESHOLD = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute or protocol-relative link.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a string; null if none does."""
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), h + p).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for h, p, v in rules:
        out = F.when(rule == h + p, v).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): each host's links to other hosts; the weights of a host's links add up to 1."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1)))).alias("to"))
    edges = links.select("src", F.translate("to", UPPER, LOWER).alias("dst")).filter("src != dst AND src != ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = edges.groupBy("src").agg(F.sum("n").alias("all"))
    return edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("w"))


def _spread(seeds: DataFrame, edges: DataFrame, seed: str, src: str, dst: str, rounds: int, damping: float) -> DataFrame:
    """(host, rank): personalised PageRank from the seed weights along src -> dst."""
    rank = seeds.select("host", F.col(seed).alias("rank"))
    for _ in range(rounds):
        sent = edges.join(rank, edges[src] == rank["host"]).groupBy(F.col(dst).alias("host")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        new = F.lit(1 - damping) * F.col(seed) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        step = seeds.join(sent, "host", "left").join(rank.withColumnRenamed("rank", "old"), "host").select("host", new.alias("rank"), "old")
        rank = materialize(step, "url-rank")
        moved = rank.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        rank = rank.select("host", "rank")
        if moved < TOLERANCE / 100:
            break
    return rank


def host_verdicts(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, verdict) of every host that has a page or is linked to."""
    edges = materialize(host_edges(pages), "url-edges")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(host.alias("host"), verdict_of(rule_of(host, path, rules), rules).alias("v")).filter("host != ''")
    own = judged.groupBy("host").agg(F.count_if(F.col("v") == "allow").alias("good"), F.count_if(F.col("v") == "block").alias("bad"))
    linked = edges.select(F.col("dst").alias("host"), F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("bad")).distinct()
    nodes = own.unionByName(linked).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    n = own.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    share = lambda c: F.col(c) / float(max(n[c] or 0, 1))
    seeds = materialize(nodes.select("host", share("good").alias("good"), share("bad").alias("bad")), "url-seeds")
    if edges.isEmpty():
        ranks = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    else:
        out_weight = edges.groupBy("dst").agg(F.sum("w").alias("all"))
        back = materialize(edges.join(out_weight, "dst").select("src", "dst", (F.col("w") / F.col("all")).alias("w")), "url-back")
        trust = _spread(seeds, edges, "good", "src", "dst", rounds, damping).withColumnRenamed("rank", "trust")
        distrust = _spread(seeds, back, "bad", "dst", "src", rounds, damping).withColumnRenamed("rank", "distrust")
        ranks = trust.join(distrust, "host")
    return ranks.withColumn("verdict", F.when(F.col("distrust") > F.col("trust") * threshold, "block").otherwise("allow"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    hosts = small_side(materialize(host_verdicts(pages, rules).select("host", F.col("verdict").alias("v")), "url-verdicts"))
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.join(hosts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), "v", F.lit("allow")).alias("verdict"))


def op3_url_graph(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle() -> str:
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    fits = lambda h, p: f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"
    rules = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    says = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    rounds = []
    for name, seed, src, dst, weights in (("t", "good", "src", "dst", "edges"), ("d", "bad", "dst", "src", "back")):
        rounds.append(f"{name}0 AS (SELECT host, {seed} AS rank FROM seeds)")
        rounds += [
            f"{name}{i + 1} AS (SELECT s.host, {1 - DAMPING} * s.{seed} + {DAMPING} * coalesce(g.got, 0) AS rank FROM seeds s LEFT JOIN (SELECT e.{dst} AS host, sum(r.rank * e.w) AS got FROM {weights} e JOIN {name}{i} r ON e.{src} = r.host GROUP BY 1) g USING (host))"
            for i in range(ROUNDS)
        ]
    link = LINK.replace("'", "''")
    return rf"""
WITH u AS (SELECT page_id, html, {low("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT page_id, html, host, path, CASE {rules} END AS rule FROM u),
v AS (SELECT *, CASE rule {says} END AS said FROM p),
links AS (SELECT host AS src, {low("unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '" + link + "', 1)))")} AS dst FROM v),
counted AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND src <> '' GROUP BY 1, 2),
edges AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM counted),
back AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY dst) AS w FROM edges),
own AS (SELECT host, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad FROM v WHERE host <> '' GROUP BY 1
        UNION ALL SELECT DISTINCT dst, 0, 0 FROM edges),
seeds AS (SELECT host, sum(good) / greatest((SELECT sum(good) FROM own), 1) AS good, sum(bad) / greatest((SELECT sum(bad) FROM own), 1) AS bad FROM own GROUP BY 1),
{", ".join(rounds)}
SELECT page_id, v.host, path, rule, coalesce(said, CASE WHEN d{ROUNDS}.rank > t{ROUNDS}.rank * {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN t{ROUNDS} ON v.host = t{ROUNDS}.host LEFT JOIN d{ROUNDS} ON v.host = d{ROUNDS}.host
"""
