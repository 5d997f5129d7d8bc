"""URL filter: host and path rules, and propagation over the graph of hosts for the rest.

Rules decide the urls they fit, the longest rule first. For the others a host's links
count: trust starts from hosts with allowed pages alone and flows along links (personalised
PageRank); distrust starts from hosts with blocked pages and flows against them, to
those who link there. A host is blocked when its distrust exceeds its trust and is at
least ``threshold`` of what a host of blocked pages alone starts with. Both are iterated
until no host is further than ``TOLERANCE`` from the limit.

Urls are judged as rows, rules are joined per distinct host, the graph is one row per
pair of hosts, and every round of the propagation is a stored table, so a lost
executor costs one round.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.texts import column
from corpusloom.operators.lookups import lookup_join
from corpusloom.sources.cache import spool

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Share of a wholly blocked host's own start from which distrust counts.
THRESHOLD = 0.2
#: Most that a rank may be off from its limit.
TOLERANCE = 1e-6
#: Absolute or scheme-relative targets of links.
LINK = r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(_behind_scheme(url), F.lit("")), "^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(_behind_scheme(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(rule_host, rule_path, rule, rule_verdict) from (verdict, "host/path") pairs."""
    rows = []
    for verdict, rule in rules:
        if verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"not a rule: {verdict} {rule}")
        host, path = rule.split("/", 1)
        values = {"rule_host": host, "rule_path": "/" + path, "rule": rule, "rule_verdict": verdict}
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in values.items()]))
    empty = F.expr("cast(array() as array<struct<rule_host:string,rule_path:string,rule:string,rule_verdict:string>>)")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))


def _rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules that fit each host, longest first, ties by name."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fits = hosts.select("host", F.explode(suffixes).alias("rule_host"))
    found = lookup_join(fits, rules.groupBy("rule_host").agg(F.collect_set(F.struct((-F.length("rule")).alias("n"), "rule", "rule_path", "rule_verdict")).alias("some")), "rule_host", "inner", ["host"])
    return found.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("some"))).alias("rules"))


def _propagate(edges: DataFrame, seeds: DataFrame, source: str, target: str) -> DataFrame:
    """(host, rank): personalised PageRank along ``source`` -> ``target`` from ``seeds`` (host, seed).

    A round moves all ranks together by at most ``DAMPING`` of what the round before moved
    them, so what is left to move is known from the last move, and the rounds are bounded
    by the logarithm of the seeds.
    """
    links = edges.select(F.col(source).alias("from"), F.col(target).alias("to"))
    out = links.groupBy("from").agg(F.count("*").alias("n"))
    # a host of very many links is spread by their ends
    shares = spool(lookup_join(links, out, "from", "inner", ["to"]).select("from", "to", (DAMPING / F.col("n")).alias("share")))
    base = seeds.select("host", ((1 - DAMPING) * F.col("seed")).alias("base"))
    if shares.isEmpty():
        return base.select("host", F.col("base").alias("rank"))
    hosts = base.select("host").unionByName(shares.select(F.col("to").alias("host"))).distinct()
    ranks = spool(hosts.join(base, "host", "left").select("host", F.coalesce("base", F.lit(0.0)).alias("base")))
    total = ranks.agg(F.sum("base")).first()[0]
    ranks = ranks.select("host", "base", F.col("base").alias("rank"))
    left = DAMPING / (1 - DAMPING)
    # the first move is at most DAMPING times all ranks
    rounds = max(0, math.ceil(math.log(max(total, 1e-300) * left / TOLERANCE, 1 / DAMPING))) + 1
    for _ in range(rounds):
        given = ranks.where("rank > 0").select(F.col("host").alias("from"), "rank")
        flow = lookup_join(shares, given, "from", "inner", ["to"])
        flow = flow.groupBy(F.col("to").alias("host")).agg(F.sum(F.col("share") * F.col("rank")).alias("flow"))
        new = F.col("base") + F.coalesce("flow", F.lit(0.0))
        ranks = spool(
            ranks.join(flow, "host", "left").select(
                "host", "base", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")
            )
        )
        moved = ranks.agg(F.sum("moved")).first()[0]
        ranks = ranks.drop("moved")
        if moved * left <= TOLERANCE:
            return ranks.select("host", "rank")
    raise RuntimeError(f"ranks still move by {moved} after {rounds} rounds")


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target): pairs of different hosts of which one links to the other."""
    links = F.regexp_extract_all(F.coalesce(column(html), F.lit("")), F.lit(LINK), F.lit(1))
    target = F.transform(
        links, lambda x: host_of(F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x)).otherwise(x))
    )
    found = pages.select(host_of(column(url)).alias("source"), F.explode(F.array_distinct(target)).alias("target"))
    return found.where("source <> '' AND target <> '' AND source <> target").distinct()


def judge(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust) of every row.

    A null url, or one without ``://``, has empty host and path; no rule fits it and,
    as no link names it, it is allowed. Null html has no links. A host's start is the
    share of its pages that rules allow, or block; with neither it has no start. Repeated
    rows are judged alike; of rules equally long the first by name wins. An empty table
    gives an empty one; other columns are not read.
    """
    parsed = pages.select(column(key).alias(key), host_of(column(url)).alias("host"), path_of(column(url)).alias("path"))
    hosts = parsed.where("host <> ''").select("host").distinct()
    with_rules = lookup_join(parsed, _rules_by_host(hosts, rules), "host", "left", ["path"])
    fitting = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    best = F.when(F.size(fitting) > 0, F.element_at(fitting, 1))
    ruled = spool(
        with_rules.select(key, "host", "path", best["rule"].alias("rule"), best["rule_verdict"].alias("rule_verdict"))
    )
    share = lambda which: F.avg(F.when(which, 1.0).otherwise(0.0))
    starts = ruled.where("host <> ''").groupBy("host").agg(
        share(F.col("rule_verdict") == "allow").alias("trust"),
        share(F.col("rule_verdict") == "block").alias("distrust"),
    )
    starts = spool(starts)
    edges = spool(host_edges(pages, url, html))
    trust = _propagate(edges, starts.select("host", F.col("trust").alias("seed")), "source", "target")
    distrust = _propagate(edges, starts.select("host", F.col("distrust").alias("seed")), "target", "source")
    ranks = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    ranks = spool(ranks.select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")]))
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * (1 - DAMPING))
    final = lookup_join(ruled, ranks.withColumn("_bad", bad), "host", "left", ["path"])
    verdict = F.coalesce(F.col("rule_verdict"), F.when(F.col("_bad"), "block").otherwise("allow"))
    return final.select(key, "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
