"""URL verdicts from rules and from trust and distrust over the host graph.

Rules name a host and a path.  A rule fits its host and all subdomains where the
url's path starts with the rule's, and the longest fitting rule decides.  For the
rest, personalised PageRank carries trust from the hosts of allowed pages along
their links, and distrust from the hosts of blocked pages against them, from a
page to those that link to it.  A host is blocked where its distrust exceeds its
trust by ``tolerance`` times.

The steps go on until no further host is reached and less than a millionth of
the mass is left to spread: some 80 steps where links run in circles, and as many
as the longest way from a seed, if that is more.  A verdict can only differ from
the limit's where trust and distrust are closer than that.

Edges are links between hosts, counted once a page pair and weighted by their
share of the source's links.  All of it is DataFrame operations, with the ranks
cut at each step; the sums aggregate before they shuffle, and a host with very
many links is a skewed join key, which adaptive execution splits.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and takes no part in the graph, and is allowed; a null page text
links nowhere; a link to its own host is no edge; repeated rows count again; a
null page id stays null; equal trust and distrust allow; rules of one length are
taken as they stand; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tarn.llm.common import cut

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Steps between two tests of convergence; with a damping of 0.85 they more than halve what is left.
CHECKED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What is after the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What is after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; null where none fits."""
    rule = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.lit(rule_host + rule_path)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, weight): links between hosts; the weights of a src sum to 1."""
    link = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""), 1))
    counted = (
        pages.select(host_of(F.col(url_col)).alias("src"), link.alias("link"))
        .where(F.col("link").contains("://") | F.col("link").startswith("//"))
        .select("src", host_of(F.regexp_replace("link", "^//", "http://")).alias("dst"))
        .where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )
    total = counted.groupBy(F.col("src").alias("total_src")).agg(F.sum("n").alias("total"))
    return counted.join(total, F.col("src") == F.col("total_src")).select(
        "src", "dst", (F.col("n") / F.col("total")).alias("weight")
    )


def reversed_edges(edges: DataFrame) -> DataFrame:
    """The edges turned round, with weights that sum to 1 again."""
    total = edges.groupBy(F.col("dst").alias("total_dst")).agg(F.sum("weight").alias("total"))
    return edges.join(total, F.col("dst") == F.col("total_dst")).select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("total")).alias("weight")
    )


def propagated(
    seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6
) -> DataFrame:
    """(host, score): personalised PageRank from seeds (host, mass) of total 1.

    What comes to hosts without links goes back to the seeds.  That only adds to
    what the seeds give out, so the scores are those of lost mass, divided by
    their sum.

    Scores only grow from step to step, and each step's growth is at most
    ``damping`` times the last one's, so where ``CHECKED`` steps add no more than
    ``tolerance`` in all, all later steps add less than that.
    """
    base = rank = cut(seeds.select("host", (F.col("mass") * (1 - damping)).alias("score")))
    last = reached(rank)
    while True:
        for _ in range(CHECKED):
            spread = (
                rank.join(edges, F.col("host") == F.col("src"))
                .groupBy(F.col("dst").alias("host"))
                .agg((F.sum(F.col("score") * F.col("weight")) * damping).alias("score"))
            )
            rank = cut(base.union(spread).groupBy("host").agg(F.sum("score").alias("score")))
        now = reached(rank)
        if now.hosts == last.hosts and now.total - last.total <= tolerance:
            return rank.select("host", (F.col("score") / (now.total or 1.0)).alias("score"))
        last = now


def reached(rank: DataFrame) -> Row:
    """How many hosts have a score, and the sum of their scores."""
    return rank.agg(F.count("*").alias("hosts"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("total")).first()


def seeds_of(hosts: DataFrame, column: str) -> DataFrame:
    """(host, mass): a host's share of the pages that ``column`` counts."""
    some = hosts.where(F.col(column) > 0)
    total = some.agg(F.sum(column).alias("all"))
    return some.join(F.broadcast(total)).select("host", (F.col(column) / F.col("all")).alias("mass"))


def judged(
    pages: DataFrame,
    rules=RULES,
    tolerance: float = 1.0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust."""
    url = F.col(url_col)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    listed = cut(
        pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumn("rule", rule)
        .withColumn("ruled", verdict)
    )
    hosts = cut(
        listed.where("host <> ''")
        .groupBy("host")
        .agg(
            F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"),
            F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
        )
    )
    edges = cut(host_edges(pages, url_col, html_col))
    trust = propagated(seeds_of(hosts, "allowed"), edges)
    distrust = propagated(seeds_of(hosts, "blocked"), cut(reversed_edges(edges)))
    scores = cut(
        trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust"))
        .union(distrust.select("host", F.lit(0.0), "score"))
        .groupBy(F.col("host").alias("scored_host"))
        .agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    )
    bad = F.coalesce(F.col("distrust") > F.col("trust") * tolerance, F.lit(False))
    return listed.join(scores, F.col("host") == F.col("scored_host"), "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
