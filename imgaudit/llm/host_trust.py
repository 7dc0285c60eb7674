"""Verdicts for urls: rules where one fits, else trust that flows over links between hosts.

A rule names a host and the start of a path; it fits the host and its subdomains, and the
longest rule that fits a url decides. Hosts with urls that rules allow are trusted seeds,
and hosts with urls that rules block are distrusted seeds, each by its share of such urls.
Links between pages of different hosts, counted per pair of hosts, carry trust forward and
distrust backward, both as personalised PageRank, until what is still on its way is at most
``TOLERANCE`` of all mass. A host is blocked where distrust exceeds trust by the factor
``BLOCKING``; its urls without a rule follow.

Links are found and counted in Spark, and every step joins and aggregates host edges, one
row per pair of hosts. A hub's edges are spread by salting its rank.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and
is allowed; an empty host is no node; relative links and links to the same host are no
edges; a null html has no links; ties between rules cannot occur, as a rule is one (host,
path) and the longer of two that fit wins; repeated pages count each; a host without
trust and distrust is allowed; an empty table gives no rows; very long texts are read whole,
in time linear in their length; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgaudit.llm.common import written

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING, TOLERANCE, BLOCKING, SALTS = 0.85, 1e-4, 1.0, 16
FOLDED = 16  # steps whose masses are added up together
ANCHOR, LINK = r"(?i)<a\s", r"(?i)^[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """Between ``://`` and the first ``/``, ``?`` or ``#``, A-Z lowered; empty if there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(rest, upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict), or null; rules are a short constant list."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])))
    for name, start, verdict in ordered:
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, rule).otherwise(found)
    return found


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id",
           url: str = "url") -> DataFrame:
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"),
                        path_of(F.col(url)).alias("path"))
    return rows.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", "found.rule", F.col("found.verdict").alias("ruled"))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links from one host to another: ``source``, ``target``, number of links."""
    # every piece belongs to one anchor, so unclosed anchors are not read again and again
    pieces = F.split(F.coalesce(F.col(html), F.lit("")), ANCHOR, -1)
    anchors = pages.select(host_of(F.col(url)).alias("source"), F.posexplode(pieces).alias("at", "piece"))
    links = anchors.filter("at > 0").select("source", F.regexp_extract("piece", LINK, 1).alias("link"))
    # any other link is relative, also one that holds a whole url further on
    absolute = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).when(
        F.col("link").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("link"))
    named = links.select("source", host_of(absolute).alias("target"))
    return named.filter("source <> '' and target <> '' and source <> target").groupBy(
        "source", "target").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, start: str, end: str) -> DataFrame:
    """Personalised PageRank along edges from ``start`` to ``end``: ``host``, ``mass``.

    Mass that reaches a host without edges goes back to the seeds. That only scales the
    masses, so each step moves the mass of the last one on, a join on the salted host and a
    sum that is combined per task, and the sum over all steps is scaled to 1 at the end.
    """
    total = seeds.agg(F.sum("mass")).first()[0] or 0.0
    if not total:
        return seeds.select("host", F.lit(0.0).alias("mass"))
    seeds = written(seeds.select("host", (F.col("mass") / total).alias("mass")), "seeds")
    salt = F.pmod(F.xxhash64(end), F.lit(SALTS)).cast("int")
    weights = edges.groupBy(start).agg(F.sum("links").alias("all")).withColumnRenamed(start, "host")
    shares = written(edges.withColumnRenamed(start, "host").join(weights, "host").select(
        "host", F.col(end).alias("to"), (F.col("links") / F.col("all")).alias("share"),
        salt.alias("salt")), "shares")
    added, moving, sent = [seeds], seeds, 1.0
    while True:
        salted = moving.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        moving = written(shares.join(salted, ["host", "salt"]).groupBy(F.col("to").alias("host")).agg(
            F.sum(F.col("mass") * F.col("share") * F.lit(DAMPING)).alias("mass")), "moving")
        left = moving.agg(F.sum("mass")).first()[0] or 0.0
        sent += left
        added.append(moving)
        if left <= TOLERANCE * (1 - DAMPING) * sent:  # all later steps add at most left / (1 - DAMPING)
            return _sums(added).select("host", (F.col("mass") / F.lit(sent)).alias("mass"))
        if len(added) > FOLDED:
            added = [written(_sums(added), "mass")]


def _sums(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("host").agg(F.sum("mass").alias("mass"))


def host_scores(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Trust and distrust of every host with a page or a link, and its verdict.

    Both masses count in pages: the seeds' total is the number of urls their rules decide.
    """
    ruled = written(rows.filter("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"),
        F.count_if(F.col("ruled") == "block").alias("blocked")), "hosts")
    edges = written(edges, "edges")
    sums = ruled.agg(F.sum("allowed"), F.sum("blocked")).first()
    scores = ruled.select("host", "pages")
    for name, column, total, start, end in (("trust", "allowed", sums[0], "source", "target"),
                                            ("distrust", "blocked", sums[1], "target", "source")):
        seeds = ruled.filter(F.col(column) > 0).select("host", F.col(column).cast("double").alias("mass"))
        mass = propagate(edges, seeds, start, end).select(
            "host", (F.col("mass") * F.lit(float(total or 0))).alias(name))
        scores = scores.join(mass, "host", "left").fillna(0.0, [name])
    blocked = F.col("distrust") > F.lit(BLOCKING) * F.col("trust")
    return scores.withColumn("host_verdict", F.when(blocked, "block").otherwise("allow"))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
                 page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: host, path, the rule that fits, and the rule's or the host's verdict."""
    rows = written(judged(pages, rules, page_id, url), "judged")
    scores = host_scores(rows, host_edges(pages, url, html))
    return rows.join(scores.drop("pages"), "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
