"""Url verdicts: rules by host and path, and trust that spreads over the links between hosts.

Hosts are the nodes of a graph.  An edge goes from the host of a page to each other host that the page links to, and
between a host and the nearest host above it in its domain (``www.a.example`` and ``a.example``) both ways.  Trust is a
personalised PageRank from the hosts with allowed pages along the edges; distrust one from the hosts with blocked pages
against them, as who links to bad hosts deserves less trust.  Seeds weigh by their share of allowed or blocked pages.
A page without a rule is blocked if its host's distrust exceeds both its trust and a part of what a wholly blocked host
starts with.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``,
``#`` or the end; both are empty for urls that are null or have no ``://``.  Pages without host get no edges and, for
want of a rule, are allowed.  Repeated pages weigh as often as they are there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.llm.graph import hot_values, lookup
from wayledger.session import checkpointed, forget

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The absolute targets of links in a page.
_LINK = r"""(?i)\bhref\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """For a host with all its subdomains and paths that start like ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


@dataclass(frozen=True)
class Spread:
    #: A walk ends when all that is still to come is less than this part of what its seeds started with.
    tolerance: float = 1e-3
    follow: float = 0.85
    threshold: float = 0.2


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(verdict, name) of the longest rule that fits, or null."""
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    cases = [F.when(r.fits(host, path), F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("name"))) for r in longest]
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<verdict:string,name:string>")


def link_edges(pages: DataFrame) -> DataFrame:
    """(source, target, weight) between different hosts, from the pages' ``host`` and ``html``."""
    links = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("url"))
    edges = links.select(F.col("host").alias("source"), host_of(F.col("url")).alias("target"))
    edges = edges.where("target <> '' and source <> target")
    return edges.groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """Edges both ways between each host and the nearest one above it among the ``host`` values."""
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    named = hosts.where(F.size(parts) > 2).select("host", F.posexplode(above).alias("steps", "up"))
    # A domain may have any number of hosts below it.
    found = lookup(named, "up", hosts.select(F.col("host").alias("up"), F.lit(True).alias("known"))).where("known")
    nearest = found.groupBy("host").agg(F.min_by("up", "steps").alias("up"))
    ways = F.array(F.struct("host", "up"), F.struct(F.col("up").alias("host"), F.col("host").alias("up")))
    return nearest.select(F.inline(ways)).select(F.col("host").alias("source"), F.col("up").alias("target"), F.lit(1.0).alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, settings: Spread) -> DataFrame:
    """Personalised PageRank: (node, score) where ``seeds`` (node, score) says where a walk starts again.

    Only nodes that a walk reaches have a row; weight that comes to a node without edges starts again at no seed.  The
    walk goes on from its starts, a link a round, until what later rounds could add is below the tolerance.
    """
    out = edges.groupBy("source").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    hot = hot_values(out, "source", edges.count())
    parts = lookup(edges, "source", out.select("source", "total"), hot)
    parts = checkpointed(parts.select("source", "target", (F.col("weight") / F.col("total")).alias("part")))
    started = seeds.select("node", (F.col("score") * (1 - settings.follow)).alias("score"))
    scores = checkpointed(started)
    mass = scores.agg(F.sum("score")).first()[0] or 0.0
    enough, fresh = settings.tolerance * mass / (1 - settings.follow), mass
    while fresh * settings.follow / (1 - settings.follow) > enough:
        here = scores.select(F.col("node").alias("source"), "score")
        moved = lookup(parts, "source", here, hot).where("score is not null")
        moved = moved.select(F.col("target").alias("node"), (F.col("score") * F.col("part") * settings.follow).alias("score"))
        before, scores = scores, checkpointed(moved.unionByName(started).groupBy("node").agg(F.sum("score").alias("score")))
        forget(before)
        total = scores.agg(F.sum("score")).first()[0] or 0.0
        # Rounds add less and less: what a round adds is what moved on from the one before.
        fresh, mass = max(total - mass, 0.0), total
    forget(parts)
    return scores


def judge(pages: DataFrame, rules: list[Rule], settings: Spread = Spread()) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of ``page_id``, ``url`` and ``html``."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    # One row per host, whatever the number of its pages.
    shares = [F.avg((F.coalesce(F.col("rule.verdict"), F.lit("")) == v).cast("double")).alias(v) for v in ("allow", "block")]
    hosts = checkpointed(rows.where("host <> ''").groupBy("host").agg(*shares))
    edges = link_edges(rows).unionByName(domain_edges(hosts))
    edges = checkpointed(edges.groupBy("source", "target").agg(F.sum("weight").alias("weight")))
    reverse = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    # Both walks at once, over two copies of the graph whose nodes have their walk's name in front.
    walks = {"trust": (edges, "allow"), "distrust": (reverse, "block")}
    copies, seeds = [], []
    for name, (along, verdict) in walks.items():
        ends = [F.concat(F.lit(f"{name} "), F.col(c)).alias(c) for c in ("source", "target")]
        copies.append(along.select(*ends, "weight"))
        node = F.concat(F.lit(f"{name} "), "host").alias("node")
        seeds.append(hosts.where(F.col(verdict) > 0).select(node, F.col(verdict).alias("score")))
    reached = spread(checkpointed(reduce(DataFrame.unionByName, copies)), reduce(DataFrame.unionByName, seeds), settings)
    walk, host = F.substring_index("node", " ", 1), F.substring_index("node", " ", -1).alias("host")
    each = [F.sum(F.when(walk == name, F.col("score"))).alias(name) for name in walks]
    scores = reached.groupBy(host).agg(*each)
    slim = rows.drop("html")
    # Hosts are few against pages, but one may hold a large part of them.
    counted = slim.groupBy("host").agg(F.count("*").alias("n"))
    totals = checkpointed(counted)
    hot = hot_values(totals, "host", totals.agg(F.sum("n")).first()[0] or 0)
    joined = lookup(slim, "host", scores, hot)
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in walks)
    bad = (distrust > settings.threshold * (1 - settings.follow)) & (distrust > trust)
    method = F.when(bad, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        "page_id",
        "host",
        "path",
        F.col("rule.name").alias("rule"),
        F.coalesce(F.col("rule.verdict"), method).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )
