"""URL filters: rules for hosts and paths, and trust that spreads over links between hosts.

Where no rule fits, a host is judged by two personalised PageRanks over the host graph: trust
flows along links from trusted hosts, distrust flows against links from blocked ones, so that a
host which links to blocked hosts takes on their distrust. Everything is built from DataFrame
functions, and every round of the iteration is a table in the shared folder.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import stored


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


DAMPING, TOLERANCE = 0.85, 1e-6
#: A host is a seed if a rule allows or blocks at least this share of its pages.
SEED_SHARE = 0.5
#: A host is blocked if its share of all distrust is more than this many times its share of trust.
RATIO = 1.0

HOST = r"://([^/?#]*)"
PATH = r"://[^/?#]*([^?#]*)"
#: Hosts of absolute and protocol-relative links; the others stay on their host.
LINK = r"""(?i)\shref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``, or null."""
    found = []
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found.append(F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*found, none)


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """``src``, ``dst`` and the number of pages of ``src`` that link to ``dst``, another host.

    ``pages`` has a column ``host``. The links of a page count once, and counting starts before
    the shuffle, so a host with very many pages arrives as one row per task and target.
    """
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))
    return (
        pages.filter(F.col("host") != "")
        .select(F.col("host").alias("src"), F.explode(found).alias("dst"))
        .filter(F.col("src") != F.col("dst"))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: ``kind``, ``host`` and ``score``, which sum to 1 for each kind.

    ``edges`` has ``kind``, ``src``, ``dst`` and ``weight``, ``seeds`` has ``kind`` and ``host``.
    Each round is one join by source and one sum by target. The tables are stored, so both sides
    of the join are plain shuffles, in which adaptive execution splits a host with very many
    links. What ends at hosts without links goes back to the seeds. It stops when a round moves
    less than the tolerance and reaches no host that no round has reached before. A round moves at
    most ``damping`` times what the one before it moved, so the tolerance is met within about 95
    rounds; chains that are longer take a round per link.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    out = stored(out, "out")
    edges = stored(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("all")).alias("share")), "edges")
    sizes = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    start = stored(seeds.join(F.broadcast(sizes), "kind").select("kind", "host", (1 / F.col("n")).alias("score")), "seeds")
    scores = start
    while True:
        moved = (
            scores.join(edges, (scores["kind"] == edges["kind"]) & (scores["host"] == edges["src"]))
            .groupBy(edges["kind"], edges["dst"].alias("host"))
            .agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        )
        moved = stored(moved, "moved")
        kept = moved.groupBy("kind").agg(F.sum("in").alias("kept"))
        back = start.join(F.broadcast(kept), "kind", "left").select(
            "kind", "host", (F.col("score") * (1 - damping * F.coalesce("kept", F.lit(0.0)))).alias("part")
        )
        step = back.unionByName(moved.select("kind", "host", (damping * F.col("in")).alias("part")))
        step = step.unionByName(scores.select("kind", "host", F.lit(0.0).alias("part")))
        old = scores.select("kind", "host", F.lit(0.0).alias("part"), F.col("score").alias("old"))
        step = step.withColumn("old", F.lit(0.0)).unionByName(old)
        new = stored(step.groupBy("kind", "host").agg(F.sum("part").alias("score"), F.sum("old").alias("old")), "scores")
        reached = F.count_if((F.col("old") == 0) & (F.col("score") > 0)).alias("reached")
        done = new.agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("gap"), reached).first()
        scores = new.select("kind", "host", "score")
        if (done["gap"] or 0.0) < tolerance and not done["reached"]:
            return scores


def judged_hosts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``host``, ``trust``, ``distrust`` and ``blocked`` of all hosts that trust or distrust reaches.

    ``pages`` has ``host``, ``ruled`` (the verdict of its rule or null) and the page.
    """
    share = {v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0)) for v in ("allow", "block")}
    hosts = stored(
        pages.filter(F.col("host") != "").groupBy("host").agg(*[share[v].alias(v) for v in share]), "hosts"
    )
    seeds = hosts.filter(F.col("allow") >= SEED_SHARE).select(F.lit("trust").alias("kind"), "host").unionByName(
        hosts.filter((F.col("block") >= SEED_SHARE) & (F.col("allow") < SEED_SHARE)).select(F.lit("distrust").alias("kind"), "host")
    )
    links = stored(host_edges(pages, html), "links")
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    scores = propagated(edges, seeds)
    both = scores.groupBy("host").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")]
    )
    return both.withColumn("blocked", F.col("distrust") > RATIO * F.col("trust"))


def url_verdicts(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust``.

    The longest fitting rule decides. Other pages are blocked if their host has more distrust
    than trust, and allowed otherwise, hosts that neither reaches and pages without a host among
    them. A null url or one without ``://`` has an empty host and path; null html has no links;
    repeated rows are judged alike.
    """
    read = pages.select(F.col(id_col).alias(id_col), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    read = read.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    read = read.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    read = read.select(id_col, "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"), "html")
    hosts = stored(judged_hosts(read).withColumnRenamed("host", "_host"), "judged")
    joined = read.drop("html").join(hosts, F.col("host") == F.col("_host"), "left")
    judged = F.when(F.col("blocked"), "block").otherwise("allow")
    return joined.select(
        id_col, "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
