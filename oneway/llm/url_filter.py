"""URL filters: rules first, then trust and distrust over the host graph.

A rule allows or blocks a host, with all its subdomains, under a path prefix; the longest fitting rule decides.  All other
urls are judged per host: personalised PageRank flows from hosts with allowed pages along links, distrust flows from hosts
with blocked pages against links (who links to a blocked host inherits some of it).  Host edges are absolute links in the html
and the steps between a host and its parent domain.  Ranks are scaled to 1 over all seeds, so they are counted in pages before they are
held against anything: a host is blocked if its distrust, times all blocked pages, exceeds its trust, times all allowed pages, and
reaches the threshold.  So neither allowed nor blocked pages elsewhere change a verdict.

Scale: edges are summed per host pair before anything is shuffled twice; each step joins edges with one row per host, which
Spark can split where a host has very many edges, and sums per target with partial aggregation.  Ranks are written to the
shared folder every few steps.

Rows: a null url, or one without ``://``, has empty host and path, fits no rule and gets the default verdict allow.  A null html
has no links.  Repeated rows are judged alike.  Extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oneway.llm.shared import materialize

Rule = tuple[str, str, str]
LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def _fold(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(pages: DataFrame) -> DataFrame:
    """Adds host and path to rows with a url."""
    rest = F.coalesce(_rest(F.col("url")), F.lit(""))
    pages = pages.withColumn("__rest", rest)
    return pages.withColumns({"host": _fold(F.regexp_extract("__rest", "^([^/?#]*)", 1)), "path": F.regexp_extract("__rest", "^[^/?#]*([^?#]*)", 1)}).drop("__rest")


def rule_of(rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct (rule, action), or null.  Equally long rules: block comes first."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts: absolute links counted, and one step each way to the parent domain."""
    links = pages.where("host <> '' and html is not null").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    links = links.select(F.col("host").alias("src"), _fold(F.regexp_extract("link", "//([^/?#]*)", 1)).alias("dst"))
    parent = F.expr("substring(host, instr(host, '.') + 1)")
    hosts = pages.where("host <> ''").select("host").distinct()
    up = hosts.where("instr(host, '.') > 0").select(F.col("host").alias("src"), parent.alias("dst")).where("instr(dst, '.') > 0")
    both = links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, steps: int = 12, damping: float = 0.85, every: int = 4) -> DataFrame:
    """(kind, host, rank) from seeds (kind, host, mass) with kinds trust and distrust; masses of a kind are scaled to 1.  Rank
    that reaches a host without further edges stays there, so it sums to 1 for seeds that have edges."""
    flows = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    flows = flows.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))
    outs = flows.groupBy("kind", "a").agg(F.sum("weight").alias("total"))
    sinks = flows.select("kind", F.col("b").alias("a")).distinct().join(outs, ["kind", "a"], "left_anti")
    flows = flows.unionByName(sinks.select("kind", "a", F.col("a").alias("b"), F.lit(1.0).alias("weight")))
    outs = outs.unionByName(sinks.select("kind", "a", F.lit(1.0).alias("total")))
    flows = materialize(flows.join(outs, ["kind", "a"]).select("kind", "a", "b", (F.col("weight") / F.col("total")).alias("share")), "edges")
    total = seeds.groupBy("kind").agg(F.sum("mass").alias("total"))
    start = materialize(seeds.join(F.broadcast(total), "kind").where("mass > 0").select("kind", "host", (F.col("mass") / F.col("total")).alias("rank")), "seeds")
    if flows.isEmpty() or start.isEmpty():
        return start
    rank = start
    for step in range(1, steps + 1):
        moved = flows.join(rank.withColumnRenamed("host", "a"), ["kind", "a"]).select("kind", F.col("b").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        rank = moved.unionByName(start.withColumn("rank", F.col("rank") * (1 - damping))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if step % every == 0:
            rank = materialize(rank, "ranks")
    return rank


def judge_urls(pages: DataFrame, rules: Sequence[Rule], threshold: float = 1e-6, steps: int = 12) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (null where a rule decides)."""
    pages = host_and_path(pages.select("page_id", "url", "html"))
    ruled = pages.withColumn("__rule", rule_of(rules))
    seeds = ruled.where("__rule is not null").groupBy("host").agg(
        F.count_if(F.col("__rule.action") == "allow").cast("double").alias("trust"), F.count_if(F.col("__rule.action") == "block").cast("double").alias("distrust")
    )
    seeds = seeds.selectExpr("stack(2, 'trust', host, trust, 'distrust', host, distrust) as (kind, host, mass)")
    seeds = materialize(seeds, "masses")
    pages_of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0))
    totals = seeds.agg(pages_of("trust").alias("__allowed"), pages_of("distrust").alias("__blocked"))
    rank = propagate(seeds, host_edges(pages), steps)
    scores = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))
    rows = ruled.select("page_id", "host", "path", "__rule")
    decided = rows.where("__rule is not null").select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.col("__rule.action").alias("verdict"), F.lit(None).cast("double").alias("trust"), F.lit(None).cast("double").alias("distrust"))
    open_ = rows.where("__rule is null").join(scores, "host", "left").crossJoin(F.broadcast(totals))  # one row
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    against, for_ = distrust * F.col("__blocked"), trust * F.col("__allowed")
    verdict = F.when((against >= threshold) & (against > for_), "block").otherwise("allow")
    return decided.unionByName(open_.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"), F.round(trust, 9).alias("trust"), F.round(distrust, 9).alias("distrust")))
