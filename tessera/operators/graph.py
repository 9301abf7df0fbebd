"""The crawl graph: edges, degrees, frontier, pruning, breadth-first depth, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import urls as U


def in_degree(edges: DataFrame) -> DataFrame:
    """url, inbound: edges into each target, repeated ones and loops counted."""
    return edges.groupBy(F.col("to_url").alias("url")).agg(F.count(F.lit(1)).alias("inbound"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_url").alias("url")).union(edges.select(F.col("to_url"))).distinct()


def capped(edges: DataFrame, cap: int = K.EDGES_PER_PAGE) -> DataFrame:
    """The first edges of each page."""
    return edges.filter(F.col("pos") < cap)


def discovered(nodes: DataFrame, edges: DataFrame, same_domain_only: bool = False) -> DataFrame:
    """url, depth of targets that are no nodes yet: one below the shallowest page that links to them."""
    e = edges.join(nodes.select(F.col("url").alias("from_url"), "depth"), "from_url")
    if same_domain_only:
        e = e.filter(U.domain(F.col("from_url")) == U.domain(F.col("to_url")))
    new = e.groupBy(F.col("to_url").alias("url")).agg((F.min("depth") + 1).alias("depth"))
    return new.join(nodes.select("url"), "url", "left_anti")


def prune_low_value(nodes: DataFrame, edges: DataFrame, low: int = K.LOW_SCORE) -> DataFrame:
    """nodes, where pending targets of crawled pages below the score become skipped."""
    weak = nodes.filter((F.col("status") == "crawled") & (F.col("score") < low)).select(F.col("url").alias("from_url"))
    hit = edges.join(weak, "from_url", "left_semi").select(F.col("to_url").alias("url")).distinct().withColumn("hit", F.lit(True))
    out = nodes.join(hit, "url", "left")
    return out.withColumn("status", F.when((F.col("status") == "pending") & F.col("hit"), "skipped").otherwise(F.col("status"))).drop("hit")


def next_batch(nodes: DataFrame, k: int, max_depth: int = K.MAX_DEPTH, per_domain: int = K.MAX_PER_DOMAIN) -> DataFrame:
    """The k pending nodes to crawl next: high score, low depth, then url; within the depth and what is left of each domain.

    Nodes that can't be crawled are left out before the k are taken. Only nodes that could be among the first k of their
    domain are ranked: a window group holds per_domain rows at most that matter, which Spark's group limit keeps early.
    """
    domain = U.domain(F.col("url"))
    used = nodes.filter("status = 'crawled'").groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("used"))
    rank = F.row_number().over(W.partitionBy("domain").orderBy(F.desc("score"), "depth", "url"))
    pending = nodes.filter((F.col("status") == "pending") & (F.col("depth") <= max_depth)).withColumn("domain", domain).withColumn("rank", rank).filter(F.col("rank") <= per_domain)
    left = pending.join(used, "domain", "left").filter(F.col("rank") <= per_domain - F.coalesce("used", F.lit(0)))
    return left.orderBy(F.desc("score"), "depth", "url").limit(k).select("url", "score", "depth")


def domain_cap(urls: DataFrame, cap: int, column: str = "url") -> DataFrame:
    """Valid distinct URLs, the first `cap` of each domain by URL."""
    rank = F.row_number().over(W.partitionBy("domain").orderBy(column))
    return urls.select(column).filter(U.valid(F.col(column))).distinct().withColumn("domain", U.domain(F.col(column))).withColumn("rank", rank).filter(F.col("rank") <= cap).drop("rank")


def bfs_depth(seeds: DataFrame, edges: DataFrame, max_depth: int = K.MAX_DEPTH) -> DataFrame:
    """url, depth: fewest links from a seed, as far as max_depth. Each level is a join, written to the shared folder."""
    from ..plans.shared import written

    links = written(edges.select("from_url", "to_url").distinct(), "bfs-links")
    found = written(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "bfs")
    front = found
    for d in range(1, max_depth + 1):
        front = written(links.join(front.select(F.col("url").alias("from_url")), "from_url", "left_semi").select(F.col("to_url").alias("url")).distinct().join(found, "url", "left_anti").withColumn("depth", F.lit(d)), "bfs")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and nodes by status."""
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("crawled", "pending", "failed", "skipped")]
    return nodes.agg(F.count(F.lit(1)).alias("total_nodes"), *by).crossJoin(edges.agg(F.count(F.lit(1)).alias("total_edges")))


def export(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = nodes.select(F.col("url").alias("id"), "score", "depth", "status", U.domain(F.col("url")).alias("domain"))
    e = edges.select(F.col("from_url").alias("from"), F.col("to_url").alias("to"), F.col("anchor").alias("label"))
    return n, e, stats(nodes, edges)


def top_pages(nodes: DataFrame, n: int = 100) -> DataFrame:
    return nodes.filter("status = 'crawled'").orderBy(F.desc("score"), "url").limit(n)
