"""A crawl over pages at hand: seeds, supersteps of the frontier, records, scores and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import graph as G
from ..operators import html as H
from .shared import written


def records(pages: DataFrame, lost_json_ld: bool = False) -> DataFrame:
    """Parsed pages with entities and language, written once: all later steps read the table."""
    rows = written(H.parsed(pages.select(F.col("url").alias("page_key"), "url", "html"), "page_key", "url", "html", lost_json_ld).drop("page_key"), "records")
    whole = F.concat_ws(" ", "main_text", "title")
    return rows.withColumn("entities", T.entities(whole)).withColumn("language", T.language(F.col("main_text")))


def edges_of(rows: DataFrame) -> DataFrame:
    """from_url, pos, to_url, anchor of all links of the raw pages."""
    return rows.select(F.col("url").alias("from_url"), F.posexplode("graph_links").alias("pos", "x")).select("from_url", "pos", U.normalized(F.col("x.url")).alias("to_url"), F.col("x.anchor").alias("anchor"))


def score_records(rows: DataFrame, edges: DataFrame, queries: list[str], mode: str, goal: int) -> DataFrame:
    inbound = G.in_degree(edges)
    ready = rows.join(inbound, "url", "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))
    return S.scored(ready, S.terms(queries), mode, goal)


def crawl(pages: DataFrame, seeds: DataFrame, queries: list[str], mode: str = "leadgen", goal: int = 50, batch: int = 20):
    """Crawls the offline pages (url, html) from the seeds; returns scored pages, nodes and edges.

    Each step takes the next batch, skips what low pages lead to and adds what the batch leads to. In personal mode links
    to other domains are not followed. Of pages with one URL that with the least html counts. The graph's tables are written
    to the shared folder after each step; the crawl ends when no pending node is left that may be crawled.
    """
    once = pages.groupBy(U.normalized(F.col("url")).alias("url")).agg(F.min("html").alias("html"))
    rows = written(records(once), "pages")
    edges = written(edges_of(rows), "edges")
    scores = written(score_records(rows, edges, queries, mode, goal), "scores")
    nodes = seeds.select(U.normalized(F.col("url")).alias("url")).filter(U.valid(F.col("url"))).distinct().select("url", F.lit(0).alias("score"), F.lit(0).alias("depth"), F.lit("pending").alias("status"))
    nodes = written(nodes, "nodes")
    while True:
        todo = written(G.next_batch(nodes, batch).select("url"), "batch")  # `batch` rows at most
        if todo.isEmpty():
            break
        got = todo.join(scores.select("url", F.col("total").alias("got")), "url", "left").select("url", "got", F.lit(True).alias("taken"))
        nodes = nodes.join(F.broadcast(got), "url", "left").select(
            "url", F.coalesce("got", "score").alias("score"), "depth", F.when(F.col("taken") & F.col("got").isNotNull(), "crawled").when(F.col("taken"), "failed").otherwise(F.col("status")).alias("status")
        )
        new = G.discovered(nodes.filter("status = 'crawled'"), edges, mode == "personal").join(nodes.select("url"), "url", "left_anti")
        nodes = nodes.unionByName(new.select("url", F.lit(0).alias("score"), "depth", F.lit("pending").alias("status")))
        nodes = written(G.prune_low_value(nodes, edges), "nodes")
    crawled = scores.join(nodes.filter("status = 'crawled'").select("url", "depth"), "url").withColumnRenamed("total", "score")
    return crawled, nodes, edges.join(nodes.filter("status = 'crawled'").select(F.col("url").alias("from_url")), "from_url", "left_semi")
