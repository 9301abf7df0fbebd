"""Where a crawl begins: manual seeds, stored search results, curated seeds and captures of known domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import urls as U
from ..operators import graph as G
from .shared import written

#: URLs of a domain that a seed list may hold, by mode.
PER_DOMAIN = {"personal": 8, "research": 8, "leadgen": 5}


def seeds(manual: DataFrame, searches: list[DataFrame], curated: DataFrame, captures: DataFrame, mode: str, enough: int = 10, domains: int = 8, most: int = K.MAX_SEEDS) -> DataFrame:
    """url of each seed, `most` at most (the feature's limit), by URL.

    All tables have a column url; captures has domain too. Manual seeds count if they are valid. The first search always
    counts, each later one only while there are fewer than `enough` URLs. Curated seeds follow, then the captures of the
    first `domains` domains found so far, by name. What is left is valid, distinct and capped for each domain by mode.
    """
    found = written(manual.select(F.trim("url").alias("url")).filter(U.valid(F.col("url"))).distinct(), "seeds")
    for k, results in enumerate(searches):
        if k and found.limit(enough).count() >= enough:
            break
        found = written(found.union(results.select("url")).distinct(), "seeds")
    found = written(found.union(curated.select("url")).distinct(), "seeds")
    known = found.select(U.bare_domain(F.col("url")).alias("domain")).filter("domain <> ''").distinct().orderBy("domain").limit(domains)
    found = found.union(captures.join(F.broadcast(known), "domain", "left_semi").select("url"))  # `domains` rows at most
    return G.domain_cap(found, PER_DOMAIN[mode]).orderBy("url").limit(most).select("url")


def running(pages: DataFrame, top: int = 8) -> tuple[DataFrame, DataFrame]:
    """Of a job's pages so far the distinct e-mails and WeChat names by job, and the `top` pages of each job, best first.

    The union is kept as rows, one for each entity, so no job's set has to fit a row.
    """
    parts = [pages.select("job_id", F.lit(kind).alias("kind"), F.explode(F.col("entities")[kind]).alias("entity")) for kind in ("emails", "wechat")]
    union = parts[0].unionByName(parts[1]).distinct()
    rank = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("score"), "url"))
    return union, pages.select("job_id", "url", "score", "title").withColumn("rank", rank).filter(F.col("rank") <= top)
