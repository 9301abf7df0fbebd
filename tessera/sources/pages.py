"""Offline page stores, capture lists and seeds as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U

FETCH = "url string, html string, final_url string, status int, elapsed double, error string"
CAPTURE = "urlkey string, timestamp string, url string, mime string, status string, digest string, length string"


def fetched(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Rows of a landing folder; ok marks those with a status below 400 and some html."""
    rows = spark.read.schema(FETCH).format(fmt).load(path)
    return rows.withColumn("ok", F.coalesce((F.col("status") < 400) & (F.length("html") > 0), F.lit(False)))


def captures(spark: SparkSession, path: str, per_domain: int = 20) -> DataFrame:
    """URLs of a dump of capture lists in JSON lines: status 200, one for each key, per_domain of each domain by URL."""
    rows = spark.read.schema(CAPTURE).json(path).filter("status = '200'").dropDuplicates(["urlkey"])
    rank = F.row_number().over(W.partitionBy("domain").orderBy("url"))
    return rows.withColumn("domain", U.bare_domain(F.col("url"))).withColumn("rank", rank).filter(F.col("rank") <= per_domain).select("url", "domain")


def result_links(results: DataFrame, column: str = "html") -> DataFrame:
    """Valid distinct links of stored search results; redirects that hold their target as /RU=…/ are resolved."""
    href = F.explode(F.regexp_extract_all(F.col(column), F.lit(r'(?is)<a\s[^>]*href="(http[^"]*)"'), F.lit(1)))
    to = F.regexp_extract("href", "/RU=([^/]*)/", 1)
    url = F.when(to != "", F.try_url_decode(to)).otherwise(F.col("href"))
    return results.select(href.alias("href")).select(url.alias("url")).filter(U.valid(F.col("url"))).distinct()


def seeds(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """topic, region, url: the caller's table of curated seeds."""
    return spark.createDataFrame(rows, "topic string, region string, url string")


def preferences(defaults: dict, stored: dict | None) -> dict:
    """Defaults overlaid by what is stored; what is no mapping counts as nothing."""
    return {**defaults, **(stored if isinstance(stored, dict) else {})}
