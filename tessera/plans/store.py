"""Jobs, pages, edges and expansions as partitioned tables; current states, reports and file outputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions import text as T

SCHEMAS = {
    "jobs": "id string, mode string, query string, status string, profile string, at timestamp, error string",
    "pages": "job_id string, url string, score int, depth int, title string, headings array<string>, main_text string, word_count int, language string, metadata map<string,string>, schema_org array<string>, "
    "entities struct<emails:array<string>,phones:array<string>,wechat:array<string>,line_ids:array<string>,locations:array<string>,organizations:array<string>>, crawled_at timestamp",
    "edges": "job_id string, from_url string, to_url string, anchor string, weight double",
    "query_expansions": "job_id string, original string, expanded string, pos int",
    "job_events": "job_id string, event string, at timestamp, stats map<string,bigint>",
}
MODES, PROFILES = ("personal", "research", "leadgen"), ("light", "medium", "heavy")


class Store:
    """Append-only tables below one folder; states are rows, and the last one counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        writer = rows.write.mode("append")
        (writer.partitionBy("job_id") if name in ("pages", "edges") else writer).parquet(f"{self.root}/{name}")

    def set_job(self, id_: str, mode: str, query: str, status: str, profile: str = "medium", error: str | None = None) -> None:
        if mode not in MODES or profile not in PROFILES:
            raise ValueError(f"mode is one of {MODES}, profile one of {PROFILES}")
        row = self.spark.createDataFrame([(id_, mode, query, status, profile, error)], "id string, mode string, query string, status string, profile string, error string")
        self.append("jobs", row.withColumn("at", F.current_timestamp()).select("id", "mode", "query", "status", "profile", "at", "error"))

    def add_pages(self, job_id: str, pages: DataFrame) -> None:
        """Pages of a job, one for each URL; those that the job has already are left out."""
        have = self.table("pages").filter(F.col("job_id") == job_id).select("url")
        self.append("pages", pages.dropDuplicates(["url"]).join(have, "url", "left_anti").withColumn("job_id", F.lit(job_id)))

    def jobs(self) -> DataFrame:
        return current_jobs(self.table("jobs")).join(self.table("pages").groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("page_count")), "id", "left").orderBy(F.desc("created_at"))

    def job(self, id_: str) -> dict | None:
        """The job's current row; null if there is none."""
        row = current_jobs(self.table("jobs").filter(F.col("id") == id_)).first()
        return None if row is None else row.asDict()

    def pages(self, job_id: str, min_score: int = 0, limit: int = 500) -> DataFrame:
        if not (0 <= min_score <= 100 and 1 <= limit <= 1000):
            raise ValueError("min_score is 0 to 100, limit 1 to 1000")
        return top_pages(self.table("pages").filter(F.col("job_id") == job_id), min_score, limit)

    def page(self, job_id: str, url: str) -> DataFrame:
        return self.table("pages").filter((F.col("job_id") == job_id) & (F.col("url") == url))

    def views(self) -> None:
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(name)


def current_jobs(rows: DataFrame) -> DataFrame:
    """Each job's last state; created_at is its first, finished_at that of an ending state."""
    last = F.max_by(F.struct("mode", "query", "status", "profile", "error", "at"), "at").alias("x")
    j = rows.groupBy("id").agg(last, F.min("at").alias("created_at"))
    done = F.col("x.status").isin("DONE", "FAILED", "CANCELLED")
    return j.select("id", "x.mode", "x.query", "x.status", "x.profile", "x.error", "created_at", F.when(done, F.col("x.at")).alias("finished_at"))


def job_stats(jobs: DataFrame) -> DataFrame:
    """One row over jobs with a status and a page_count."""
    return jobs.agg(F.count(F.lit(1)).alias("total_jobs"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("DONE", "RUNNING", "FAILED")], F.coalesce(F.sum("page_count"), F.lit(0)).alias("total_pages"))


def top_pages(pages: DataFrame, min_score: int, limit: int) -> DataFrame:
    return pages.filter(F.col("score") >= min_score).orderBy(F.desc("score"), "url").limit(limit)


def leads(pages: DataFrame, goal: int = 50) -> DataFrame:
    """Pages of a score that the goal asks for and with an e-mail, phone or WeChat contact, best first."""
    e = F.col("entities")
    some = pages.filter((F.col("score") >= S.goal_limits(goal)[0]) & T.has_contact(e))
    return some.select("url", "score", "title", *[F.array_join(e[c], "; ").alias(c) for c in ("emails", "phones", "wechat", "line_ids", "organizations", "locations")], "language")


def banded(pages: DataFrame) -> DataFrame:
    return pages.withColumn("band", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 30, "medium").otherwise("low"))


def progress(events: DataFrame, key: str, kind: str) -> DataFrame:
    """Events by job and kind, pivoted by the caller's list of kinds."""
    return events.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))


def write_outputs(out: str, pages: DataFrame, graph: tuple[DataFrame, DataFrame, DataFrame], meta: dict, goal: int = 50, cap: int = 10_000) -> None:
    """results, raw_pages, graph, leads and meta below a folder, by Spark's writers. The cap is the report's."""
    best = pages.orderBy(F.desc("score"), "url").limit(cap)
    best.write.mode("overwrite").json(f"{out}/results")
    pages.write.mode("overwrite").json(f"{out}/raw_pages")
    for name, part in zip(("nodes", "edges", "stats"), graph, strict=True):
        part.write.mode("overwrite").json(f"{out}/graph/{name}")
    leads(pages, goal).orderBy(F.desc("score"), "url").write.mode("overwrite").option("header", True).csv(f"{out}/leads")
    pages.sparkSession.createDataFrame([(json.dumps(meta, ensure_ascii=False, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{out}/meta")


def latest_per_key(rows: DataFrame, key: str, at: str) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))).filter("__r = 1").drop("__r")
