"""Landed pages as a stream: the batch's record and score steps without state, and the seen-set within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import html as H

LANDED = "url string, html string, landed_at timestamp"


def landed(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unseen(pages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each normal URL once within the watermark."""
    return pages.withColumn("url", U.normalized(F.col("url"))).withWatermark("landed_at", delay).dropDuplicatesWithinWatermark(["url"])


def extracted(pages: DataFrame) -> DataFrame:
    """Article text, title, entities and language by built-ins."""
    rows = pages.select("url", "landed_at", H.title(F.col("html")).alias("title"), H.article_text(F.col("html")).alias("main_text"))
    return rows.withColumn("word_count", T.word_count(F.col("main_text"))).withColumn("entities", T.entities(F.concat_ws(" ", "main_text", "title"))).withColumn("language", T.language(F.col("main_text")))


def progress(events: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) by window and type."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def write(df: DataFrame, out: str, checkpoint: str):
    """Appends to a folder of Parquet, exactly once for each batch."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
