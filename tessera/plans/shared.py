"""Tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session gets one of its own, and any other is an
    error: executors elsewhere would not see a folder of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("tessera.shared.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    at = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
