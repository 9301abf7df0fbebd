"""What the operators share: text normalisation, the shared folder and shipping of the package."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: Lower-cases A-Z and nothing else, in SQL; null is empty.
SQL_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as set in spark.checkpoint.dir. Where that is unset a local session gets
    one of its own, and any other is an error: executors elsewhere would not see a folder of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("tessera.shared.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written to a table in the shared folder and read back: cuts lineage, survives lost executors."""
    at = scratch(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def give_back() -> None:
    """Hands memory that is free back to the system: workers live on between tasks, and share the executor's limit."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches, limit: int, texts: tuple[int, ...] = (1,), row_chars: int = 0):
    """Slices of Arrow batches whose texts, in the columns of these numbers, have about limit bytes at most; a row is never cut.

    Each row counts row_chars more. What Arrow holds for the slices before is given back, so a task's memory is bounded by
    one batch and what is made of one slice (or of the longest single text).
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        cost = np.full(batch.num_rows, row_chars, np.int64)
        for c in texts:
            cost += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
        cost = np.cumsum(cost)
        lo = 0
        while lo < batch.num_rows:
            before = int(cost[lo - 1]) if lo else 0
            hi = min(max(lo + 1, int(np.searchsorted(cost, before + limit, "right"))), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi
        give_back()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that don't have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_pkg.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    sc.addPyFile(at)
    sc._tessera_shipped = True
