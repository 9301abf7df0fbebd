"""Exact dedup: group by 128-bit content hash, keep one stable id, compare bytes inside groups."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, stored


def digested(docs: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """id, h1 and h2 (128 bits of hash of the normalised text), sha (its SHA-256), and with with_text the text t itself.

    Only A-Z are lower-cased, which bytes do in one pass; a JVM expression that leaves other letters alone takes ten times
    as long.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(kind)

    def run(batches):
        import xxhash

        for part in slices(batches, 4_000_000):
            texts = [(t or b"").lower() for t in part.column(1).cast(pa.binary()).to_pylist()]
            both = [xxhash.xxh3_128_intdigest(t) for t in texts]
            halves = [pa.array([(x >> shift & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for x in both], pa.int64()) for shift in (64, 0)]
            cols = [part.column(0).cast(arrow_id), *halves, pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary())] if with_text else cols, ["id", "h1", "h2", "sha", "t"][: 4 + with_text])

    schema = f"id {kind.simpleString()}, h1 bigint, h2 bigint, sha binary" + ", t binary" * with_text
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", key_limit: int = 200_000) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are identical after lower-casing A-Z. Rows are grouped by the 128-bit hash first, so a
    text that stands alone never crosses a shuffle. In groups of two or more the bytes themselves are the grouping key, so
    texts that share a hash are told apart; partial aggregation leaves one row of a text per map task, so a group of any
    size crosses the shuffle as a few rows. What is joined back to the rows is digests only: below key_limit groups it is
    broadcast, beyond it the join shuffles and a hot digest is split by AQE's skew join.

    keep: "smallest" or "largest" id of the group stays. Null text counts as empty. Rows with a null id are counted in
    group_size; a group with no id at all has keep_id null and its rows are kept. Rows repeated with the same id are
    the same document: each of them gets the same verdict. An empty table gives an empty result. Other columns, whatever
    their names, are not read.
    """
    ship(docs.sparkSession)
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = stored(digested(docs, id_col, text_col, False), "digests")
    several = stored(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h1", "h2"), "shared-hashes")
    few = several.count() <= key_limit  # broadcast only below a checked count
    texts = digested(docs, id_col, text_col, True).join(F.broadcast(several) if few else several, ["h1", "h2"], "left_semi")
    groups = texts.groupBy("h1", "h2", "sha", "t").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).drop("t")
    groups = stored(groups.withColumn("grouped", F.lit(True)), "equal-texts")
    out = rows.join(F.broadcast(groups) if few else groups, ["h1", "h2", "sha"], "left")
    keep_id = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("id") == keep_id, keep_id.isNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op4_exact_dedup(spark, sf_dir):
    from .common import read

    return exact_dedup(read(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
