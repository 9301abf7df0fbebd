"""The corpus pipeline: language ID, exact dedup, near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of documents. Language ID and decontamination judge row by row. The two dedup stages judge by doc_id and text together, so
texts that share a doc_id are told apart, and rows without a doc_id are judged like any other (they count as the largest).
Null and empty texts are one group of equal texts; rows repeated with one id and text leave one of them, that with the
smallest hash of all its columns. Empty tables give empty results, and columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, decontaminate, exact_dedup, language_id, minhash
from tessera.llm.common import read, stored

#: Broadcast so many keys of rejected rows at most; beyond that the anti-join shuffles.
KEY_LIMIT = 500_000


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, made longer until they clash with no column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def broadcast_if_few(keys: DataFrame) -> DataFrame:
    """Stored keys, broadcast below a checked count."""
    keys = stored(keys, "keys")
    return F.broadcast(keys) if keys.count() <= KEY_LIMIT else keys


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with 64 bits of hash of doc_id and text in a column of its own, and that column's name."""
    (key,) = fresh(docs, "__key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def survivors(docs: DataFrame, key: str, verdicts: DataFrame) -> DataFrame:
    """docs without their key, less those that verdicts (key, stays; one row for each of docs) reject, and one only of the
    rows that share a key."""
    names = [c for c in docs.columns if c != key]
    hashed = [c for c, kind in docs.dtypes if c != key and "map<" not in kind]
    per = stored(verdicts.groupBy("key").agg(F.min("stays").alias("stays"), F.count(F.lit(1)).alias("n")).filter("NOT stays OR n > 1"), "verdicts")
    gone, again = (broadcast_if_few(per.filter(which).select(F.col("key").alias(key))) for which in ("NOT stays", "stays"))
    single = docs.join(again, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*names), F.xxhash64(*hashed)).alias("x"))
    return docs.join(gone, key, "left_anti").join(again, key, "left_anti").select(names).unionAll(single.select(*[F.col("x").getField(c).alias(c) for c in names]))


def language(spark, docs, sf_dir):
    """Drops documents in no language: those without a letter. The model learns from these documents."""
    model = language_id.fit(docs.filter(~language_id.held_out()), "text", "lang")
    out = fresh(docs, "__lang_pred", "__score")
    found = language_id.identify(docs, model, also=tuple(c for c in docs.columns if c != "doc_id"), out=tuple(out))
    return found.filter(F.col(out[0]) != "und").select(docs.columns)


def exact(spark, docs, sf_dir):
    """Of equal texts the row with the largest doc_id stays."""
    rows, key = keyed(docs)
    named = rows.select(F.struct(F.col("doc_id").alias("d"), F.col(key).alias("k")).alias("id"), "text")
    found = exact_dedup.exact_dedup(named, "id", "text", keep="largest")
    return survivors(rows, key, found.select(F.col("id.k").alias("key"), F.col("kept").alias("stays")))


def near(spark, docs, sf_dir):
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest doc_id stays."""
    rows, key = keyed(docs)
    found = stored(minhash.near_dedup(rows, key, "text").select(F.col(key).alias("key"), "component_id"), "components")
    members = found.distinct()
    groups = members.groupBy("component_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("component_id")
    members = stored(members.join(groups, "component_id", "left_semi"), "members")
    ids = rows.join(broadcast_if_few(members.select(F.col("key").alias(key))), key, "left_semi").select(F.col(key).alias("key"), "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    best = members.join(ids, "key").groupBy("component_id").agg(F.min(order).alias("best"))
    losers = members.join(best, "component_id").filter(F.col("best.key") != F.col("key")).select("key", F.lit(False).alias("stays"))
    return survivors(rows, key, found.join(losers, "key", "left").select("key", F.coalesce("stays", F.lit(True)).alias("stays")))


def benchmark(spark, docs, sf_dir):
    """Drops documents that passages of benchmark contaminate."""
    out = fresh(docs, *(f"__{c}" for c in decontaminate.OUT))
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), also=tuple(c for c in docs.columns if c != "doc_id"), out=tuple(out))
    return found.filter(~F.col(out[-1])).select(docs.columns)


def tokens(spark, docs, sf_dir):
    """Token ids of every text, with digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    return byte_bpe.encode_docs(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, chunk_chars=2_000_000)


STAGES = [("language_id", language), ("exact_dedup", exact), ("minhash_dedup", near), ("decontamination", benchmark), ("byte_bpe", tokens)]

#: SQL can't express the stages of language ID, near-dedup and BPE; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over all documents; each stage is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
