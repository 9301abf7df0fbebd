"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text.

The model has one set of n-gram tables for each language. Tasks count the n-grams of trusted documents, Spark adds the
counts up and joins the orders: counts with their contexts' sums, probabilities with those of the next shorter n-grams. The
tables are stored in shards by key. A task that scores documents gathers the distinct n-grams of a chunk and joins them to
the shards one after the other, so neither the model nor the corpus needs to fit a task's memory.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, ship, slices, stored

BEGIN, END, ORDER = 0, 1, 5
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts end to end, lower-cased, digits as 0, white space as one space; ORDER - 1 BEGINs before
    each text and an END after it. And where each text's first BEGIN is, with the end of all as the last."""
    pad = chr(BEGIN) * (ORDER - 1)
    flat = [pad + " ".join(t.lower().replace("\x00", " ").replace("\x01", " ").split()) + chr(END) for t in texts]
    c = np.frombuffer("".join(flat).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return np.where((c >= 48) & (c <= 57), 48, c), np.cumsum([0, *map(len, flat)])


def finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed(lang: str, n: int, back: bool) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(f"{lang}\t{n}\t{int(back)}"))


def keys(c: np.ndarray, last: np.ndarray, n: int, lang: str, back: bool = False) -> np.ndarray:
    """Keys of the n characters that end at the positions `last`; back: of their weights of backing off."""
    h = np.zeros(len(last), np.uint64)
    for j in range(n):
        h = h * MIX[0] + (c[last - j].astype(np.uint64) + np.uint64(1)) * MIX[j]
    return finished(h ^ seed(lang, n, back)).view(np.int64)


def windows(c: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions of the characters that are predicted: all but the BEGINs."""
    real = np.ones(len(c), bool)
    for j in range(ORDER - 1):
        real[bounds[:-1] + j] = False
    return np.flatnonzero(real)


def counted(trusted: DataFrame, chunk_chars: int) -> DataFrame:
    """lang, c1 to c5, n: how often each five characters stand in the texts of a language."""
    names = [f"c{j + 1}" for j in range(ORDER)]

    def run(batches):
        def flush(held):
            for lang, texts in held.items():
                c, bounds = symbols(texts)
                last = windows(c, bounds)
                _, at, n = np.unique(keys(c, last, ORDER, ""), return_index=True, return_counts=True)
                cols = [pa.array(c[last[at] - (ORDER - 1 - j)].astype(np.int32)) for j in range(ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *cols, pa.array(n.astype(np.int64))], ["lang", *names, "n"])

        for part in slices(batches, chunk_chars):
            held: dict[str, list[str]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
            yield from flush(held)

    rows = trusted.select("lang", "t").mapInArrow(run, "lang string, " + ", ".join(f"{x} int" for x in names) + ", n bigint")
    return rows.groupBy("lang", *names).agg(F.sum("n").alias("n"))


def fit(trusted: DataFrame, shard_rows: int = 2_000_000, chunk_chars: int = 4_000_000):
    """The folder of the shards of the model of (lang, t) rows, their number, and per language how many characters it knows.

    Discounts come from the counts of counts of each language and order, as in the modified form; where those are too few
    for a discount it is half the count's step.
    """
    names = [f"c{j + 1}" for j in range(ORDER)]
    tables = {ORDER: stored(counted(trusted, chunk_chars), "ngrams")}
    for n in range(ORDER - 1, 0, -1):  # how many different characters come before
        tables[n] = stored(tables[n + 1].groupBy("lang", *names[ORDER - n :]).agg(F.count(F.lit(1)).alias("n")), f"ngrams-{n}")
    known = tables[1].groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("v"))
    sizes = {r.lang: r.v for r in known.toLocalIterator()}
    lower, out = None, []
    for n in range(1, ORDER + 1):
        t, cols = tables[n], names[ORDER - n :]
        f = t.groupBy("lang").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        d = [F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), F.when((F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0), k - (k + 1) * F.col("y") * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(k * 0.5))) for k in (1, 2, 3)]
        f = f.withColumn("y", y).select("lang", *[x.alias(f"d{k}") for k, x in zip((1, 2, 3), d, strict=True)])
        t = t.join(F.broadcast(f), "lang")  # a row for each language
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.withColumn("less", less)
        before = ["lang", *cols[:-1]]
        context = t.groupBy(before).agg(F.sum("n").alias("of"), (F.sum("less") / F.sum("n")).alias("back"))
        p = t.join(context, before)
        if n == 1:
            p = p.join(F.broadcast(known), "lang").withColumn("low", 1 / F.col("v"))  # a row for each language
        else:
            p = p.join(lower.withColumnRenamed("p", "low"), ["lang", *cols[1:]])
        p = stored(p.select("lang", *cols, ((F.col("n") - F.col("less")) / F.col("of") + F.col("back") * F.col("low")).alias("p")), f"kn-{n}")
        lower = p
        out.append(p.select("lang", F.lit(n).alias("len"), F.array(*cols).alias("chars"), F.lit(False).alias("back"), F.log("p").alias("x")))
        out.append(context.select("lang", F.lit(n - 1).alias("len"), F.array(*[F.col(c) for c in cols[:-1]]).cast("array<int>").alias("chars"), F.lit(True).alias("back"), F.log("back").alias("x")))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    rows = stored(rows, "kn-all")
    shards = max(1, -(-rows.count() // shard_rows))

    def keyed(batches):
        for batch in batches:
            lang, back = np.array(batch.column(0).to_pylist(), object), batch.column(3).to_numpy(zero_copy_only=False)
            size = batch.column(1).to_numpy()
            flat, offs = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            key = np.zeros(batch.num_rows, np.int64)
            for one in {*zip(lang.tolist(), size.tolist(), back.tolist(), strict=True)}:
                at = np.flatnonzero((lang == one[0]) & (size == one[1]) & (back == one[2]))
                key[at] = keys(flat.astype(np.int64), offs[at + 1] - 1, int(one[1]), one[0], one[2])
            yield pa.RecordBatch.from_arrays([pa.array((key.view(np.uint64) % np.uint64(shards)).astype(np.int32)), pa.array(key), batch.column(4)], ["shard", "key", "x"])

    folder = scratch(trusted.sparkSession, "kn-shards")
    rows.mapInArrow(keyed, "shard int, key bigint, x double").repartition(shards, "shard").write.partitionBy("shard").parquet(folder)
    return folder, shards, sizes


@lru_cache(maxsize=8)
def shard(folder: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and their values. Eight shards at most stay in a worker."""
    import pyarrow.dataset as ds

    from .warc import filesystem

    fs, root = filesystem(folder)
    try:
        t = ds.dataset(f"{root}/shard={number}", filesystem=fs, format="parquet").to_table(columns=["key", "x"])
    except FileNotFoundError:  # no key falls into this shard
        return np.zeros(1, np.int64), np.zeros(1)
    key, x = t["key"].to_numpy(), t["x"].to_numpy()
    order = np.argsort(key)
    return key[order], x[order]


def looked_up(key: np.ndarray, folder: str, shards: int) -> np.ndarray:
    """The value of each key, NaN where the model has none; shard by shard."""
    out = np.full(len(key), np.nan)
    where = (key.view(np.uint64) % np.uint64(shards)).astype(np.int64)
    for s in range(shards):
        at = np.flatnonzero(where == s) if shards > 1 else np.arange(len(key))
        if len(at):
            have, x = shard(folder, s)
            place = np.minimum(np.searchsorted(have, key[at]), len(have) - 1)
            out[at] = np.where(have[place] == key[at], x[place], np.nan)
    return out


def log_likelihood(texts: list[str], lang: str, folder: str, shards: int, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log probabilities of each text and how many characters it has, its END included."""
    c, bounds = symbols(texts)
    last = windows(c, bounds)
    _, first, of = np.unique(keys(c, last, ORDER, ""), return_index=True, return_inverse=True)
    at = last[first]
    wanted = [keys(c, at, n, lang) for n in range(ORDER, 0, -1)] + [keys(c, at - 1, n - 1, lang, True) for n in range(ORDER, 0, -1)]
    # all orders at once, so that each shard is read once for a chunk
    values = looked_up(np.concatenate(wanted), folder, shards).reshape(2 * ORDER, len(at))
    result, weight, settled = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at), bool)
    for k in range(ORDER):
        hit = ~settled & ~np.isnan(values[k])
        result[hit] = weight[hit] + values[k][hit]
        settled |= hit
        weight += np.where(settled, 0, np.nan_to_num(values[ORDER + k], nan=0.0))
    result[~settled] = weight[~settled] - np.log(known)
    sums = np.concatenate(([0.0], np.cumsum(result[of])))
    ends = np.searchsorted(last, bounds)
    return sums[ends[1:]] - sums[ends[:-1]], np.diff(ends)


def perplexity(docs: DataFrame, model, id_col: str, text_col: str, lang_col: str, chunk_chars: int = 4_000_000) -> DataFrame:
    """id, lang, perplexity and scored (characters, the end included) of each row; both are null where the language is null
    or unknown to the model."""
    folder, shards, sizes = model
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches):
        def flush(held):
            by: dict[str | None, list[int]] = {}
            for k, (_, lang, _) in enumerate(held):
                by.setdefault(lang, []).append(k)
            out, scored = [None] * len(held), [None] * len(held)
            for lang, at in by.items():
                if lang in sizes:
                    total, n = log_likelihood([held[k][2] for k in at], lang, folder, shards, sizes[lang])
                    for k, x, m in zip(at, np.exp(-total / n).tolist(), n.tolist(), strict=True):
                        out[k], scored[k] = x, m
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], arrow_id), pa.array([h[1] for h in held], pa.string()), pa.array(out, pa.float64()), pa.array(scored, pa.int64())], [id_col, "lang", "perplexity", "scored"])

        for part in slices(batches, chunk_chars, (2,)):
            yield flush([(i, lang, text or "") for i, lang, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(lang_col).cast("string"), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang string, perplexity double, scored bigint")


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = 0.99, spread: float = 3.0, held_back: int = 4, id_limit: int = 1_000_000,
) -> DataFrame:
    """One row per input row: id, lang, perplexity, threshold, trusted, kept.

    Trusted documents are those that labels give quality 1 and no other quality. One in held_back of them, by the hash of
    its id, is left out of the training; the threshold of a language is this quantile of their perplexities (to one part in
    10,000), so that it tells how unseen good text scores. A document is kept unless even the low end of its perplexity,
    spread / sqrt(characters) lower in logarithm as fits a short text's chance, is above the threshold.

    Documents whose language is null, or has no trusted document on both sides, have a null threshold and are kept. Null
    text counts as empty and is scored by its end alone. Null ids are not trusted; repeated rows share a verdict. Empty
    tables of labels keep all; an empty table of documents gives an empty result.
    """
    ship(docs.sparkSession)
    ids = labels.groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("q")).filter("q >= 1 AND __id IS NOT NULL").select("__id")
    ids = stored(ids, "trusted")
    few = ids.count() <= id_limit  # broadcast only below a checked count
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"), F.col(lang_col).cast("string").alias("lang"))
    side = F.broadcast(ids) if few else ids
    unseen = F.pmod(F.xxhash64("id"), F.lit(held_back)) == 0
    trusted = base.filter(~unseen & F.col("lang").isNotNull()).join(side, F.col("id") == F.col("__id"), "left_semi")
    model = fit(trusted.select("lang", "t"))
    scores = stored(perplexity(base, model, "id", "t", "lang"), "perplexities")
    marked = scores.join(side.withColumn("trusted", F.lit(True)), F.col("id") == F.col("__id"), "left").drop("__id").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    limits = marked.filter(F.col("trusted") & unseen & F.col("perplexity").isNotNull()).groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    out = marked.join(F.broadcast(limits), "lang", "left")  # a row for each language
    kept = F.log("perplexity") - spread / F.sqrt("scored") <= F.log("threshold")
    return out.select(F.col("id").alias(id_col), "lang", "perplexity", "threshold", "trusted", F.coalesce(kept, F.lit(True)).alias("kept"))


def op6_kneser_ney_quality(spark, sf_dir):
    from .common import read

    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
