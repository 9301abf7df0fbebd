"""Language identification by bit-sliced Bloom filters of character n-grams.

Training counts the n-grams of every language over all training documents and keeps for each language those that are as
usual there as in any other. They are entered in a Bloom filter whose slots are bit masks with one bit for each language:
the masks at an n-gram's slots, joined by AND, name all languages that have it. A text counts the n-grams that each language
has, takes off what the fill of that language's slice lets through by chance, and the largest count decides.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

BITS = 21  # a code point


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point itself where it is a letter, else 0."""
    at = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            at[c] = c
    return at


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts end to end, runs of all else as one 0; and where each text begins."""
    low = [t.lower() for t in texts]
    raw = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "replace"), "<u4")
    c = letters()[raw]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    # each text's first separator stays, so that texts part even if all between is no letter
    starts = np.cumsum([0, *(len(t) + 1 for t in low)])
    keep[starts[:-1]] = True
    place = np.cumsum(keep) - 1
    return c[keep], place[starts[:-1]]


def grams(c: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a size and where they begin; a separator stands at their ends at most."""
    n = len(c) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.zeros(n, np.int64)
    good = np.ones(n, bool)
    some = np.zeros(n, bool)
    for j in range(size):
        x = c[j : j + n]
        key = (key << BITS) | x
        some |= x > 0
        if 0 < j < size - 1:
            good &= x > 0
    at = np.flatnonzero(good & some)
    return key[at], at


class Alphabet:
    """The n-grams of a chunk as small numbers, where its letters are few enough for a table."""

    def __init__(self, c: np.ndarray, limit: int = 1 << 21):
        self.c, self.limit = c, limit
        self.chars = np.flatnonzero(np.bincount(c, minlength=1)) if len(c) else np.zeros(1, np.int64)
        self.small = np.zeros(0x110000, np.int64)
        self.small[self.chars] = np.arange(len(self.chars))
        self.k = len(self.chars)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of the size, each position's number among them, and the positions."""
        if self.k**size > self.limit:
            key, at = grams(self.c, size)
            uniq, inv = np.unique(key, return_inverse=True)
            return uniq, inv, at
        d = self.small[self.c]
        n = len(d) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        num, good, some = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, bool)
        for j in range(size):
            x = d[j : j + n]
            num = num * self.k + x
            full = self.c[j : j + n] > 0
            some |= full
            if 0 < j < size - 1:
                good &= full
        at = np.flatnonzero(good & some)
        num = num[at]
        there = np.flatnonzero(np.bincount(num, minlength=1)) if len(num) else np.zeros(0, np.int64)
        slot = np.zeros(self.k**size, np.int32)
        slot[there] = np.arange(len(there))
        key, rest = np.zeros(len(there), np.int64), there.copy()
        parts = []
        for _ in range(size):
            parts.append(self.chars[rest % self.k])
            rest = rest // self.k
        for x in reversed(parts):
            key = (key << BITS) | x
        return key, slot[num], at


def slots(key: np.ndarray, size: int, hashes: int, m: int) -> list[np.ndarray]:
    """The slots of each n-gram, one array for each hash."""
    x = key.astype(np.uint64) + np.uint64(size * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return [((x + np.uint64(i) * step) % np.uint64(m)).astype(np.int64) for i in range(hashes)]


class Filter:
    """Slots of bit masks, one bit for each language, in words of 64."""

    def __init__(self, languages: list[str], sizes: tuple[int, ...], hashes: int, m: int, rows):
        self.languages, self.sizes, self.hashes, self.m = languages, sizes, hashes, m
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if min(len(languages), 64) <= 8 * np.dtype(t).itemsize)
        self.masks = np.zeros(((len(languages) + 63) // 64 or 1, m), kind)
        for word, slot, mask in rows:
            self.masks[word, slot] = kind(mask & 0xFFFFFFFFFFFFFFFF)
        self.leak = np.array([float(((self.masks[i // 64] & kind(1 << i % 64)) != 0).mean()) ** hashes for i in range(len(languages))])

    def have(self, key: np.ndarray, size: int) -> np.ndarray:
        """Per mask word, the languages that have each n-gram."""
        at = slots(key, size, self.hashes, self.m)
        out = self.masks[:, at[0]]
        for s in at[1:]:
            out = out & self.masks[:, s]
        return out

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        c, starts = codes(texts)
        alphabet, n = Alphabet(c), len(texts)
        votes, total = np.zeros((len(self.languages), n)), np.zeros(n)
        for size in self.sizes:
            key, num, at = alphabet.of(size)
            masks = self.have(key, size)
            cut = np.searchsorted(at, starts)
            bounds = np.append(cut, len(at))
            total += np.diff(bounds)
            for i in range(len(self.languages)):
                one = (masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int32)
                sums = np.concatenate(([0], np.cumsum(one[num])))
                votes[i] += sums[bounds[1:]] - sums[bounds[:-1]]
        fair = np.maximum((votes - total * self.leak[:, None]) / (1 - np.minimum(self.leak, 0.999))[:, None], 0)
        lettered = np.diff(np.append(np.concatenate(([0], np.cumsum(c > 0)))[starts], (c > 0).sum())) > 0
        best = fair.argmax(0) if len(self.languages) else np.zeros(n, int)
        all_votes = fair.sum(0) if len(self.languages) else np.zeros(n)
        score = np.where(lettered & (all_votes > 0), fair[best, np.arange(n)] / np.maximum(all_votes, 1e-12), 0.0) if len(self.languages) else np.zeros(n)
        return [self.languages[b] if ok and len(self.languages) else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.clip(score, 0, 1)


def fit(train: DataFrame, text_col: str, lang_col: str, sizes: tuple[int, ...] = (1, 2, 3), as_usual: float = 0.5, hashes: int = 3, m: int | None = None, chunk_chars: int = 1_000_000) -> Filter:
    """The filter of all rows of train with a text and a language.

    Tasks count distinct n-grams by language and chunk; Spark sums the counts. A language has an n-gram if its share of the
    language's n-grams of that size is at least as_usual times the largest share in any language. Only the slots, m at most
    for each 64 languages, come to the driver. Unless given, m is a power of two with 16 slots at least for each n-gram of
    the language that has most, 2^20 at least, so that a language's leak stays below 0.6 % at every size.
    """
    import pyarrow as pa

    def count(batches):
        def counted(held):
            for lang, texts in held.items():
                alphabet = Alphabet(codes(texts)[0])
                for g in sizes:
                    key, num, _ = alphabet.of(g)
                    n = np.bincount(num, minlength=len(key)) if len(key) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), g, np.int32)), pa.array(key, pa.int64()), pa.array(n.astype(np.int64))], ["lang", "g", "key", "n"])

        for part in slices(batches, chunk_chars):
            held: dict[str, list[str]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
            yield from counted(held)

    ship(train.sparkSession)
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t")).filter("lang is not null and t is not null")
    languages = sorted(r.lang for r in rows.select("lang").distinct().toLocalIterator())
    number = {x: i for i, x in enumerate(languages)}
    if not languages:
        return Filter([], sizes, hashes, m or 1, [])
    counts = rows.mapInArrow(count, "lang string, g int, key bigint, n bigint").groupBy("lang", "g", "key").agg(F.sum("n").alias("n"))
    from .common import stored

    counts = stored(counts, "ngram-counts")
    totals = counts.groupBy("lang", "g").agg(F.sum("n").alias("of"))
    share = counts.join(F.broadcast(totals), ["lang", "g"]).withColumn("p", F.col("n") / F.col("of"))  # a row for each language and size
    top = share.groupBy("g", "key").agg(F.max("p").alias("most"), F.collect_list(F.struct("lang", "p")).alias("all"))  # a row of a list for each language at most
    kept = top.select("g", "key", F.explode(F.filter("all", lambda x: x["p"] >= as_usual * F.col("most"))).alias("x")).select("g", "key", F.col("x.lang").alias("lang"))
    if m is None:
        kept = stored(kept, "ngrams-kept")
        largest = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
        m = max(1 << 20, 1 << (16 * largest - 1).bit_length())

    def enter(batches):
        for batch in batches:
            bit = np.fromiter((number[x] for x in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            g, key = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for size in np.unique(g):
                of = g == size
                for s in slots(key[of], int(size), hashes, m):
                    mask = (np.uint64(1) << (bit[of] % 64).astype(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bit[of] // 64), pa.array(s), pa.array(mask)], ["word", "slot", "mask"])

    set_slots = kept.select("lang", "g", "key").mapInArrow(enter, "word bigint, slot bigint, mask bigint").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    return Filter(languages, sizes, hashes, m, set_slots.toLocalIterator())


def identify(docs: DataFrame, filter_: Filter, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1_000_000, also: tuple[str, ...] = (), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """One row per input row: id, the columns named in also, lang_pred, score; out renames the last two where names clash.

    lang_pred is `und` with score 0 where the text is null or has no letter, and with any letter the language with most
    votes, the first by name among equals; score is its share of all votes. Whole texts are read, in chunks of about
    chunk_chars, never cut, without a shuffle. Null ids and repeated rows pass through; an empty table gives an empty result.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(filter_)  # m slots for each 64 languages, of a byte for up to eight
    names = [id_col, *also]
    out_names = [f"c{k}" for k in range(len(names) + 2)]  # by place, as names may clash
    read = names if text_col in names else [*names, text_col]
    place = read.index(text_col)

    def run(batches):
        for part in slices(batches, chunk_chars, (place,)):
            preds, scores = model.value.decide([t or "" for t in part.column(place).to_pylist()])
            cols = [part.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], out_names)

    kinds = [docs.schema[n].dataType.simpleString() for n in names] + ["string", "double"]
    found = docs.select(*read).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(out_names, kinds, strict=True)))
    return found.toDF(*names, *out)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op5_language_id(spark, sf_dir):
    from .common import read

    docs = read(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()), "text", "lang")
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
