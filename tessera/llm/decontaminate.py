"""Benchmark decontamination by a prefix-filtered join of word shingles.

Each item gives windows of consecutive words, each window a set of shingles. Shingles are ordered by how rare they are in
all documents. A document that contains a window contains all of its shingles, so the necessary prefix is one shingle, the
rarest: only that one is probed. A match gives the window's place in the document; places that reach over either end fall
to the positional and length bounds, and the words of the others are compared one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SQL_LOWER, ship, slices, stored

#: Bytes of words: digits, a-z and all beyond ASCII. A-Z are lower-cased, everything else parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(TABLE).split()


def shingle_hashes(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where k known words begin, and the hash of those words."""
    if len(ids) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids > 0
    full = known[: len(ids) - k + 1].copy()
    for j in range(1, k):
        full &= known[j : len(ids) - k + 1 + j]
    at = np.flatnonzero(full)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        x = ids[at + j].astype(np.uint64) * MIX[j]
        h = (h ^ (x ^ (x >> np.uint64(29)))) * MIX[(j + 1) % 5]
    return at, h ^ (h >> np.uint64(32))


class Windows:
    """The windows of a block of items, and their shingles with the windows that each stands in."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            for i in range(max(0, len(ids) - window) + 1 if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.owners = [frozenset(v) for v in found.values()]
        self.length = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.zeros((len(found), window), np.int64)
        self.by_k: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for n, ids in enumerate(found):
            self.ids[n, : len(ids)] = ids
            k = min(shingle, len(ids))
            at, h = shingle_hashes(self.ids[n, : len(ids)], k)
            parts.setdefault(k, []).append((h, np.full(len(at), n), at))
        for k, rows in parts.items():
            h, win, off = (np.concatenate(c) for c in zip(*rows, strict=True))
            keys, of = np.unique(h, return_inverse=True)
            self.by_k[k] = keys, of, win, off

    def keys(self) -> int:
        return sum(len(x[0]) for x in self.by_k.values())

    def encode(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of the documents end to end, a 0 after each; where each begins; its length."""
        get, n = self.vocab.get, np.fromiter(map(len, docs), np.int64, len(docs))
        starts = np.cumsum(n + 1) - n - 1
        ids = np.fromiter((get(w, 0) for d in docs for w in (*d, b"")), np.int64, int(n.sum()) + len(docs))
        return ids, starts, n

    def count(self, docs: list[list[bytes]]) -> np.ndarray:
        """How often each shingle of the block stands in the documents."""
        ids, _, _ = self.encode(docs)
        out, base = np.zeros(self.keys(), np.int64), 0
        for k in sorted(self.by_k):
            keys = self.by_k[k][0]
            _, h = shingle_hashes(ids, k)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            out[base : base + len(keys)] = np.bincount(at[keys[at] == h], minlength=len(keys))
            base += len(keys)
        return out

    def choose(self, counts: np.ndarray) -> None:
        """Keeps of each window the rarest shingle; ties go to the first in the window."""
        self.prefix, base = {}, 0
        for k in sorted(self.by_k):
            keys, of, win, off = self.by_k[k]
            order = np.lexsort((off, counts[base + of], win))
            first = order[np.concatenate(([True], win[order][1:] != win[order][:-1]))]
            chosen, place = np.unique(of[first], return_inverse=True)
            by = np.argsort(place, kind="stable")
            begin = np.searchsorted(place[by], np.arange(len(chosen) + 1))
            self.prefix[k] = keys[chosen], begin, win[first][by], off[first][by]
            base += len(keys)

    def find(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences: document number, first word in it, window number."""
        ids, starts, n = self.encode(docs)
        out = []
        for k, (keys, begin, win, off) in self.prefix.items():
            at, h = shingle_hashes(ids, k)
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[slot] == h
            at, slot = at[hit], slot[hit]
            many = begin[slot + 1] - begin[slot]
            pick = np.repeat(begin[slot] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            at, w = np.repeat(at, many), win[pick]
            doc = np.searchsorted(starts, at, "right") - 1
            first = at - off[pick]
            inside = (first >= starts[doc]) & (first + self.length[w] <= starts[doc] + n[doc])
            first, w, doc = first[inside], w[inside], doc[inside]
            for j in range(self.ids.shape[1]):
                ends = self.length[w] <= j
                same = ends | (ids[np.where(ends, 0, first + j)] == self.ids[w, j])
                first, w, doc = first[same], w[same], doc[same]
            out.append((doc, first - starts[doc], w))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def block_count(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The items as (i, t), and in how many blocks by hash they are dealt, each of block_bytes at most (or of one item)."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    size = F.coalesce(F.octet_length("t"), F.lit(0)) + 16
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = 1
    while n * block_bytes < total:
        n *= 2
    while n > 1:
        worst = rows.groupBy(F.pmod(F.xxhash64("i", "t"), F.lit(n)).alias("b")).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("c"))
        if not worst.filter((F.col("s") > block_bytes) & (F.col("c") > 1)).limit(1).count():
            break
        n *= 2
    return rows, n


def text_keys(texts: list[str]) -> list[pa.Array]:
    """128 bits of hash of each text, in two columns."""
    import xxhash

    both = [xxhash.xxh3_128_intdigest(t.encode("utf-8")) for t in texts]
    return [pa.array([(x >> shift & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for x in both], pa.int64()) for shift in (64, 0)]


def results(n: list[int], spans: list[list[tuple[int, int]]], owners: list[list[str]], share: int) -> list[pa.Array]:
    """n_words, n_hit, n_items, items_sha256 and contaminated from the spans (first word, length) that are hit in each text."""
    hit = []
    for found in spans:
        k = end = 0
        for first, length in sorted(found):
            k += max(0, first + length - max(first, end))
            end = max(end, first + length)
        hit.append(k)
    listed = [sorted(set(x)) for x in owners]
    return [
        pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in listed], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], pa.string()),
        pa.array([k > 0 and share * k >= m for k, m in zip(hit, n, strict=True)], pa.bool_()),
    ]


OUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
OUT_KINDS = ["bigint", "bigint", "bigint", "string", "boolean"]


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 13, shingle: int = 5, share: int = 20, block_bytes: int = 8_000_000, chunk_chars: int = 2_000_000, also: tuple[str, ...] = (), out: tuple[str, ...] = tuple(OUT),
) -> DataFrame:
    """One row per input row: id, the columns named in also, n_words, n_hit, n_items, items_sha256, contaminated; out renames
    the last five where names clash.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. A word of a document
    inside any occurrence of a window is hit; contaminated means n_hit > 0 and share * n_hit >= n_words. The items are taken
    in blocks of block_bytes, one after the other: a block's texts and the counts of its shingles are all that the driver
    and a task hold of the benchmark, however large it is, and its index is made once a task. Documents are read twice a
    block (shingle counts, then the search), in chunks of about chunk_chars, never cut. With one block nothing of them is
    shuffled; with several, what each block finds is stored by the hash of the text and joined to the rows.

    Among shingles that are equally rare in the documents the first of the window is its prefix. Null or wordless texts have
    no words and no hits; items_sha256 is then the digest of the empty string. Null or wordless items have no window; an item
    with a null id is listed as the empty string. Items repeated with one id count once. Repeated documents and null ids pass
    through. An empty table of items leaves every document clean; an empty table of documents gives an empty result. Columns
    other than those named are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    names = [id_col, *also]
    read = names if text_col in names else [*names, text_col]
    place = read.index(text_col)
    base, width = docs.select(*read), len(names)
    numbered = [f"c{k}" for k in range(width)]  # by place, as names may clash
    kinds = [f"{c} {docs.schema[x].dataType.simpleString()}" for c, x in zip(numbered, names, strict=True)]
    rows, n_blocks = block_count(items, item_col, item_text_col, block_bytes)

    def block(b: int):
        """The items of a block, and how often each of its shingles stands in the documents, sent to the tasks."""
        mine = rows if n_blocks == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b)
        texts = spark.sparkContext.broadcast([(r.i, r.t) for r in mine.toLocalIterator()])  # block_bytes at most

        def count(batches):
            win, sums = Windows(texts.value, window, shingle), None
            for part in slices(batches, chunk_chars, (0,)):
                got = win.count([words(t) for t in part.column(0).to_pylist()])
                sums = got if sums is None else sums + got
            if sums is not None and sums.any():
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["k", "n"])

        got = docs.select(text_col).mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # a row a shingle of the block at most
        return texts, spark.sparkContext.broadcast((got.column("k").to_numpy(), got.column("n").to_numpy()))

    def opened(texts, counts) -> Windows:
        found = Windows(texts.value, window, shingle)
        rare = np.zeros(found.keys(), np.int64)
        at, n = counts.value
        rare[at] = n
        found.choose(rare)
        return found

    def occurrences(win: Windows, split: list[list[bytes]]):
        """Spans and owners of the items, of each text."""
        spans, owners = [[] for _ in split], [[] for _ in split]
        doc, first, number = win.find(split)
        for d, f, w in zip(doc.tolist(), first.tolist(), number.tolist(), strict=True):
            spans[d].append((f, int(win.length[w])))
            owners[d].extend(win.owners[w])
        return spans, owners

    if n_blocks == 1:
        texts, counts = block(0)

        def search(batches):
            win = opened(texts, counts)
            for part in slices(batches, chunk_chars, (place,)):
                split = [words(t) for t in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *results([len(w) for w in split], *occurrences(win, split), share)], [*numbered, *OUT])

        found = base.mapInArrow(search, ", ".join(kinds + [f"{c} {k}" for c, k in zip(OUT, OUT_KINDS, strict=True)]))
        return found.toDF(*names, *out)

    parts = None
    for b in range(n_blocks):
        texts, counts = block(b)

        def search(batches, texts=texts, counts=counts):
            win = opened(texts, counts)
            for part in slices(batches, chunk_chars, (0,)):
                given = [t or "" for t in part.column(0).to_pylist()]
                spans, owners = occurrences(win, [words(t) for t in given])
                at = [k for k, x in enumerate(spans) if x]
                first, length = ([[x[j] for x in sorted(set(spans[k]))] for k in at] for j in (0, 1))
                cols = [pa.array(first, pa.list_(pa.int64())), pa.array(length, pa.list_(pa.int64())), pa.array([sorted(set(owners[k])) for k in at], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*text_keys([given[k] for k in at]), *cols], ["t1", "t2", "first", "length", "items"])

        hits = docs.select(text_col).mapInArrow(search, "t1 bigint, t2 bigint, first array<bigint>, length array<bigint>, items array<string>").dropDuplicates(["t1", "t2"])
        hits = stored(hits, "block-hits")
        texts.destroy()
        counts.destroy()
        parts = hits if parts is None else parts.unionByName(hits)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  # a row for each block at most
    parts = parts.groupBy("t1", "t2").agg(flat("first"), flat("length"), flat("items"))

    def counted(batches):
        for part in slices(batches, chunk_chars, (place,)):
            given = [t or "" for t in part.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array([len(words(t)) for t in given], pa.int64()), *text_keys(given)], [*numbered, "n", "t1", "t2"])

    def finish(batches):
        for batch in batches:
            first, length, owners = (batch.column(width + k).to_pylist() for k in (1, 2, 3))
            spans = [list(zip(f or (), n or (), strict=True)) for f, n in zip(first, length, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *results(batch.column(width).to_pylist(), spans, [x or [] for x in owners], share)], [*numbered, *OUT])

    all_ = base.mapInArrow(counted, ", ".join([*kinds, "n bigint", "t1 bigint", "t2 bigint"])).join(parts, ["t1", "t2"], "left")
    found = all_.select(*numbered, "n", "first", "length", "items").mapInArrow(finish, ", ".join(kinds + [f"{c} {k}" for c, k in zip(OUT, OUT_KINDS, strict=True)]))
    return found.toDF(*names, *out)


def op7_decontamination(spark, sf_dir):
    from .common import read

    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({SQL_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({SQL_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
places AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT doc_id, k, p.n, item FROM places p JOIN win ON p.t = win.t AND p.n = win.n),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
