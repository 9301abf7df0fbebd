"""MinHash near-dedup: universal hash minima, banding, signature and full-set verification, connected components.

Documents with the same shingle set are one node. Each node has 256 hash minima; bands of four or five of the first 128 send
it to buckets. No bucket is spelled out in pairs. First each node meets the leaders of its buckets, the nodes that meet most
others, and is verified against the one whose signature is nearest. Then, of each bucket whose nodes are still in several
components, the nodes outside its main component meet the others, in salted blocks, and only pairs of different components
with near signatures leave the join, in the first band that they share; for these nodes signatures of 2048 minima are made. So every pair
that the bands bring together is either verified on full sets or already connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SQL_LOWER, UPPER, scratch, ship, slices, stored

HASHES, BANDED = 256, 128  # minima in a signature, and those of them that make bands
LOW = 0x5555555555555555
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit shingle hashes of each text end to end, sorted within a text; bounds of the texts."""
    import xxhash

    split = [(t or "").encode("utf-8").translate(ASCII_LOWER).split() for t in texts]  # parts at space and 0x09 to 0x0D
    n = np.fromiter(map(len, split), np.int64, len(split))
    coded = pa.array([w for s in split for w in s], pa.large_binary()).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    starts = np.cumsum(n) - n
    m = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    owner = np.repeat(np.arange(len(n)), m)
    at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + starts[owner]
    left = (starts + n)[owner] - at
    s = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(k):
        there = left > j
        s[there] = mixed(s[there] * np.uint64(3) + h[at[there] + j])
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(len(n) + 1))


def minima(s: np.ndarray, bounds: np.ndarray, hashes: int, seed: int = 20240607, block: int = 1 << 15) -> np.ndarray:
    """Universal hash minima, a row for each non-empty set, a column for each hash."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, hashes, dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(full), hashes), np.uint64)
    lo = 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(bounds[full], bounds[full[lo]] + block)))
        begin, end = bounds[full[lo]], bounds[full[hi - 1] + 1]
        x, starts = s[begin:end], bounds[full[lo:hi]] - begin
        for i in range(hashes):
            out[lo:hi, i] = np.minimum.reduceat(x * a[i] + b[i], starts)
        lo = hi
    return out


def two_bits(low: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, 32 minima to an integer."""
    two = (mixed(low) >> np.uint64(62)).reshape(len(low), low.shape[1] // 32, 32)
    return (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(2, dtype=np.uint64)


def lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(signed(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64()))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketched(docs: DataFrame, id_col: str, text_col: str, k: int, per_band: int, chunk_chars: int) -> DataFrame:
    """id, n (size of the set), f1 and f2 (its fingerprint), sig (two bits of each minimum), bands."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    arrow_id, n_bands = to_arrow_type(kind), BANDED // per_band

    def run(batches):
        for part in slices(batches, chunk_chars, row_chars=8 * HASHES):
            s, bounds = shingle_sets(part.column(1).to_pylist(), k)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            sums = np.zeros((2, len(n)), np.uint64)
            if len(full):
                for i, y in enumerate((mixed(s ^ np.uint64(0x51)), mixed(s * np.uint64(5) + np.uint64(0xA7)))):
                    sums[i, full] = mixed(np.add.reduceat(y, bounds[full]) + n[full].astype(np.uint64))
            low = minima(s, bounds, HASHES)
            sig = np.zeros((len(n), HASHES // 32), np.uint64)
            sig[full] = two_bits(low)
            bands = np.zeros((len(n), n_bands), np.uint64)
            rows = low[:, : n_bands * per_band].reshape(len(full), n_bands, per_band)
            value = np.tile(np.arange(n_bands, dtype=np.uint64), (len(full), 1))
            for j in range(per_band):
                value = mixed(value * np.uint64(0x100000001B3) + rows[:, :, j])
            bands[full] = value
            yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow_id), pa.array(n), signed(sums[0]), signed(sums[1]), lists(sig), lists(bands)], ["id", "n", "f1", "f2", "sig", "bands"])

    schema = f"id {kind.simpleString()}, n bigint, f1 bigint, f2 bigint, sig array<bigint>, bands array<bigint>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def likeness(a: str, b: str):
    """Jaccard similarity as two bits of each minimum tell it; chance matches are taken off."""
    apart = F.lit(0)
    for i in range(HASHES // 32):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW)))
    return 1 - apart / F.lit(HASHES * 0.75)


def finely_alike(a: str, b: str, hashes: int):
    """The same of longer signatures, by a fold."""
    apart = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1)).bitwiseAND(F.lit(LOW))))
    return 1 - F.aggregate(apart, F.lit(0), lambda s, x: s + x) / F.lit(hashes * 0.75)


def deviation(similarity: float, hashes: int) -> float:
    """Standard deviation of the estimate by two bits of so many minima, at this similarity."""
    apart = 0.75 * (1 - similarity)
    return (hashes * apart * (1 - apart)) ** 0.5 / (0.75 * hashes)


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, id_limit: int) -> DataFrame:
    """id and text t of the documents with these ids, once each. ids are broadcast only below a checked count."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    few = ids.count() <= id_limit
    return texts.join(F.broadcast(ids) if few else ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"])


def fine_signatures(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int, hashes: int, id_limit: int) -> DataFrame:
    """id and fine, a signature of so many minima, of the documents with these ids."""

    def run(batches):
        for part in slices(batches, 1_000_000, row_chars=8 * hashes):
            s, bounds = shingle_sets(part.column(1).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([part.column(0), lists(two_bits(minima(s, bounds, hashes, 77)))], ["id", "fine"])

    kind = docs.schema[id_col].dataType.simpleString()
    return stored(texts_of(docs, ids, id_col, text_col, id_limit).mapInArrow(run, f"id {kind}, fine array<bigint>"), "fine")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, id_limit: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets have den * intersection >= num * union."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    texts = texts_of(docs, ids, id_col, text_col, id_limit)
    at = scratch(docs.sparkSession, "pair-texts")
    texts.write.parquet(at)
    texts = docs.sparkSession.read.schema(texts.schema).parquet(at)
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")).hint("merge"), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")).hint("merge"), "b")

    def run(batches):
        for part in slices(batches, 1_000_000, (2, 3)):
            ta, tb = part.column(2).to_pylist(), part.column(3).to_pylist()
            s, bounds = shingle_sets([*ta, *tb], k)
            m, keep = len(ta), np.zeros(len(ta), bool)
            for i in range(m):
                x, y = s[bounds[i] : bounds[i + 1]], s[bounds[m + i] : bounds[m + i + 1]]
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = inter > 0 and den * inter >= num * (len(x) + len(y) - inter)
            yield pa.RecordBatch.from_arrays([pc.filter(part.column(c), pa.array(keep)) for c in (0, 1)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, comp) of every node of an edge: the smallest id that can be reached. Alternates large-star and small-star.

    Each round is written to the shared folder. Minima are aggregated before they are shuffled and hot nodes are split by
    AQE's skew join, so a node with any number of edges is no single task's burden. Rounds grow with the logarithm of the
    longest chain; should most_rounds not settle it, an error is raised and nothing is returned.
    """
    kind = edges.schema["a"].dataType
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = stored(small.filter("u <> v").distinct(), "small-star")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    out = e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("id"), "comp")
    roots = out.select(F.col("comp").alias("id")).distinct().withColumn("comp", F.col("id"))
    return out.unionByName(roots).select(F.col("id").cast(kind), F.col("comp").cast(kind))


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100,
    per_band: int = 4, deviations: float = 5.0, fine_hashes: int = 2048, block: int = 2000, chunk_chars: int = 2_000_000, id_limit: int = 1_000_000,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    A text's set is its distinct shingles of `shingle` words, lower-cased in A-Z; with fewer words the whole sequence is the
    one shingle. Texts are linked if den * intersection >= num * union of their full sets. A pair is dropped unverified where
    the estimate of its signatures lies further below that than `deviations` standard deviations at the threshold, which
    happens to a pair right at it about once in a million (once for each of the two signatures). Bands have per_band minima
    each: with 4 a pair at 0.8 is missed once in 20 million, with 5 a pair at 0.85 once in two million. component_id is the
    smallest id that links reach, and the document of that id is kept.

    Null, empty and wordless texts have no shingle, are linked with nothing and kept. Rows with a null id take no part:
    component_id is null, and they are kept. Rows repeated with one id share a verdict. An empty table gives an empty
    result. Columns other than the two are not read. Nothing grows on the driver; broadcasts are below id_limit ids.
    """
    spark = docs.sparkSession
    ship(spark)
    least = num / den - deviations * deviation(num / den, HASHES)
    rows = stored(sketched(docs, id_col, text_col, shingle, per_band, chunk_chars), "sketches")
    part = rows.filter("n > 0 AND id IS NOT NULL")
    reps = part.groupBy("f1", "f2").agg(F.min(F.struct("id", "sig", "bands")).alias("r"))
    reps = stored(reps.select("f1", "f2", F.col("r.id").alias("id"), F.col("r.sig").alias("sig"), F.col("r.bands").alias("bands")), "nodes")
    spread = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    multi = stored(spread.join(shared, "bucket"), "buckets")
    met = multi.groupBy("id").agg(F.sum("k").alias("met"))
    multi = stored(multi.join(met.join(reps.select("id", "sig"), "id"), "id"), "met-buckets")
    heads = multi.groupBy("bucket").agg(F.max(F.struct("met", "id", "sig")).alias("lead"))
    multi = multi.join(heads.select("bucket", F.col("lead.id").alias("lead"), F.col("lead.sig").alias("lead_sig")), "bucket")
    near = multi.filter(F.col("id") != F.col("lead")).withColumn("like", likeness("sig", "lead_sig")).filter(F.col("like") >= least)
    first = near.groupBy(F.col("id").alias("a")).agg(F.max_by("lead", "like").alias("b"))
    first = stored(first, "first-pairs")
    edges = stored(verified(first, docs, id_col, text_col, shingle, num, den, id_limit), "links")
    found = components(edges)

    # buckets that still hold several components: nodes outside the main one meet the rest
    home = reps.select("id", "sig", "bands").join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    placed = stored(multi.select("bucket", "band", "id").join(home.select("id", "comp"), "id"), "placed")
    sizes = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("x"), F.sum("c").alias("k"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    main = main.select(F.col("bucket"), F.col("x.comp").alias("main"), F.ceil(F.col("k") / block).alias("nk"), F.ceil((F.col("k") - F.col("x.c")) / block).alias("no"))
    open_ = stored(placed.join(main, "bucket"), "open")
    fine = fine_signatures(docs, stored(open_.select("id").distinct(), "open-ids"), id_col, text_col, shingle, fine_hashes, id_limit)
    open_ = stored(open_.join(home.select("id", "sig", "bands").join(fine, "id"), "id"), "open-signed")
    one = open_.filter("comp <> main").select("bucket", "band", F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("bands").alias("ba"), F.col("fine").alias("fa"), F.col("comp").alias("ca"), F.pmod(F.xxhash64("id"), F.col("no")).alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nk") - 1)).alias("j"))
    all_ = open_.select("bucket", F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("bands").alias("bb"), F.col("fine").alias("fb"), F.col("comp").alias("cb"), "main", F.pmod(F.xxhash64("id", F.lit(7)), F.col("nk")).alias("j"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("no") - 1)).alias("i"))
    new = F.lit(True)  # no band before this one brings the two together
    for j in range(BANDED // per_band - 1):
        new = new & ((F.col("band") <= j) | (F.col("ba")[j] != F.col("bb")[j]))
    pairs = one.join(all_, (one.bucket == all_.bucket) & (one.i == all_.i) & (one.j == all_.j) & (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & (likeness("sa", "sb") >= least) & new & (finely_alike("fa", "fb", fine_hashes) >= num / den - deviations * deviation(num / den, fine_hashes)))
    second = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "second-pairs")
    more = stored(verified(second, docs, id_col, text_col, shingle, num, den, id_limit), "links")
    if more.limit(1).count():
        found = components(edges.unionByName(more))
    nodes = reps.select("f1", "f2", F.col("id").alias("rep")).join(found.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("f1", "f2", F.coalesce("comp", "rep").alias("comp"))
    # one join hands out the components; a hot set is split by AQE's skew join
    linked = rows.select("id", "n", "f1", "f2").join(nodes, ["f1", "f2"], "left")
    comp = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.col("comp"))
    return linked.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op10_minhash_dedup(spark, sf_dir):
    from .common import read

    return near_dedup(read(spark, sf_dir, "documents"), shingle=3, num=85, per_band=5)


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({SQL_LOWER}, '[^ \\t\\n\\x0b\\x0c\\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.seen = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM (SELECT doc_id, min(seen) AS c FROM reach GROUP BY 1) LEFT JOIN size USING (doc_id)
"""
