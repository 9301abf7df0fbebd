"""Main text of web pages by a suffix array over each host's pages.

Pages are read in chunks of bounded size. The tokens of a chunk's pages stand end to end in one stream, and a suffix array sorted
to the least run's depth brings equal runs together. Their page counts are summed over all chunks by host and run, and runs that
stand in least_pages pages of the host are covered, however the pages were chunked and however large the host is.
What is covered is boilerplate; what is left, the unique runs, tells whether a page's articles by element hold its text or are
only a part of the regions that markup names; all regions of that kind are kept, in page order. Where no markup names a
region the blocks that are not covered are the text. Markup that says what it is (menus,
forms, scripts, adverts, comments and so on) is dropped anywhere. Inside a region that markup names as the article, covered
runs stay: a paragraph that another page quotes, and a page that was copied whole, are articles all the same.
"""

from __future__ import annotations

import hashlib
import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "optgroup": {"select"}}
RAW = re.compile(r"script|style|textarea|title|xmp|iframe|noembed|noframes", re.I)
#: Elements, roles and words of classes and ids that name what is no article.
NOISE_TAGS = frozenset("aside button canvas dialog embed fieldset footer form frameset head iframe input menu nav noframes noscript object script search select style svg template textarea title".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search searchbox toolbar".split())
#: A class or id token names noise if all its words are noise words or these, which say nothing by themselves.
GENERIC_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons col column container content desktop entry fixed form global group holder icon icons inner item items left link links list main "
    "message mobile module outer page panel post posts primary right row secondary section site slot stories story sub sticky text top unit view wrap wrapper zone".split()
)
NOISE_WORDS = frozenset(
    "ad ads advert advertisement advertising advertorial adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget".split()
)
REGION_WORDS = frozenset("article body content entry main post story text".split())


#: Markup that hides what it holds.
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD, HUMP = re.compile(r"[a-z]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("muted", "regions", "text")

    def __init__(self, text: str, regions: tuple[int, ...], muted: bool):
        self.text, self.regions, self.muted = text, regions, muted


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def noisy(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """2: noise by element, role or style; 1: by the name that its class or id gives it, or a header; 0: none.

    A name is a whole token: sidebar and sidebar-left are noise, no-sidebar and social-science are not.
    """
    if tag in NOISE_TAGS:
        return 2
    if tag == "header" and not in_article:
        return 1
    if not attrs:
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return 2
    if tag in ("html", "body", "main") or (tag == "article" and not in_article):
        return 0
    if attrs.get("role", "").lower() in NOISE_ROLES or HIDING.search(attrs.get("style", "")):
        return 2
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = set(WORD.findall(HUMP.sub("-", token).lower()))
        found = words & NOISE_WORDS - ({"header"} if in_article else set())
        if found and words <= found | GENERIC_WORDS:
            return 1
    return 0


def region_kind(tag: str, attrs: dict[str, str]) -> int:
    """2: an article by its element; 1: the main part by element, role or name; 0: neither."""
    if tag == "article" or (attrs and (attrs.get("role", "").lower() == "article" or attrs.get("itemprop") == "articleBody")):
        return 2
    if tag == "main" or (attrs and attrs.get("role", "").lower() == "main"):
        return 1
    if attrs and tag in ("div", "section", "td") and set(WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())) & REGION_WORDS:
        return 1
    return 0


def parse(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of visible text that is no noise by its markup, each with the regions it lies in; the kind of each region.

    An article or main element in an element that only its name calls noise is kept apart: it counts where it holds more
    text than all that stands outside such elements.
    """
    blocks: list[Block] = []
    kinds: list[int] = []
    stack: list[tuple[str, int, int, int]] = []  # element, its kind of noise, its region or -1, the named noise that it sets aside
    open_: dict[str, int] = {}
    regions, run = [], []
    hard = soft = articles = muted = 0

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(Block(text, tuple(regions), muted > 0))

    def pop():
        nonlocal hard, soft, articles, muted
        tag, noise, region, aside = stack.pop()
        open_[tag] -= 1
        hard -= noise == 2
        soft -= noise == 1
        if aside:
            soft += aside
            muted -= 1
        if region >= 0:
            regions.pop()
            articles -= kinds[region] == 2 or tag == "main"

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not (hard or soft) and (m is None or m.start() > at):
            run.append(html.unescape(page[at : m.start() if m else end]))
        if m is None:
            break
        at = m.end()
        if not m[2] or m[4] != ">":
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            if run:
                flush()
        elif tag == "br":
            run.append(" ")
        if m[1]:
            if open_.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in BLOCK and open_.get("p"):
            # a block ends an open paragraph, as far as no other block lies between
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in CLOSES and any(open_.get(x) for x in CLOSES[tag]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in STOPS[tag]:
                    break
                if stack[k][0] in CLOSES[tag]:
                    while len(stack) > k:
                        pop()
                    break
        if tag in VOID:
            continue
        if RAW.fullmatch(tag):
            close = raw_end(tag).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "plaintext":
            at = end
            continue
        attrs = attributes(m[3]) if len(m[3]) > 2 else {}
        noise = noisy(tag, attrs, articles > 0)
        kind = 0 if hard or noise else region_kind(tag, attrs)
        region, aside = -1, 0
        if soft and (kind == 2 or (kind and tag == "main")):
            aside, soft = soft, 0
            muted += 1
        elif soft:
            kind = 0
        if kind:
            region = len(kinds)
            kinds.append(kind)
            regions.append(region)
            articles += kind == 2 or tag == "main"
        hard += noise == 2
        soft += noise == 1
        open_[tag] = open_.get(tag, 0) + 1
        stack.append((tag, noise, region, aside))
    flush()
    apart = sum(len(b.text) for b in blocks if b.muted)
    if apart and apart <= sum(len(b.text) for b in blocks if not b.muted):
        blocks = [b for b in blocks if not b.muted]
    return blocks, kinds


@lru_cache(maxsize=16)
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


def suffixes(pages: list[list[str]], least_run: int) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined stream, each token's page, the starts of all whole runs of least_run tokens with equal runs together and by page within, and which of these begin a run.

    The suffix array of the stream is sorted by prefix doubling to depth least_run; windows with equal prefixes are
    neighbours in it.
    """
    lengths = np.fromiter(map(len, pages), np.int64, len(pages))
    n = int(lengths.sum())
    coded = pa.array([t for p in pages for t in p], pa.large_string()).dictionary_encode()
    stream = coded.indices.to_numpy().astype(np.int64) + len(pages)
    owner = np.repeat(np.arange(len(pages)), lengths)
    # a page's end: after it, ranks of the pages themselves, so that no run reaches over it
    room = np.concatenate((np.cumsum(lengths)[owner] - np.arange(n), [0]))
    rank, depth = np.unique(stream, return_inverse=True)[1].astype(np.int64) + 1, 1
    while depth < least_run:
        step = min(depth, least_run - depth)
        later = np.zeros(n, np.int64)
        inside = room[:-1] > step
        later[inside] = rank[np.flatnonzero(inside) + step]
        rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    full = np.flatnonzero(room[:-1] >= least_run)
    order = full[np.lexsort((owner[full], rank[full]))]  # the suffixes, equal runs together
    new_run = np.ones(len(order), bool)
    new_run[1:] = rank[order][1:] != rank[order][:-1]
    return coded, owner, order, new_run


def marked(pages: list[list[str]], starts: np.ndarray, least_run: int) -> list[np.ndarray]:
    """For each page's tokens whether one of the runs that begin at these places of the stream covers them."""
    lengths = np.fromiter(map(len, pages), np.int64, len(pages))
    edge = np.zeros(int(lengths.sum()) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + least_run, -1)
    hit = np.cumsum(edge[:-1]) > 0
    return np.split(hit, np.cumsum(lengths)[:-1])


def covered(pages: list[list[str]], least_run: int, share: float) -> list[np.ndarray]:
    """For each page's tokens whether a run of least_run tokens that several distinct pages share covers them.

    A run counts if it stands in two pages at least and in that share of all pages.
    """
    if len(pages) < 2 or sum(map(len, pages)) < least_run:
        return [np.zeros(len(p), bool) for p in pages]
    _, owner, order, new_run = suffixes(pages, least_run)
    new_page = new_run.copy()
    new_page[1:] |= owner[order][1:] != owner[order][:-1]
    group = np.cumsum(new_run) - 1
    in_pages = np.bincount(group, weights=new_page, minlength=1)
    return marked(pages, order[in_pages[group] >= max(2, share * len(pages))], least_run)


def keys_at(coded: pa.DictionaryArray, starts: np.ndarray, hosts: np.ndarray, least_run: int) -> np.ndarray:
    """64-bit keys of the runs that begin at these places: 16 bits of the host's hash, then 48 of the hash of host and run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = np.frombuffer(b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t in coded.dictionary.to_pylist()), np.uint64)
    stream = words[coded.indices.to_numpy()]
    x = hosts * np.uint64(0x9E3779B97F4A7C15)
    for j in range(least_run):
        x = x * np.uint64(0xD6E8FEB86659FD93) + stream[starts + j]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (hosts & np.uint64(0xFFFF << 48)) | (x >> np.uint64(16))


def run_counts(pages: list[list[str]], hosts: np.ndarray, least_run: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each run of each host in these pages, and in how many of them it stands."""
    if sum(map(len, pages)) < least_run:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    by_host = np.argsort(hosts, kind="stable")
    hosts = hosts[by_host]
    coded, owner, order, new = suffixes([pages[k] for k in by_host.tolist()], least_run)
    page = owner[order]
    new[1:] |= hosts[page][1:] != hosts[page][:-1]
    new_page = new.copy()
    new_page[1:] |= page[1:] != page[:-1]
    first = order[new]
    counts = np.bincount(np.cumsum(new) - 1, weights=new_page).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    return keys_at(coded, first, hosts[owner[first]], least_run), counts


def covered_by(pages: list[list[str]], hosts: np.ndarray, least_run: int, hot: np.ndarray) -> list[np.ndarray]:
    """For each page's tokens whether a run whose key is among the sorted hot ones covers them."""
    lengths = np.fromiter(map(len, pages), np.int64, len(pages))
    if not len(hot) or not lengths.sum():
        return [np.zeros(len(p), bool) for p in pages]
    coded = pa.array([t for p in pages for t in p], pa.large_string()).dictionary_encode()
    owner = np.repeat(np.arange(len(pages)), lengths)
    starts = np.flatnonzero(np.cumsum(lengths)[owner] - np.arange(len(owner)) >= least_run)
    key = keys_at(coded, starts, hosts[owner[starts]], least_run)
    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
    return marked(pages, starts[hot[at] == key], least_run)


def packed(x: np.ndarray, width: int) -> bytes:
    """Low bytes of 64-bit numbers, plane by plane, so that bytes that hardly change stand together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def extract(pages: list[str], least_run: int, share: float) -> list[str]:
    """Main texts of pages that are all of their host."""
    return texts_of(pages, lambda tokens: covered(tokens, least_run, share))


def tokens_of(blocks: list[Block]) -> list[str]:
    return [t for b in blocks for t in b.text.split()]


def texts_of(pages: list[str], cover) -> list[str]:
    """Main texts of pages; cover tells for each page's tokens which are covered."""
    parsed = [parse(p) for p in pages]
    tokens = [[b.text.split() for b in blocks] for blocks, _ in parsed]
    hits = cover([[t for b in page for t in b] for page in tokens])
    out = []
    for (blocks, kinds), page, hit in zip(parsed, tokens, hits, strict=True):
        unique = [int(k) for k in np.add.reduceat(~hit, np.cumsum([0, *map(len, page[:-1])]))] if page else []
        named = [k for k, b in enumerate(blocks) if b.regions]
        if named:
            # all regions together; articles by element alone if they hold most of the unique runs, or of the text where none is unique
            by_element = [k for k in named if any(kinds[r] == 2 for r in blocks[k].regions)]
            weight = unique if any(unique[k] for k in named) else [len(t) for t in page]
            if 2 * sum(weight[k] for k in by_element) > sum(weight[k] for k in named):
                named = by_element
            kept = [blocks[k] for k in named]
        else:
            # a block stays if its unique runs are half of it; a page without any is one whose twin is among the pages
            some = [b for b, n, t in zip(blocks, unique, page, strict=True) if 2 * n >= len(t)]
            kept = some or blocks
        out.append("\n".join(b.text for b in kept))
    return out


def chunks(batches, chars: int, rows: int):
    """Rows of record batches in lists of bounded size; html is the last column."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[-1])
            if size >= chars or len(held) >= rows:
                yield held
                held, size = [], 0
    if held:
        yield held


def frequent_runs(pages: DataFrame, least_run: int, least_pages: int, chars: int, rows: int) -> DataFrame:
    """key: the runs that stand in least_pages pages of their host at least; pages has host (its hash) and h.

    Chunks count their own runs; the keys are dealt by low bits, packed, and summed.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, min(12, (4 * n - 1).bit_length()))

    def count(batches):
        for held in chunks(batches, chars, rows):
            hosts = np.array([r[0] for r in held], np.int64).view(np.uint64)
            key, k = run_counts([tokens_of(parse(r[-1])[0]) for r in held], hosts, least_run)
            bucket = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.lexsort((key, bucket))
            key, k, bucket = key[order] >> np.uint64(bits), k[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cut[1:], len(key))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut], pa.int64()), pa.array([packed(key[a:b], 8 - bits // 8) for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([packed(k[a:b], 4) for a, b in zip(cut, ends, strict=True)], pa.binary())],
                ["bucket", "keys", "counts"],
            )

    def add(batches):
        def total(bucket, keys, counts):
            key, k = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            key, k = key[order], k[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            often = key[first][np.add.reduceat(k, first) >= least_pages]
            return pa.RecordBatch.from_arrays([pa.array(((often << np.uint64(bits)) | np.uint64(bucket)).view(np.int64))], ["key"])

        last, keys, counts = None, [], []
        for batch in batches:
            for bucket, key, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if keys and bucket != last:
                    yield total(last, keys, counts)
                    keys, counts = [], []
                last = bucket
                keys.append(unpacked(key, 8 - bits // 8))
                counts.append(unpacked(k, 4).astype(np.int64))
        if keys:
            yield total(last, keys, counts)

    dealt = pages.select("host", "h").mapInArrow(count, "bucket bigint, keys binary, counts binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add, "key bigint")


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_run: int = 8, least_pages: int = 3, range_chars: int = 6_000_000, range_pages: int = 1000, key_limit: int = 8_000_000
) -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    Pages are read twice, in chunks of about range_chars or range_pages, which bound memory and decide nothing: once to count
    in how many pages of its host each run stands, once to cover those that stand in least_pages. The keys of the latter are
    broadcast; beyond key_limit the hosts are dealt into as many shards as keep each broadcast near it. Null html gives
    an empty text, as does a page without visible text; pages with a null or odd URL form a host of their own. Null ids,
    repeated rows and very long pages are read like any other, and each row counts as a page; an empty table gives an empty
    result. Columns other than the three are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("h"))
    base = base.withColumn("host", F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))))
    hot = stored(frequent_runs(base, least_run, least_pages, range_chars, range_pages), "frequent-runs")
    shards = max(1, -(-hot.count() // key_limit))
    kind = pages.schema[id_col].dataType.simpleString()
    names = [id_col, url_col, "text", "n_chars"]

    def of(shard):
        mine = lambda c: F.pmod(F.shiftrightunsigned(c, 48), F.lit(shards)) == shard
        keys = spark.sparkContext.broadcast(np.sort(hot.filter(mine("key")).toArrow().column(0).to_numpy().view(np.uint64)))

        def run(batches):
            for batch in batches:
                id_type = batch.column(0).type
                for held in chunks([batch], range_chars, range_pages):
                    ids, urls, hosts, pages_ = zip(*held, strict=True)
                    texts = texts_of(list(pages_), lambda tokens, h=hosts: covered_by(tokens, np.array(h, np.int64).view(np.uint64), least_run, keys.value))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

        return base.filter(mine("host")).select("id", "url", "host", "h").mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")

    out = of(0)
    for shard in range(1, shards):
        out = out.unionAll(of(shard))
    return out


def op1_html_extraction(spark, sf_dir):
    from .common import read

    return main_text(read(spark, sf_dir, "pages"))
