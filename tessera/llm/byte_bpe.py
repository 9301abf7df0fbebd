"""Byte-level BPE by corpus-level merge replay, and its decoding.

The distinct words of a chunk of the corpus lie end to end in one array of token ids. An inverted index leads from each
merge rank to the positions of the pairs that it joins; the ranks are replayed in order, each over all its positions at
once, and only the neighbours of a merged pair are looked up again and entered in the index.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import slices

NONE = np.int32(2**31 - 1)
#: Words, and ids in them, that a worker keeps from chunk to chunk.
KEPT_WORDS, KEPT_IDS = 200_000, 2_000_000


class Ranks:
    """A rank file: token bytes by id, and for each pair of ids whose bytes joined are a token, that token's id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(self.ids.values()) + 1
        self.tokens = [b""] * self.size
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(pairs.values(), np.int32, len(pairs))[order]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it has none. b below 0 stands for a word's end."""
        keys = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == keys) & (b >= 0), self.pair_ranks[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """One word by its own lowest rank first, with a heap: for the words whose ranks do not rise."""
        tok = [self.ids[word[i : i + 1]] for i in range(len(word))]
        end = len(tok)
        after, before, text = list(range(1, end + 1)), list(range(-1, end - 1)), [word[i : i + 1] for i in range(end)]
        heap = []

        def push(i):
            j = after[i]
            if j < end and (r := self.ids.get(text[i] + text[j])) is not None:
                heapq.heappush(heap, (r, i, len(text[i]), len(text[j])))

        for i in range(end):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tok[i] is None or j >= end or len(text[i]) != a or len(text[j]) != b:
                continue
            text[i], tok[i], tok[j] = text[i] + text[j], r, None
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [t for t in tok if t is not None]


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def replay(table: Ranks, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of the distinct words, with where each word's run begins and how long it is."""
    direct = np.fromiter((table.ids.get(w, -1) for w in words), np.int64, len(words))  # a word that is a token is that token
    todo = np.flatnonzero(direct < 0).tolist()
    starts_of, lengths_of = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    known = np.flatnonzero(direct >= 0)
    starts_of[known] = np.arange(len(known))
    runs = [direct[known]]
    if not todo:
        return runs[0].astype("<u4"), starts_of, lengths_of
    lengths = np.fromiter((len(words[k]) for k in todo), np.int64, len(todo))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    tok = table.byte[np.frombuffer(b"".join(words[k] for k in todo), np.uint8)]
    n = len(tok)
    after = np.arange(1, n + 1, dtype=np.int64)
    after[starts[1:] - 1] = n  # n: past a word's end
    before = np.arange(-1, n - 1, dtype=np.int64)
    before[starts[:-1]] = -1
    padded = np.concatenate((tok, np.array([-1], np.int32)))  # of the place past the end
    tok = padded
    cur = table.rank(tok[:-1], tok[after])
    index: list[list[np.ndarray]] = [[] for _ in range(table.size)]  # from a rank to positions of its pairs
    order = np.argsort(cur, kind="stable")
    sorted_ranks = cur[order]
    cut = np.searchsorted(sorted_ranks, np.arange(table.size + 1))
    suspect = []  # positions in words where a merge made a pair of lower rank

    def enter(positions: np.ndarray, new: np.ndarray, r: int) -> None:
        cur[positions] = new
        low = new < r
        if low.any():
            suspect.append(positions[low])
        good = new != NONE
        if not good.all():
            positions, new = positions[good], new[good]
        if len(new) == 0:
            return
        if len(new) == 1:
            index[new[0]].append(positions)
            return
        by = np.argsort(new, kind="stable")
        new, positions = new[by], positions[by]
        edges = np.flatnonzero(new[1:] != new[:-1]) + 1
        lo = 0
        for hi in [*edges.tolist(), len(new)]:
            index[new[lo]].append(positions[lo:hi])
            lo = hi

    cuts = cut.tolist()
    for r in range(table.size):
        lo, hi = cuts[r], cuts[r + 1]
        later = index[r]
        if lo == hi and not later:
            continue
        at = order[lo:hi]
        if later:
            at = np.concatenate([at, *later])
            index[r] = []
        at = at[cur[at] == r]
        if len(at) == 0:
            continue
        if later and len(at) > 1:
            at = np.unique(at)
        if len(at) > 1:
            chained = np.flatnonzero(after[at[:-1]] == at[1:])
            if len(chained):  # overlapping pairs: from the left, every other one
                taken = np.ones(len(at), bool)
                for c in chained.tolist():
                    if taken[c]:
                        taken[c + 1] = False
                at = at[taken]
        gone = after[at]
        right = after[gone]
        tok[at] = r
        tok[gone] = -2
        cur[gone] = NONE
        after[at] = right
        inner = right < n
        before[right[inner]] = at[inner]
        enter(at, table.rank(tok[at], tok[right]), r)
        left = before[at]
        left = left[left >= 0]
        if len(left):
            enter(left, table.rank(tok[left], tok[after[left]]), r)
    alive = tok[:-1] >= 0
    ends = np.concatenate(([0], np.cumsum(alive)))[starts]
    starts_of[todo], lengths_of[todo] = ends[:-1] + len(known), np.diff(ends)
    runs.append(tok[:-1][alive])
    if suspect:
        end = len(known) + int(ends[-1])
        for w in np.unique(np.searchsorted(starts, np.concatenate(suspect), "right") - 1).tolist():
            one = table.one(words[todo[w]])
            starts_of[todo[w]], lengths_of[todo[w]] = end, len(one)
            end += len(one)
            runs.append(np.array(one))
    return np.concatenate(runs).astype("<u4"), starts_of, lengths_of


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values that the codes name, end to end, and where each begins (one more than codes)."""
    sizes = lengths[codes]
    begin = np.concatenate(([0], np.cumsum(sizes)))
    return values[np.repeat(starts[codes] - begin[:-1], sizes) + np.arange(begin[-1])], begin


class Codec:
    """Encodes texts by a rank file and a splitting pattern; decodes ids.

    Texts are cut before each space, and the pattern runs over the distinct units only. That is exact for patterns where a
    space belongs to the word after it, as long as no white space follows a space; texts where some does are split by the
    pattern as a whole.
    """

    def __init__(self, path: str, pattern: str):
        self.table, self.split = ranks(path), regex.compile(pattern)
        lengths = np.fromiter(map(len, self.table.tokens), np.int64, self.table.size)
        self.token_bytes = np.frombuffer(b"".join(self.table.tokens), np.uint8), np.cumsum(lengths) - lengths, lengths
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.spelt = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _replayed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words; only those that no chunk before had are replayed.

        Words are kept from chunk to chunk up to KEPT_WORDS of them and KEPT_IDS ids; beyond that all are forgotten.
        """
        at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        todo = np.flatnonzero(at < 0)
        flat, starts, lengths = self.spelt
        if len(todo):
            new = [words[k] for k in todo.tolist()]
            more, begin, size = replay(self.table, new)
            at[todo] = len(starts) + np.arange(len(new))
            flat, starts, lengths = np.concatenate((flat, more)), np.concatenate((starts, begin + len(flat))), np.concatenate((lengths, size))
            if len(starts) <= KEPT_WORDS and len(flat) <= KEPT_IDS:
                self.known.update(zip(new, at[todo].tolist(), strict=True))
                self.spelt = flat, starts, lengths
            else:
                self._forget()
        return flat, starts[at], lengths[at]

    def _spell(self, words: list[str], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of ids for groups of words; group k begins at word begin[k]."""
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        distinct = [w.encode("utf-8") for w in coded.dictionary.to_pylist()]
        flat, at = gather(*self._replayed(distinct), coded.indices.to_numpy())
        bounds = at[np.concatenate((begin, [len(words)])).astype(np.int64)]
        return flat, bounds[:-1], np.diff(bounds)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        codes, units = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        spaced = np.fromiter((not u or u[0].isspace() for u in units), bool, len(units))
        inner = np.ones(len(codes), bool)
        inner[offsets[:-1]] = False
        whole = np.unique(np.searchsorted(offsets, np.flatnonzero(inner & spaced[codes]), "right") - 1).tolist()
        # units after a space: in their joined text each word that begins with a space begins a unit
        plain = np.flatnonzero(~spaced)
        words = self.split.findall("".join([" " + units[k] for k in plain.tolist()]))
        starts_of, lengths_of = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        flat, starts_of[plain], lengths_of[plain] = self._spell(words, np.flatnonzero(np.fromiter((w[0] == " " for w in words), bool, len(words))))
        # the first unit of each text has no space before it
        heads: dict[str, int] = {}
        first = np.fromiter((heads.setdefault(units[c], len(heads)) for c in codes[offsets[:-1]].tolist()), np.int64, len(texts))
        parts = [self.split.findall(u) for u in [*heads, *(texts[k] for k in whole)]]
        ids, starts, lengths = self._spell([w for p in parts for w in p], np.cumsum([0, *map(len, parts[:-1])]))
        codes[offsets[:-1]] = first + len(units)
        starts_of, lengths_of = np.concatenate((starts_of, starts[: len(heads)] + len(flat))), np.concatenate((lengths_of, lengths[: len(heads)]))
        tokens, at = gather(np.concatenate((flat, ids)), starts_of, lengths_of, codes)
        bounds = at[offsets].tolist()
        out = [tokens[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
        for k, lo, n in zip(whole, starts[len(heads) :].tolist(), lengths[len(heads) :].tolist(), strict=True):
            out[k] = ids[lo : lo + n].tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        return gather(*self.token_bytes, np.frombuffer(ids, "<u4"))[0].tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker: later tasks find its tables made, and the words of earlier ones."""
    return Codec(path, pattern)


def chunks(batches, limit: int):
    """(ids, texts) lists of about limit bytes from Arrow batches of (id, text); a text is never cut.

    Only the slice that fills a chunk is turned into Python strings, whatever the size of a batch.
    """
    ids, texts, size = [], [], 0
    for part in slices(batches, max(1, limit // 4)):
        ids += part.column(0).to_pylist()
        more = [t or "" for t in part.column(1).to_pylist()]
        texts += more
        size += sum(map(len, more))
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode_docs(docs, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 8_000_000, with_ids: bool = True, batch_bytes: int = 8_000_000):
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, and with with_ids the token ids.

    The replay runs over the distinct words of chunk_chars characters of a task's rows at a time that the worker has not met,
    so memory is bounded by the chunk (and by the longest single text); nothing is shuffled. Every match of the pattern is encoded by itself and
    there are no special tokens. Null text counts as empty: no tokens, and the digests of no bytes. Null ids and repeated
    rows pass through as they are; an empty table gives an empty result. Columns other than the two are not read.
    """
    from pyspark.sql import functions as F

    from .common import ship

    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    def run(batches):
        coder = codec(vocab_path, pattern)
        for ids, texts in chunks(batches, chunk_chars):
            coded = coder.encode(texts)
            lo = 0
            while lo < len(ids):  # batches of a bounded number of bytes, or of one text
                hi, size = lo, 0
                while hi < len(ids) and (hi == lo or size + len(coded[hi]) <= batch_bytes):
                    size += len(coded[hi])
                    hi += 1
                part = coded[lo:hi]
                cols = [
                    pa.array(ids[lo:hi], arrow_id),
                    pa.array([len(c) // 4 for c in part], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in part], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(c)).hexdigest() for c in part], pa.string()),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.cumsum([0, *(len(c) // 4 for c in part)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(part), "<i4"))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(cols, names)
                lo = hi

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(docs.schema[id_col].dataType)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode_docs(tokens, vocab_path: str, id_col: str = "doc_id", ids_col: str = "token_ids"):
    """One row per input row: id, text. Null ids of tokens give empty text; bytes that are no UTF-8 become U+FFFD."""
    from pyspark.sql.pandas.types import to_arrow_type

    from .common import ship

    ship(tokens.sparkSession)
    arrow_id = to_arrow_type(tokens.schema[id_col].dataType)

    def run(batches):
        table = ranks(vocab_path)
        for batch in batches:
            texts = [b"".join(table.tokens[i] for i in x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow_id), pa.array(texts, pa.string())], [id_col, "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {tokens.schema[id_col].dataType.simpleString()}, text string")


def op3_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from .common import read

    return encode_docs(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
