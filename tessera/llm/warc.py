"""WARC archives with a two-level capture index.

Records go to gzip members in archive files. The index sorts their reversed-host URL keys into compressed blocks; a sparse
directory holds each block's first key and place. A look-up searches the directory, then the block, both by bisection, and
reads the record by its range. All files lie in the shared folder. A task's files have names of their own and count only
once the rows that name them are stored, so a repeated task leaves no record twice.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from functools import lru_cache
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, ship, stored

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def url_key(url: str | None) -> str:
    """Host labels reversed and parted by commas, then `)` and the rest without its fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.replace("\n", " ").replace("\t", " ")
    host = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    key = f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")
    return key.replace("\n", "%0A").replace("\t", "%09").replace("\r", "%0D")


def b32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(id_text: str, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{quote(id_text, safe='')}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{quote(refers, safe='')}>"]), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, its HTTP headers, its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def verdicts(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """id, digest (hex) and response id for the pages that are revisits."""
    slim = pages.select(F.col(id_col).alias("id"), F.sha1(F.coalesce(html_col, F.lit(""))).alias("d"), F.octet_length(F.coalesce(html_col, F.lit(""))).alias("n"))
    groups = slim.filter(F.col("n") >= least_bytes).groupBy("d", "n").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return slim.join(groups, ["d", "n"]).filter("id <> response").select("id", "d", "response").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, file_bytes: int = 256_000_000, level: int = 3, id_limit: int = 300_000) -> DataFrame:
    """Writes a record for each row; returns key, id, file, start and length of each, stored.

    Of rows with equal payloads of at least least_bytes the largest id is a response and the others are revisits of it;
    smaller payloads are all responses. Null html is an empty payload, a null URL an empty target. Rows with a null id are
    responses. Rows repeated with the same id and payload are written each and share the role. Below id_limit revisits their
    list is broadcast and no html is shuffled; beyond it the join shuffles.
    """
    ship(pages.sparkSession)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")).withColumn("d", F.sha1("html"))
    again = stored(verdicts(pages, id_col, html_col, least_bytes), "revisits")
    rows = base.join(F.broadcast(again) if again.count() <= id_limit else again, ["id", "d"], "left")

    def run(batches):
        fs, root = filesystem(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                keys, files, starts, lengths = [], [], [], []
                for i, url, html, d, response in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    data = member(record(json.dumps(i), url, html.encode("utf-8"), b32(d), None if response is None else json.dumps(response)), level)
                    out.write(data)
                    keys.append(url_key(url))
                    files.append(name)
                    starts.append(at)
                    lengths.append(len(data))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0), pa.array(files, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], ["key", "id", "file", "start", "length"])
        finally:
            if out is not None:
                out.close()

    kind = pages.schema[id_col].dataType.simpleString()
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    return stored(rows.select("id", "url", "html", "d", "response").mapInArrow(run, f"key string, id {kind}, file string, start bigint, length bigint"), "captures")


def write_index(captures: DataFrame, folder: str, block_rows: int = 500) -> list[tuple[str, str, str]]:
    """Sorts the captures into compressed blocks; returns first key, first id and directory file of each part, in order.

    Parts are ranges of (key, id), so captures of one URL or host spread over many. Each part has a file of blocks and a
    directory of them; the list that comes back has a row for each part.
    """

    def run(batches):
        fs, root = filesystem(folder)
        name, directory, lines, at, out = uuid.uuid4().hex, [], [], 0, None

        def flush():
            nonlocal at, out
            if not lines:
                return
            if out is None:
                out = fs.open_output_stream(f"{root}/index-{name}.gz", compression=None)
            data = member("\n".join(lines).encode(), 6)
            out.write(data)
            directory.append("\t".join([*lines[0].split("\t")[:2], str(at), str(len(data))]))
            at += len(data)
            lines.clear()

        try:
            for batch in batches:
                for key, i, file, start, length in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                    lines.append(f"{key}\t{json.dumps(i)}\t{file}\t{start}\t{length}")
                    if len(lines) == block_rows:
                        flush()
            flush()
        finally:
            if out is not None:
                out.close()
        if directory:
            with fs.open_output_stream(f"{root}/directory-{name}.gz", compression=None) as f:
                f.write(member("\n".join(directory).encode(), 6))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*directory[0].split("\t")[:2], name)], ["key", "id", "name"])

    spark = captures.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
    parts = stored(ordered.mapInArrow(run, "key string, id string, name string"), "parts")
    return sorted(((r.key, r.id, r.name) for r in parts.toLocalIterator()), key=lambda r: (r[0].encode(), order(r[1])))


def order(id_json: str):
    """Ids as Spark sorts them: null first, numbers by value, strings by bytes."""
    x = json.loads(id_json)
    return (0, 0) if x is None else (1, x.encode() if isinstance(x, str) else x)


class Index:
    """Look-ups in the blocks. Directories and blocks used last are kept."""

    def __init__(self, folder: str, parts: list[tuple[str, str, str]]):
        self.folder, self.parts = folder, parts
        self.firsts = [(k.encode(), order(i)) for k, i, _ in parts]
        self.directory, self.block = lru_cache(8)(self._directory), lru_cache(32)(self._block)

    def _read(self, name: str, start: int = 0, length: int | None = None) -> list[str]:
        fs, root = filesystem(self.folder)
        with fs.open_input_file(f"{root}/{name}") as f:
            f.seek(start)
            return zlib.decompress(f.read(length), 31).decode().split("\n")

    def _directory(self, name: str):
        rows = [x.split("\t") for x in self._read(f"directory-{name}.gz")]
        return [(r[0].encode(), order(r[1])) for r in rows], [(int(r[2]), int(r[3])) for r in rows]

    def _block(self, name: str, start: int, length: int):
        rows = [x.split("\t") for x in self._read(f"index-{name}.gz", start, length)]
        return [(r[0].encode(), order(r[1])) for r in rows], [(r[2], int(r[3]), int(r[4])) for r in rows]

    def find(self, key: str, id_json: str) -> list[tuple[str, int, int]]:
        """File, start and length of each capture with this key and id."""
        want, out = (key.encode(), order(id_json)), []
        # captures with the same key and id may begin at the end of the part or block before
        for p in range(max(0, bisect.bisect_left(self.firsts, want) - 1), bisect.bisect_right(self.firsts, want)):
            name = self.parts[p][2]
            firsts, places = self.directory(name)
            for b in range(max(0, bisect.bisect_left(firsts, want) - 1), bisect.bisect_right(firsts, want)):
                keys, found = self.block(name, *places[b])
                out += found[bisect.bisect_left(keys, want) : bisect.bisect_right(keys, want)]
        return out


def locate(wanted: DataFrame, folder: str, parts: list[tuple[str, str, str]]) -> DataFrame:
    """id, file, start, length of each capture of the wanted (url, id); the rows are taken in key order."""
    spark = wanted.sparkSession
    index = spark.sparkContext.broadcast(parts)  # one row for each of the index's partitions
    kind = wanted.schema["id"].dataType.simpleString()

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["key", "id"])

    def run(batches):
        look = Index(folder, index.value)
        for batch in batches:
            rows = [(i, *hit) for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in look.find(key, json.dumps(i))]
            cols = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(1).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["id", "file", "start", "length"])

    keys = wanted.select("url", "id").mapInArrow(keyed, f"key string, id {kind}").distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").mapInArrow(run, f"id {kind}, file string, start bigint, length bigint")


def read_records(places: DataFrame, folder: str, gap: int = 64_000, span: int = 4_000_000, payloads: bool = True) -> DataFrame:
    """The records at the places: id, payload_bytes, payload_digest, record_type, refers_to, target_uri and the payload.

    Places are taken in the order of file and start, and near ones are read in one range. A response's digest is computed
    from its payload; a revisit has both figures of the full payload in its headers.
    """
    kind = places.schema["id"].dataType.simpleString()

    def run(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            out, lo = [], 0
            while lo < len(rows):
                hi = lo + 1
                while hi < len(rows) and rows[hi][1] == rows[lo][1] and 0 <= rows[hi][2] - (rows[hi - 1][2] + rows[hi - 1][3]) <= gap and rows[hi][2] + rows[hi][3] - rows[lo][2] <= span:
                    hi += 1
                with fs.open_input_file(f"{root}/{rows[lo][1]}") as f:
                    f.seek(rows[lo][2])
                    data = f.read(rows[hi - 1][2] + rows[hi - 1][3] - rows[lo][2])
                for i, _, start, length in rows[lo:hi]:
                    fields, http, payload = parsed(zlib.decompress(data[start - rows[lo][2] : start - rows[lo][2] + length], 31))
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    refers, target = fields.get("WARC-Refers-To"), unquote(fields["WARC-Target-URI"])
                    if refers is None:
                        digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        if digest != said:
                            raise ValueError(f"damaged record in {rows[lo][1]} at {start}")
                    else:
                        digest, n = said, int(http["Content-Length"])
                        refers = json.loads(unquote(refers.removeprefix("<urn:page:").removesuffix(">")))
                    out.append((i, n, digest, fields["WARC-Type"], refers, target, payload if payloads else None))
                lo = hi
            cols = [list(c) for c in zip(*out, strict=True)] or [[] for _ in range(7)]
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.string(), batch.column(0).type, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"])

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = places.repartitionByRange(n, "file", "start").sortWithinPartitions("file", "start")
    return ordered.mapInArrow(run, f"id {kind}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}, target_uri string, payload binary")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the archives and their index, then reads every page back through the index. One row per row of pages.

    An empty table gives an empty result; see write_archives() for nulls, ties and repeated rows.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, id_col, url_col, html_col, least_bytes)
    parts = write_index(captures, folder)
    places = locate(pages.select(F.col(url_col).alias("url"), F.col(id_col).alias("id")), folder, parts)
    return read_records(places, folder, payloads=False).drop("payload", "target_uri").withColumnRenamed("id", id_col)


def op9_warc(spark, sf_dir):
    from .common import read

    return archive_round_trip(read(spark, sf_dir, "pages"))


#: The base32 alphabet spells 5 bits of the SHA-1 at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS r, sha1(h) AS x FROM p),
b AS (SELECT page_id, r, octet_length(encode(h)) AS n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 1 + (((('0x' || substr(x || '00', (i * 5) // 4 + 1, 3))::INT) >> (12 - 5 - (i * 5) % 4)) & 31)::INT, 1)), '') AS digest FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = r THEN NULL ELSE r END AS refers_to FROM b
"""
