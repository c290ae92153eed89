"""WARC archives with a two-level capture index.

Records are written as gzip members to WARC files in the shared folder. The index sorts the captures
by their reversed-host URL keys into compressed blocks; each index file ends with its own sparse
block directory (the first key of every block), and the list of index files with their first keys is
all that a reader holds whole. A lookup finds the file, then the block, by binary search, and reads
two ranges: the block, and the record that the capture's line names.

Of captures with equal payloads the one with the largest page_id is a response; the others are
revisits of it, without payload but with the response's HTTP header, whose Content-Length is the
full payload's.

Defined results: null html is an empty payload, null url an empty one; a null page_id is written
as `null` and comes first; rows that share both page_id and payload are equal captures, all of them
response or all revisit; an empty table gives empty archives; other columns are not looked at.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ranges, locate, materialise, new_dir, slices, tidy

#: Captures in an index block.
BLOCK_LINES = 256
#: Bytes of neighbouring records that are read together.
READ_AHEAD = 1 << 20


def surt(url: str | None) -> str:
    """A URL's sort key: its host's labels reversed, then the rest: `com,example)/path?query`."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "://" in text else f"//{text}")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return text.lower()
    host = ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port else "")
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: int | None, is_revisit: bool) -> bytes:
    """One WARC record: a response, or a revisit of the capture `revisits`."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url or '')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{revisits}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def parse(member: bytes) -> dict:
    """What a gzip member's record says: page_id, type, refers_to, digest, length and payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    out = {"page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "type": fields["WARC-Type"], "refers_to": None, "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "length": length, "payload": None}
    if out["type"] == "revisit":
        out["refers_to"] = _page(fields["WARC-Refers-To"])
    else:
        if len(payload) != length or digest32(payload) != out["digest"]:
            raise ValueError("a stored payload differs from its header")
        out["payload"] = payload
    return out


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html); one row a capture.

    (key, page_id, file, offset, length)
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("hash"))
    newest = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("hash")).groupBy("hash").agg(F.max("page_id").alias("newest"))
    # a digest's rows may be many, the other side has one row for each: Spark can split the skew
    joined = rows.join(newest, "hash").select("page_id", "url", "payload", "newest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = locate(f"{folder}/{uuid.uuid4().hex}.warc.gz")
        uri, at, out = f"{folder}/{path.rsplit('/', 1)[1]}", 0, None
        for whole in batches:
            for batch in slices(whole, "payload"):
                if out is None:
                    out = fs.open_output_stream(path, compression=None)
                lines: list[tuple] = []
                for page, url, body, newest_page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "newest")), strict=True):
                    member = _gzip(record(page, url, body, digest32(body), newest_page, newest_page is not None and page != newest_page))
                    out.write(member)
                    lines.append((surt(url), page, uri, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return joined.mapInArrow(tidy(run), "key string, page_id long, file string, offset long, length long")


def _order(key: str, page_id: int | None) -> tuple:
    return key.encode(), page_id is not None, page_id or 0


def write_index(captures: DataFrame, folder: str, parts: int) -> DataFrame:
    """Sort the captures into index files; one row a file: its first key, place of its directory."""
    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = locate(f"{folder}/{uuid.uuid4().hex}.idx")
        uri, out, directory, lines, at = f"{folder}/{path.rsplit('/', 1)[1]}", None, [], [], 0

        def block() -> None:
            nonlocal lines, at
            packed = zlib.compress("\n".join(map(json.dumps, lines)).encode())
            out.write(packed)
            directory.append([lines[0][0], lines[0][1], at, len(packed)])
            at += len(packed)
            lines = []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True):
                if out is None:
                    out = fs.open_output_stream(path, compression=None)
                lines.append(row)
                if len(lines) >= BLOCK_LINES:
                    block()
        if out is not None:
            if lines:
                block()
            packed = zlib.compress(json.dumps(directory).encode())
            out.write(packed)
            out.close()
            first = directory[0]
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([uri]), pa.array([at]), pa.array([len(packed)])], names=["key", "page_id", "file", "offset", "length"])

    return ordered.mapInArrow(tidy(run), "key string, page_id long, file string, offset long, length long")


class CaptureIndex:
    """Looks captures up in index files. files: (first key, first page_id, file, offset, length)."""

    def __init__(self, files: list[tuple]):
        self.files = sorted(files, key=lambda f: _order(f[0], f[1]))
        self.first = [_order(f[0], f[1]) for f in self.files]
        self.ranges, self.directory, self.block = Ranges(), (None, []), (None, [])

    def find(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """(file, offset, length) of all captures of that key and page_id."""
        want, out = _order(key, page_id), []
        i = max(0, bisect.bisect_left(self.first, want) - 1)
        while i < len(self.files) and self.first[i] <= want:
            _, _, uri, at, n = self.files[i]
            if self.directory[0] != uri:
                rows = json.loads(zlib.decompress(self.ranges.read(uri, at, n)))
                self.directory = (uri, [(_order(k, p), a, m) for k, p, a, m in rows])
            blocks = self.directory[1]
            j = max(0, bisect.bisect_left(blocks, want, key=lambda b: b[0]) - 1)
            while j < len(blocks) and blocks[j][0] <= want:
                _, a, m = blocks[j]
                if self.block[0] != (uri, a):
                    lines = [json.loads(x) for x in zlib.decompress(self.ranges.read(uri, a, m)).split(b"\n")]
                    self.block = ((uri, a), [(_order(x[0], x[1]), tuple(x[2:])) for x in lines])
                found = self.block[1]
                b = bisect.bisect_left(found, want, key=lambda x: x[0])
                while b < len(found) and found[b][0] == want:
                    out.append(found[b][1])
                    b += 1
                j += 1
            i += 1
        return out


def look_up(index: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """Places (file, offset, length) of the captures of wanted(url, page_id), each distinct pair once.

    The list of index files has one row a partition of the index; it is all that is sent around.
    """
    files = [tuple(r) for r in index.select("key", "page_id", "file", "offset", "length").collect()]
    # in key order, so that a task's lookups go through its blocks once
    ordered = wanted.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = CaptureIndex(files)
        for batch in batches:
            out = [place for key, page in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True) for place in reader.find(key, page)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "offset", "length"])
        reader.ranges.close()

    return ordered.mapInArrow(tidy(run), "file string, offset long, length long")


def wanted_keys(pages: DataFrame) -> DataFrame:
    """(key, page_id) of pages(page_id, url), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")], names=["key", "page_id"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(tidy(run), "key string, page_id long").distinct()


_READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_records(places: DataFrame, parts: int, payload: bool = True) -> DataFrame:
    """Read records by range, in the archives' order; payload is null for revisits, or if not asked for."""
    ordered = places.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            i = 0
            while i < len(rows):
                j = i + 1
                while j < len(rows) and rows[j][0] == rows[i][0] and rows[j][1] == sum(rows[j - 1][1:]) and rows[j][1] - rows[i][1] < READ_AHEAD:
                    j += 1
                uri, start, _ = rows[i]
                raw = files.read(uri, start, sum(rows[j - 1][1:]) - start)
                got = [parse(raw[at - start : at - start + n]) for _, at, n in rows[i:j]]
                columns = [[g[c] for g in got] for c in ("page_id", "url", "type", "refers_to", "digest", "length")]
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([g["payload"] if payload else None for g in got], pa.binary())], names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
                i = j
        files.close()

    return ordered.mapInArrow(tidy(run), _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: write every page, index the captures, look every page up, read it back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = new_dir(spark, "warc")
    captures = materialise(write_archives(pages, folder), "warc-captures")
    parts = max(spark.sparkContext.defaultParallelism, captures.count() // 100_000 + 1)
    index = materialise(write_index(captures, folder, parts), "warc-index")
    wanted = materialise(wanted_keys(pages), "warc-wanted")
    places = materialise(look_up(index, wanted, parts), "warc-places")
    return read_records(places, parts, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT page_id, body, hex, max(page_id) OVER (PARTITION BY body) AS newest FROM p),
d AS (SELECT page_id, body, newest,
        array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
          lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT) >> s) & 31 AS INTEGER), 1)), '')), '') AS b32 FROM g)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
       CASE WHEN newest IS NULL OR page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN newest IS NULL OR page_id = newest THEN NULL ELSE newest END AS refers_to
FROM d
"""
