"""Media columns: interleaved sequences of text and media, with payloads kept apart.

A page's HTML is parsed into one ordered list of structs: text runs and media references, each with
its position, and captions with the medium that they belong to. Payloads lie once per digest in a
media store, files in the shared folder of which a table names the ranges. A join on the digest
resolves references; the payloads themselves are read by range where they are needed and never
shuffled.

Media are stored as PNG images of 8-bit grey samples, WIDTH samples a row: lossless, so the samples
read back are the payload's bytes.

Defined results: null HTML has no items; references without a stored payload stay unresolved (null
place); repeated references keep their own positions; repeated payloads are stored once per writing
task and resolved to one place; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Ranges, locate, materialise, new_dir, slices, tidy

WIDTH = 192
PAD = 32
SCHEME = "urn:sha256:"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(payload: bytes) -> bytes:
    """Filled up with PAD to a positive multiple of WIDTH."""
    rows = max(1, -(-len(payload) // WIDTH))
    return payload.ljust(rows * WIDTH, bytes([PAD]))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: bytes) -> bytes:
    """An 8-bit grey PNG of WIDTH columns; every row with filter type none."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of a PNG that encode_png wrote; checks every chunk."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, width = 8, b"", 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, _, depth, colour, _, _, _ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("a row is filtered")
    return rows[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Height, sums and quartile counts of the samples."""
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x >> 6, minlength=4)
    edges = int(np.abs(np.diff(x.astype(np.int16))).sum())
    return f"w={WIDTH};h={len(x) // WIDTH};sum={int(x.sum(dtype=np.int64))};min={x.min()};max={x.max()};edges={edges};bins=" + ",".join(map(str, counts))


ITEM = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("caption", T.StringType())])
_ITEM_ARROW = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
_MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src", "object": "data"}
_SKIP = {"script", "style", "template", "noscript"}
_BREAK = {"p", "div", "br", "li", "ul", "ol", "table", "tr", "td", "th", "section", "article", "header", "footer", "blockquote", "pre", "figure", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip = 0
        self.figure: list[int] = []  # where the open figures' items begin
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self.skip += 1
        elif tag == "figure":
            self.flush()
            self.figure.append(len(self.items))
        elif tag == "figcaption" and self.figure:
            self.flush()
            self.caption = []
        elif tag in _MEDIA:
            own = dict(attrs)
            if ref := own.get(_MEDIA[tag]):
                self.flush()
                self.items.append({"kind": "media", "text": None, "ref": ref, "caption": own.get("alt") or None})
        elif tag in _BREAK:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure[-1] if self.figure else 0 :]:
                if item["kind"] == "media":
                    item["caption"] = text or item["caption"]
        elif tag == "figure" and self.figure:
            self.flush()
            self.figure.pop()
        elif tag in _BREAK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.words if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    """Ordered text and media items. A figure's caption goes with its media, else the alt text."""
    if not html:
        return []
    parser = _Items()
    parser.feed(html)
    parser.close()
    parser.flush()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def interleave(pages: DataFrame) -> DataFrame:
    """pages(id, html) to (id, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                items = [parse_html(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(items, pa.list_(_ITEM_ARROW))], names=["id", "items"])

    schema = T.StructType([pages.schema["id"], T.StructField("items", T.ArrayType(ITEM))])
    return pages.select("id", "html").mapInArrow(tidy(run), schema)


_STORED = "id long, digest string, n_bytes long, caption string, file string, offset long, length long"


def store_media(payloads: DataFrame, folder: str) -> DataFrame:
    """Write payloads(id, payload, caption) to the media store; a row for each says where it lies.

    digest is the padded payload's SHA-256; what a task has stored already it doesn't store again
    (it remembers a bounded number of digests).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/{uuid.uuid4().hex}.media"
        fs, path = locate(uri)
        out, at, known = None, 0, {}
        for whole in batches:
            for batch in slices(whole, "payload"):
                rows = []
                for key, payload, caption in zip(*(batch.column(c).to_pylist() for c in ("id", "payload", "caption")), strict=True):
                    samples = pad(payload or b"")
                    digest = hashlib.sha256(samples).digest()
                    if digest not in known:
                        if len(known) >= 200_000:
                            known = {}
                        image = encode_png(samples)
                        if out is None:
                            out = fs.open_output_stream(path, compression=None)
                        out.write(image)
                        known[digest] = (at, len(image))
                        at += len(image)
                    rows.append((key, digest.hex(), len(payload or b""), caption, uri, *known[digest]))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["id", "digest", "n_bytes", "caption", "file", "offset", "length"])
        if out is not None:
            out.close()

    return payloads.select("id", "payload", "caption").mapInArrow(tidy(run), _STORED)


def media_table(stored: DataFrame) -> DataFrame:
    """(digest, place): one place for each digest."""
    return stored.groupBy("digest").agg(F.min(F.struct("file", "offset", "length")).alias("place"))


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """(id, position, kind, text, ref, caption, place): items in rows, references resolved by digest."""
    items = sequences.select("id", F.explode("items").alias("i")).select("id", "i.*")
    digest = F.when(F.col("ref").startswith(SCHEME), F.substring("ref", len(SCHEME) + 1, 64))
    return items.withColumn("digest", digest).join(media, "digest", "left")


def read_features(media: DataFrame, parts: int) -> DataFrame:
    """Read every stored medium once, in the files' order, and derive what the samples say."""
    places = media.select("digest", "place.*").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    fields = [("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                rows = []
                for digest, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "file", "offset", "length")), strict=True):
                    image = files.read(file, offset, length)
                    samples = decode_png(image)
                    rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])
        files.close()

    return places.mapInArrow(tidy(run), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def sequences_of(resolved: DataFrame) -> DataFrame:
    """(id, items): the items of each id in order again, with their places."""
    item = F.struct("position", "kind", "text", "ref", "caption", "place")
    return resolved.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def page_of(caption: Column, digest: Column, n_bytes: Column) -> Column:
    """A page that shows one medium, of n_bytes before padding, with its caption between two texts.

    Captions are put in as they are: they must be HTML.
    """
    src = F.concat(F.lit(SCHEME), digest, F.lit("#bytes="), n_bytes.cast("string"))
    return F.concat(F.lit('<article><p>before</p><figure><img src="'), src, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure><p>after</p></article>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: each document's text as the payload of a medium on a page of its own, captioned by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    doc_id = F.col("doc_id").cast("long")
    payloads = docs.select(doc_id.alias("id"), F.col("text").cast("binary").alias("payload"), F.coalesce(doc_id.cast("string"), F.lit("none")).alias("caption"))
    stored = materialise(store_media(payloads, new_dir(spark, "media")), "media-stored")
    media = materialise(media_table(stored), "media-table")
    pages = stored.select("id", page_of(F.col("caption"), F.col("digest"), F.col("n_bytes")).alias("html"))
    items = resolve(interleave(pages), media).where("kind = 'media'")
    read = read_features(media, max(spark.sparkContext.defaultParallelism, media.count() // 10_000 + 1))
    own = items.select(F.when(F.col("caption") != "none", F.col("caption").cast("long")).alias("doc_id"), F.regexp_extract("ref", "#bytes=([0-9]+)", 1).cast("long").alias("n_bytes"), "digest")
    return own.join(read, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
