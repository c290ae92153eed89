"""Packing documents into windows by minimum bin slack.

A document's tokens are cut into whole windows and a rest. The rests, known by their histogram of
lengths (at most window - 1 counts, whatever the corpus), are packed on the driver: each bin starts
with the longest rest left, and a bitset subset-sum over the lengths that remain finds the multiset
that comes closest to the window's capacity; its counts are found by backtracking, and the pattern
is used as often as the histogram allows. Documents then find their bin by their rank among rests of
equal length, so nothing but the histogram and the patterns is ever in one place.

Defined results: null text is empty; an empty document is its end token alone; repeated rows are
packed one by one; an empty table gives no rows; columns other than doc_id and text are not looked
at.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, slices, tidy

WINDOW = 4096
END = 2
#: Words whose ids a worker remembers, twice over: about 160 MB.
REMEMBERED = 400_000
#: Pieces of one length are ranked in parts of about this many.
PART_ROWS = 1_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of the word-level BPE, as little-endian unsigned 32-bit bytes.

    Its pieces never cross the words that its splitting pattern finds, so a word's ids are found
    once and remembered, in bounded memory. Texts with characters on which Python's and the
    library's normalisation or character classes may differ go to the library whole.
    """

    #: Printable ASCII, line breaks, tabs and letters up to U+024F, but for the numeric signs of
    #: Latin-1 and the dotted capital I; a text with a special token's opening is not plain either.
    PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-±´-¸º»¿-įı-ɏ]*")
    WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str, remember: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.library, self.remember = Tokenizer.from_file(path), remember
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Encode distinct words as one text; the library says which word each id belongs to."""
        coded = self.library.encode(" ".join(words), add_special_tokens=False)
        ids, of = np.array(coded.ids, dtype="<u4").tobytes(), np.array(coded.word_ids)
        cuts = (4 * np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]).tolist()
        parts = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.recent.update(zip(words, parts if len(parts) == len(words) else self._ids(words), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.recent) > self.remember:  # of two generations, words still in use come back
            self.recent, self.older = {}, self.recent
        split = [self.WORDS.findall(t.lower()) if self.PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        recent, older, left = self.recent, self.older, []
        for w in set().union(*[ws for ws in split if ws is not None]):
            if w not in recent:
                if w in older:
                    recent[w] = older[w]
                else:
                    left.append(w)
        for a in range(0, len(left), 2_000):
            self._learn(left[a : a + 2_000])
        get = recent.__getitem__
        return [b"".join(map(get, ws)) if ws is not None else self._ids([t])[0] for ws, t in zip(split, texts, strict=True)]


@functools.lru_cache(maxsize=1)
def worker_tokenizer(path: str, remember: int = REMEMBERED) -> WordTokenizer:
    """One for all tasks of a Python worker: its words stay known from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path, remember)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, remember: int = REMEMBERED) -> DataFrame:
    """Whole windows and the rest of every document.

    (doc_id, start, length, ids_crc32, doc_tokens); a document's rest, if any, comes last.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields)
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_tokenizer(tokenizer, remember)
        for whole in batches:
            for batch in slices(whole, "text"):
                out: list[list[int]] = [[], [], [], [], []]
                coded = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                for doc, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                    ids += end
                    n = len(ids) // 4
                    for a in range(0, n, window):
                        b = min(a + window, n)
                        for column, x in zip(out, (doc, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


@dataclass(frozen=True)
class Pattern:
    """A multiset of lengths (length, count), longest first, packed `bins` times."""

    parts: tuple[tuple[int, int], ...]
    bins: int


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of these lengths whose sum comes closest to the capacity, by a bitset subset-sum.

    Lengths are added longest first, each in binary portions of its count; the set of reachable sums
    after each portion is a bitset, by which the counts are traced back.
    """
    mask = (1 << capacity + 1) - 1
    reach, trail = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, portion = min(counts[length], capacity // length), 1
        while left and not reach >> capacity:
            take = min(portion, left)
            trail.append((length, take, reach))
            reach |= reach << take * length & mask
            left -= take
            portion *= 2
        if reach >> capacity:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= take * length
    return used


def minimum_bin_slack(histogram: dict[int, int], window: int = WINDOW) -> list[Pattern]:
    """Patterns that use every rest of the histogram exactly once."""
    left, out = {x: n for x, n in histogram.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fill({x: n for x, n in left.items() if n}, window - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        bins = min(left[x] // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= k * bins
            if not left[x]:
                del left[x]
        out.append(Pattern(tuple(sorted(used.items(), reverse=True)), bins))
    return out


def _places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length, in order of rank: first rank, first sequence, count in a bin, offset in the bin."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for length, k in p.parts:
            out.setdefault(length, []).append((ranks.get(length, 0), sequence, k, offset))
            ranks[length] = ranks.get(length, 0) + k * p.bins
            offset += k * length
        sequence += p.bins
    return {length: np.array(rows, dtype=np.int64) for length, rows in out.items()}


def rank_in_parts(df: DataFrame, group: str, order: list[Column], counts: DataFrame, part: str) -> DataFrame:
    """df with `rank` (from 0) in its group; a group's rows lie in parts, counts has (group, part, n)."""
    before = F.sum("n").over(Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(group, part, F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(group, part).orderBy(*order)).cast("long") - 1
    return df.withColumn("__own", own).join(starts, [group, part]).withColumn("rank", F.col("__start") + F.col("__own")).drop("__own", "__start")


def pack(docs: DataFrame, *, tokenizer: str | None = None, window: int = WINDOW, remember: int = REMEMBERED, seed: int = 42) -> DataFrame:
    """Where every piece of every document goes: the columns of pieces, sequence_id and offset."""
    cut = materialise(pieces(docs, tokenizer or default_tokenizer(), window, remember), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = minimum_bin_slack({x: n for x, n in histogram.items() if x < window}, window)
    places = _places(patterns)
    places[window] = np.array([[0, sum(p.bins for p in patterns), 1, 0]], dtype=np.int64)

    # a length has as many parts as its own pieces need, so the counts are far fewer than the pieces
    parts = F.element_at(F.array(*[F.lit(histogram.get(x, 0) // PART_ROWS + 1) for x in range(1, window + 1)]), F.col("length").cast("int"))
    key = [F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")]
    dealt = cut.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), *key), parts))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    ranked = rank_in_parts(dealt, "length", [F.xxhash64(F.lit(seed + 1), *key), *key], counts, "part").drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for x in np.unique(length):
                own = length == x
                table = places[int(x)]
                first, base, k, at = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1].T
                i = rank[own] - first
                sequence[own], offset[own] = base + i // k, at + i % k * x
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(docs: DataFrame, plan: DataFrame, *, tokenizer: str | None = None, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids array<int>), padded to the window.

    plan: what pack returned for these docs, whose doc_ids must be unique.
    """
    path = tokenizer or default_tokenizer()
    own = plan.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("parts"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(own, "doc_id").select("text", "parts")
    end = np.array([END], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_tokenizer(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                coded = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                rows = [(p["sequence_id"], p["offset"], (ids + end)[4 * p["start"] : 4 * (p["start"] + p["length"])]) for ids, parts in zip(coded, batch.column("parts").to_pylist(), strict=True) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["sequence_id", "offset", "ids"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), dtype="<u4")
        ids = np.concatenate([ids, np.full(window - len(ids), pad, dtype=np.uint32)]).astype(np.int32)
        return pa.table({"sequence_id": table.column("sequence_id")[:1], "ids": pa.array([ids.tolist()], pa.list_(pa.int32()))})

    return joined.mapInArrow(tidy(cut), "sequence_id long, offset long, ids binary").groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every piece of every document and its place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs.select("doc_id", "text"))
