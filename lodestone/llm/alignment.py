"""Aligning two tokenizers: where both cut a text alike, and which tokens of one meet which of the other.

A text is read as a space and itself, by a byte-level BPE (A) and by a piece model (B). Both token lists
cover the same bytes, so their cumulative ends are two sorted lists; merging them gives the groups (a
group ends where both lists have an end) and the links (each piece between neighbouring ends belongs to
one token of either side, and two tokens overlap in exactly one such piece).

Neither tokenizer looks across a space between two characters that are none: A's splitting starts a new
part at it, and no piece of B holds a space after another character. So a text falls into chunks there, a
chunk is aligned once and remembered (in bounded memory), and new chunks are aligned together in one
text. Documents are taken in blocks of a bounded size. Each block gives its distinct id pairs with the
number of its documents that link them; Spark sums these by pair, joins the counts and each A id's
highest count back to the blocks' pairs, and a block's documents read them there. So a very common pair
moves once a block, never once a document. A block is one row of about a megabyte at most: what only
Python reads of it is packed into bytes, and its table has row groups of few blocks, since Spark holds
the rows of a row group at once.

Defined results: null and empty texts have no tokens, nor have texts whose tokens do not give back their
bytes (a U+2581, which B reads as a space): all counts 0, digest ''. Rows are documents: repeated ones
count each. Texts and unspaced runs of any length are read whole; an empty table gives no rows; columns
other than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release_memory, shared_dir

#: A chunk begins at such a space; Python's white space includes that of both tokenizers.
BORDER = re.compile(r"(?<=\S) (?=\S)")
#: What may be aligned together with other chunks: a space, then no white space at either end.
EVEN = re.compile(r" \S(?:.*\S)?", re.DOTALL)
SPACE = "▁"
#: Characters and rows of a block of documents, and characters of a text that are aligned at a time.
BLOCK_CHARS = 1 << 20
BLOCK_ROWS = 20_000
#: Characters of new chunks that are aligned as one text.
LEARNED_CHARS = 256 << 10
#: Chunks that a worker remembers.
REMEMBERED = 300_000
#: Both vocabularies have fewer ids: a pair is A's id times this, and B's.
IDS = 1 << 24

#: What is known of a pair of a block: its place there times this, twice its count, and whether it is the best.
PLACE = 1 << 36
#: A row group is closed at this size, though not before its 100th row.
ROW_GROUP = 8 << 20

_BLOCKS = "block long, doc_id binary, missing binary, counts binary, digests binary, first binary, pair binary, times binary, pairs array<long>, docs array<long>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 2)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text that begins with a space; None if either's bytes are not the text's."""
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        data = text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two-pointer merge of cumulative ends: (place in a, place in b, whether both end) at each distinct end."""
    at = np.union1d(ends_a, ends_b)
    i, j = np.searchsorted(ends_a, at), np.searchsorted(ends_b, at)
    return i, j, (ends_a[i] == at) & (ends_b[j] == at)


class Memory:
    """Aligned chunks by number; what a chunk has is found in arrays at that number."""

    def __init__(self, encoders: Encoders, remembered: int = REMEMBERED):
        self.encoders, self.remembered = encoders, remembered
        self.number: dict[str, int] = {}
        self.text: list[str | None] = []  # the groups of each chunk, None where bytes differ
        self.counts = np.zeros((0, 4), dtype=np.int64)
        self.start = np.zeros(1, dtype=np.int64)
        self.links = np.zeros(0, dtype=np.int64)
        self.used = np.zeros(0, dtype=np.int64)

    def _append(self, chunks: list[str], texts: list[str | None], counts: list[np.ndarray], links: list[np.ndarray]) -> None:
        for c in chunks:
            self.number[c] = len(self.number)
        self.text += texts
        self.counts = np.concatenate([self.counts, *counts])
        lengths = np.concatenate([x[:, 3] for x in counts])
        self.start = np.r_[self.start, self.start[-1] + np.cumsum(lengths)]
        self.links = np.concatenate([self.links, *links])
        self.used = np.r_[self.used, np.zeros(len(chunks), dtype=np.int64)]

    def _aligned(self, chunks: list[str], ids: tuple[np.ndarray, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups, counts and links of chunks whose ids follow each other; both tokenizers cut between them."""
        a, b = ids
        ends_a, ends_b = np.cumsum(self.encoders.a_size[a]), np.cumsum(self.encoders.b_size[b])
        i, j, both = merge(ends_a, ends_b)
        cuts = np.cumsum([len(c.encode()) for c in chunks])
        last_a, last_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
        group_a, group_b = i[both] + 1, j[both] + 1
        last_group = np.searchsorted(ends_a[group_a - 1], cuts) + 1
        last_link = np.searchsorted(np.maximum(ends_a[i] * both, 0)[both], cuts)  # place among the groups
        last_link = np.flatnonzero(both)[last_link] + 1
        counts = np.stack([np.diff(np.r_[0, x]) for x in (last_a, last_b, last_group, last_link)], axis=1)
        word_a, word_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        texts, p, q = [], 0, 0
        for x, y in zip(group_a.tolist(), group_b.tolist(), strict=True):
            texts.append(f"{','.join(word_a[p:x])}|{','.join(word_b[q:y])}")
            p, q = x, y
        bounds = [0, *last_group.tolist()]
        return [";".join(texts[m:n]) for m, n in zip(bounds, bounds[1:], strict=False)], counts, a[i] * IDS + b[j]

    def learn(self, chunks: list[str]) -> None:
        """Align chunks that are new: even ones as one text, others alone."""
        even = [c for c in chunks if EVEN.fullmatch(c) and SPACE not in c]
        ids = self.encoders.ids("".join(even)) if even else None
        if ids is None:
            even = []
        else:
            texts, counts, links = self._aligned(even, ids)
            self._append(even, texts, [counts], [links])
        known = set(even)
        for c in chunks:
            if c in known:
                continue
            ids = self.encoders.ids(c)
            if ids is None:
                self._append([c], [None], [np.zeros((1, 4), dtype=np.int64)], [])
            else:
                texts, counts, links = self._aligned([c], ids)
                self._append([c], texts, [counts], [links])

    def numbers(self, chunks: list[str]) -> np.ndarray:
        get = self.number.get
        found = list(map(get, chunks))
        if None in found:
            new, chars = [], 0
            for c in dict.fromkeys(c for c, k in zip(chunks, found, strict=True) if k is None):
                new.append(c)
                chars += len(c)
                if chars > LEARNED_CHARS:
                    self.learn(new)
                    new, chars = [], 0
            self.learn(new)
            found = list(map(get, chunks))
        return np.array(found, dtype=np.int64)

    def links_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of chunks one after the other, and how many each has."""
        n = self.counts[numbers, 3]
        at = np.repeat(self.start[numbers] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return self.links[at], n

    def forget(self) -> None:
        """When too many are known, keep those that were used most, half as many at most."""
        if len(self.number) <= self.remembered:
            return
        order = np.argsort(-self.used, kind="stable")[: self.remembered // 2]
        keep = np.sort(order[self.used[order] > 1])
        chunks = list(self.number)
        links, _ = self.links_of(keep)
        number, text, counts = [chunks[i] for i in keep], [self.text[i] for i in keep], self.counts[keep]
        self.number, self.text = {c: i for i, c in enumerate(number)}, text
        self.counts, self.links, self.start = counts, links, np.r_[0, np.cumsum(counts[:, 3])]
        self.used = self.used[keep] // 2


@functools.lru_cache(maxsize=1)
def worker_memory(byte_level: str, pieces: str, remembered: int) -> Memory:
    """One for all tasks of a Python worker: chunks stay known from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Memory(Encoders(byte_level, pieces), remembered)


def parts(text: str, size: int) -> Iterator[str]:
    """A space and the text, cut at borders of chunks after every `size` characters or more."""
    whole, at = " " + text, 0
    while len(whole) - at > size:
        m = BORDER.search(whole, at + size)
        if m is None:
            break
        yield whole[at : m.start()]
        at = m.start()
    yield whole[at:]


def chunks_of(part: str) -> list[str]:
    cut = BORDER.split(part)
    return [cut[0], *[" " + c for c in cut[1:]]]


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on: the bytes that the largest one needs, then each in as many."""
    most = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if most >> 8 * w == 0)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class Block:
    """What a block of documents has: totals, digests, and its distinct pairs with their documents."""

    def __init__(self, memory: Memory, texts: list[str | None], size: int = BLOCK_CHARS):
        self.memory, n = memory, len(texts)
        self.counts, self.digests = np.zeros((n, 4), dtype=np.int64), [""] * n
        doc, pair, times = [], [], []
        short, length = [], 0
        for k, t in enumerate(texts):
            if not t:
                continue
            if len(t) > size:
                found = self._long(k, t, size)
                if found is not None:
                    doc.append(np.full(len(found[0]), k))
                    pair.append(found[0])
                    times.append(found[1])
                continue
            short.append(k)
            length += len(t)
        for part in self._short(short, texts):
            for a, b in zip((doc, pair, times), part, strict=True):
                a.append(b)
        doc, pair, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (doc, pair, times))
        order = np.argsort(doc, kind="stable")
        self.doc, self.times = doc[order], times[order]
        self.pairs, self.pair = np.unique(pair[order], return_inverse=True)
        self.docs = np.bincount(self.pair, minlength=len(self.pairs))  # a document has a pair once
        self.first = np.searchsorted(self.doc, np.arange(n + 1))

    def _short(self, rows: list[int], texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, pair, times) of all texts together."""
        if not rows:
            return
        cut = [chunks_of(" " + texts[k]) for k in rows]
        numbers = self.memory.numbers([c for cs in cut for c in cs])
        self.memory.used += np.bincount(numbers, minlength=len(self.memory.used))
        bounds = np.r_[0, np.cumsum([len(c) for c in cut])]
        known, of = self.memory.text, numbers.tolist()
        good = np.ones(len(rows), dtype=bool)
        for k, row in enumerate(rows):
            groups = [known[c] for c in of[bounds[k] : bounds[k + 1]]]
            if None in groups:
                good[k] = False
            else:
                self.digests[row] = hashlib.sha256(";".join(groups).encode()).hexdigest()
        row_of = np.repeat(np.arange(len(rows)), np.diff(bounds))
        use = good[row_of]
        numbers, row_of = numbers[use], row_of[use]
        for c in range(4):
            self.counts[np.array(rows), c] = np.bincount(row_of, self.memory.counts[numbers, c], minlength=len(rows)).astype(np.int64)
        links, n = self.memory.links_of(numbers)
        pairs, local = np.unique(links, return_inverse=True)
        key, times = np.unique(np.repeat(row_of, n) * max(1, len(pairs)) + local, return_counts=True)
        yield np.array(rows)[key // max(1, len(pairs))], pairs[key % max(1, len(pairs))], times

    def _long(self, row: int, text: str, size: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(pair, times) of one text, part by part."""
        digest, total, begun = hashlib.sha256(), np.zeros(4, dtype=np.int64), False
        pairs, times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for part in parts(text, size):
            self.memory.forget()
            numbers = self.memory.numbers(chunks_of(part))
            self.memory.used += np.bincount(numbers, minlength=len(self.memory.used))
            groups = [self.memory.text[c] for c in numbers.tolist()]
            if None in groups:
                return None
            digest.update((";" * begun + ";".join(groups)).encode())
            begun = True
            total += self.memory.counts[numbers].sum(0)
            links, _ = self.memory.links_of(numbers)
            new, n = np.unique(links, return_counts=True)
            pairs, at = np.unique(np.r_[pairs, new], return_inverse=True)
            times = np.bincount(at, np.r_[times, n]).astype(np.int64)
        self.counts[row], self.digests[row] = total, digest.hexdigest()
        return pairs, times


def blocks(docs: DataFrame, byte_level: str, pieces: str, *, block_chars: int = BLOCK_CHARS, remembered: int = REMEMBERED) -> DataFrame:
    """A row for each block of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = worker_memory(byte_level, pieces, remembered)
        number = TaskContext.get().partitionId() << 33
        ids: list = []
        texts: list[str | None] = []
        chars = 0

        def row() -> pd.DataFrame:
            nonlocal number, chars
            memory.forget()
            b = Block(memory, texts, block_chars)
            known = np.array([i or 0 for i in ids], dtype="<i8").tobytes()
            digests = b"".join([bytes.fromhex(x) or bytes(32) for x in b.digests])
            out = pd.DataFrame({
                "block": [number], "doc_id": [known], "missing": [bytes(i is None for i in ids)], "counts": [packed(b.counts.ravel())], "digests": [digests],
                "first": [packed(b.first)], "pair": [packed(b.pair)], "times": [packed(b.times)], "pairs": [b.pairs], "docs": [b.docs],
            })
            ids.clear()
            texts.clear()
            number, chars = number + 1, 0
            return out

        try:
            for batch in batches:
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    if texts and (chars + len(text or "") > block_chars or len(texts) >= BLOCK_ROWS):
                        yield row()
                    ids.append(None if pd.isna(doc) else int(doc))
                    texts.append(text)
                    chars += len(text or "")
            if texts:
                yield row()
        finally:
            release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, _BLOCKS)


def per_document(joined: DataFrame) -> DataFrame:
    """The result rows of blocks with `found`: what is known of each of their pairs, as one number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                first, pair, times = unpacked(r.first), unpacked(r.pair), unpacked(r.times)
                found = np.asarray(r.found if r.found is not None else [], dtype=np.int64)
                known = np.zeros((2, len(found)), dtype=np.int64)
                known[:, found // PLACE] = found % PLACE // 2, found % 2
                n = len(r.missing)
                row = np.repeat(np.arange(n), np.diff(first))
                sums = np.zeros((2, n), dtype=np.int64)
                for s, k in zip(sums, known, strict=True):
                    np.add.at(s, row, times * k[pair])
                counts, none = unpacked(r.counts).reshape(n, 4), np.frombuffer(r.missing, dtype=bool)
                digests = [x.hex() if any(x) else "" for x in (r.digests[i : i + 32] for i in range(0, 32 * n, 32))]
                yield pd.DataFrame({
                    "doc_id": pd.arrays.IntegerArray(np.frombuffer(r.doc_id, dtype="<i8").copy(), none.copy()), "n_a": counts[:, 0], "n_b": counts[:, 1], "n_groups": counts[:, 2], "n_links": counts[:, 3],
                    "n_best": sums[1], "count_sum": sums[0], "groups_sha256": digests,
                })

    return joined.mapInPandas(run, _RESULT)


def pair_counts(held: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents a pair is linked, and whether no pair of its A id is in more."""
    n = held.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n"))
    n = materialise(n.withColumn("a", F.floor(F.col("pair") / IDS)), "alignment-pairs")
    top = n.groupBy("a").agg(F.max("n").alias("top"))
    return n.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, **options) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs(doc_id, text)."""
    shared_dir(docs.sparkSession)
    a, b = default_tokenizers()
    held = materialise(blocks(docs, byte_level or a, pieces or b, **options), "alignment-blocks", **{"parquet.block.size": ROW_GROUP, "compression": "zstd"})
    asked = held.select("block", F.posexplode("pairs").alias("at", "pair"))
    known = asked.join(pair_counts(held.select("pairs", "docs")), "pair")
    found = known.groupBy("block").agg(F.collect_list(F.col("at") * F.lit(PLACE) + F.col("n") * 2 + F.col("best")).alias("found"))
    return per_document(held.drop("pairs", "docs").join(found, "block", "left"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: groups, links and their counts of every document."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
