"""Removing repeated passages with longest-previous-factor arrays.

A byte goes if a string of `length` bytes around it also starts earlier: in a smaller doc_id, or
earlier in the same document. One suffix array over the corpus cannot be built, so the corpus is cut
where equal strings are sure to meet:

1. Documents are written to the shared folder in compressed frames; all later steps name a frame.
2. Each window of `length` bytes has an anchor: its k-mer with the least hash. Equal windows have
   equal anchors at equal offsets. An anchor's context, the bytes of all windows that can hold it, is
   hashed too. Frames send (anchor hash, context hash, place) to buckets of the anchor hash, each
   pair once: a later place in the frame with the same pair is settled there and then.
3. A bucket keeps the first place of each pair; at all others the whole context repeats. Of an
   anchor hash with several contexts, the first places' contexts are wanted as text.
4. These texts meet by anchor hash. Each group joins them to segments in corpus order, sorts the
   suffixes by their first `length` bytes, takes the previous and next smaller positions in suffix
   order, and so has the longest previous factor of each position: the longer of its matches with
   the two. Where that is `length` or more, the string starts earlier too.
5. An anchor hash with more than HOT contexts (a common line in many surroundings) would make a group
   that no task can hold. Its contexts are split again, into the windows that hold the anchor, and
   these meet by their own hashes, spread over all buckets.
6. Each frame merges what was found for it.

Equality in steps 2, 3 and 5 is that of XXH3's 128 bits over the bytes of a context or window, whatever
the anchor's hash is (for 10^13 of them, a wrong match has a chance below 10^-12); in step 4, of the bytes.

Defined results: null text is empty; null doc_ids come first; rows with equal doc_id come in the
order of their frames and places there; documents shorter than `length` lose nothing; other columns
are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ranges, materialise, new_dir, slices, tidy, write_file

LENGTH = 100
#: Bytes of an anchor's k-mer.
ANCHOR = 32
#: Bytes of a frame (a longer document has its own) and of a file of frames.
FRAME = 4 << 20
FILE = 32 << 20
#: Windows looked at together; bytes of entries in a bucket, and of text in a suffix-sorted group.
BLOCK = 1 << 18
BUCKET_BYTES = 16 << 20
GROUP_BYTES = 2 << 20
#: Contexts of one anchor hash that still meet in one group.
HOT = 10_000

_NULL = np.iinfo(np.int64).min
_rng = np.random.default_rng(20)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_MOD = 1 << 64


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, dtype=np.uint64)], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Anchors:
    """Finds the anchors of a frame and hashes them and their contexts."""

    def __init__(self, length: int = LENGTH, k: int = ANCHOR):
        self.length, self.k, self.side = length, k, length - k
        n = BLOCK + 4 * length
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, _MOD), n)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of anchors, their hashes, and 128 bits of their contexts as two columns. starts, ends: the documents'."""
        out: list[list[np.ndarray]] = [[], []]
        length, k, side = self.length, self.k, self.side
        last_start = ends - length  # a document's windows start at starts..last_start
        for a in range(0, len(data), BLOCK):
            b = min(a + BLOCK, len(data))
            lo, hi = max(0, a - side), min(len(data), b + 2 * length)
            if hi - a < length:
                break
            # prefix sums of byte codes times powers: any range's hash is a difference, shifted
            prefix = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(_TABLE[data[lo:hi]] * self.up[: hi - lo], out=prefix[1:])
            n = min(b, hi - length + 1) - a  # windows that start in this block
            at = a - lo
            m = n + side  # k-mers that they can hold
            kmer = _mix((prefix[at + k : at + k + m] - prefix[at : at + m]) * self.down[at : at + m])
            low = np.uint64((1 << 20) - 1)
            best = (kmer & ~low) | np.arange(m, dtype=np.uint64)  # ties go to the leftmost
            width, want = 1, side + 1
            while 2 * width <= want:
                best = np.minimum(best[:-width], best[width:])
                width *= 2
            if width < want:
                best = np.minimum(best[: len(best) - (want - width)], best[want - width :])
            doc = np.searchsorted(starts, np.arange(a, a + n), side="right") - 1
            ok = np.arange(a, a + n) <= last_start[doc]
            if not ok.any():
                continue
            pick = np.unique((best[:n][ok] & low).astype(np.int64))
            where = pick + a
            for column, x in zip(out, (where, kmer[pick]), strict=True):
                column.append(x)
        if not out[0]:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
        where, h = (np.concatenate(x) for x in out)
        where, first = np.unique(where, return_index=True)
        own = np.searchsorted(starts, where, side="right") - 1
        left, right = np.maximum(starts[own], where - side), np.minimum(ends[own], where + length)
        return where, h[first], digests(data, left, right)


def digests(data: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """128 bits of the bytes of each range, as two columns."""
    raw = memoryview(data)
    found = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)])
    return np.frombuffer(found, dtype="<u8").reshape(-1, 2)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted keys differs from the one before."""
    new = np.zeros(len(keys[0]), dtype=bool)
    if len(new):
        new[0] = True
        for x in keys:
            new[1:] |= x[1:] != x[:-1]
    return new


def runs(cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true runs of a boolean array."""
    edge = np.diff(np.r_[False, cover, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each index, the nearest one before it with a smaller value, or -1."""
    out = np.arange(len(x)) - 1
    open_ = np.flatnonzero((out >= 0) & (x[out] >= x))
    while len(open_):
        out[open_] = out[out[open_]]
        p = out[open_]
        open_ = open_[(p >= 0) & (x[p] >= x[open_])]
    return out


def next_smaller(x: np.ndarray) -> np.ndarray:
    """For each index, the nearest one after it with a smaller value, or the length."""
    return len(x) - 1 - previous_smaller(x[::-1])[::-1]


def _dense(key: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones, fewer than 2^32."""
    order = np.argsort(key)
    out = np.empty(len(key), dtype=np.uint32)
    out[order] = np.cumsum(_first_of(key[order])) - 1
    return out


def factor_lengths(data: np.ndarray, length: int, valid: np.ndarray) -> np.ndarray:
    """The longest previous factor of each valid position, as far as `length`.

    valid: sorted positions with `length` bytes of their own segment left; earlier factors are those
    that start at valid positions too. Suffixes are sorted by prefix doubling as far as `length`
    needs, those equal that far by position. Of all earlier positions, the previous and the next
    smaller one in this order have the longest matches; the doubled ranks measure them.
    """
    if not len(valid):
        return valid
    n = len(data)

    def joined(rank: np.ndarray) -> np.ndarray:
        after = np.zeros(n, dtype=np.uint64)
        after[: max(n - width, 0)] = rank[width:]
        return rank.astype(np.uint64) << np.uint64(32) | after

    # up to four bytes, the bytes themselves are the rank
    ranks, width = [data.astype(np.uint32)], 1
    while 2 * width <= min(length, 4):
        after = np.zeros(n, dtype=np.uint32)
        after[: max(n - width, 0)] = ranks[-1][width:]
        ranks.append(ranks[-1] << np.uint32(8 * width) | after)
        width *= 2
    while 2 * width <= length:
        ranks.append(_dense(joined(ranks[-1])))
        width *= 2
    rank = ranks[-1]
    whole = _dense(rank[valid].astype(np.uint64) << np.uint64(32) | rank[valid + length - width])
    order = np.argsort(whole, kind="stable")
    suffix, group = valid[order], whole[order]
    out = np.zeros(len(valid), dtype=np.int64)
    for near in (previous_smaller(suffix), next_smaller(suffix)):
        has = np.flatnonzero((near >= 0) & (near < len(suffix)) & (out[order] < length))
        match = np.full(len(has), length, dtype=np.int64)
        part = np.flatnonzero(group[has] != group[near[has]])
        a, b = suffix[has[part]], suffix[near[has[part]]]  # they differ before `length`, so both stay inside
        for i in range(len(ranks) - 1, -1, -1):  # a match is less than `length` here: take widths that fit, twice the widest if need be
            for _ in range(2 if i == len(ranks) - 1 else 1):
                step = (ranks[i][a] == ranks[i][b]).astype(np.int64) << i
                a += step
                b += step
        match[part] = a - suffix[has[part]]
        out[order[has]] = np.maximum(out[order[has]], match)
    return out


def repeated_starts(data: np.ndarray, length: int, valid: np.ndarray) -> np.ndarray:
    """Valid positions whose longest previous factor has `length` bytes or more."""
    return valid[factor_lengths(data, length, valid) >= length]


def _read_frame(files: Ranges, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A frame's bytes; its documents' ids, starts and ends."""
    raw = pa.Codec("zstd").decompress(files.read(row["file"], row["at"], row["stored"]), row["bytes"]) if row["bytes"] else b""
    sizes = np.frombuffer(row["sizes"], dtype="<i8")
    ends = np.cumsum(sizes)
    return np.frombuffer(raw, dtype=np.uint8), np.frombuffer(row["ids"], dtype="<i8"), ends - sizes, ends


_FRAME_COLUMNS = "frame long, file string, at long, stored long, bytes long, ids binary, sizes binary"


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write docs(doc_id, text) in frames; one row a frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = pa.Codec("zstd", compression_level=1), TaskContext.get().partitionId()
        rows: list[tuple] = []
        texts: list[bytes] = []
        ids: list[int] = []
        frames: list[bytes] = []
        held = written = number = 0
        uri = f"{folder}/{uuid.uuid4().hex}.zst"

        def frame() -> None:
            nonlocal texts, ids, held, written, number
            raw = b"".join(texts)
            packed = codec.compress(raw, asbytes=True) if raw else b""
            frames.append(packed)
            rows.append((part << 32 | number, uri, written, len(packed), len(raw), np.array(ids, dtype="<i8").tobytes(), np.array([len(t) for t in texts], dtype="<i8").tobytes()))
            written += len(packed)
            number += 1
            texts, ids, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, frames, written, uri
            write_file(uri, b"".join(frames))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["frame", "file", "at", "stored", "bytes", "ids", "sizes"])
            rows, frames, written, uri = [], [], 0, f"{folder}/{uuid.uuid4().hex}.zst"

        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    text = text or b""
                    if texts and held + len(text) > FRAME:
                        frame()
                    texts.append(text)
                    ids.append(_NULL if doc is None else doc)
                    held += len(text)
                    if written >= FILE:
                        yield from flush()
        if texts:
            frame()
        if rows:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), _FRAME_COLUMNS)


_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("frame", pa.int64()), ("entries", pa.binary())])
#: Kinds of rows: anchors or windows to compare; places of anchors whose context repeats; places of
#: anchors whose context is wanted, with the anchor's hash; covered ranges; places of hot anchors,
#: with the anchor's hash; windows that repeat.
COMPARE, REPEATS, WANTED, COVERED, SPLIT, WINDOW = range(6)


def _rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROWS)], schema=_ROWS)


def _anchor_rows(buckets: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, finder = Ranges(), Anchors(length, k)
        for batch in batches:
            for row in batch.to_pylist():
                data, ids, starts, ends = _read_frame(files, row)
                full = ends > starts
                ids, starts, ends = ids[full], starts[full], ends[full]
                if not len(ids):
                    continue
                where, h, c = finder.find(data, starts, ends)
                own = np.searchsorted(starts, where, side="right") - 1
                turn = np.empty(len(ids), dtype=np.int64)
                turn[np.argsort(ids, kind="stable")] = np.arange(len(ids))
                order = np.lexsort((where, turn[own], c[:, 1], c[:, 0], h))
                first = _first_of(h[order], c[order, 0], c[order, 1])
                rows = []
                if not first.all():
                    rows.append((row["frame"] % buckets, REPEATS, row["frame"], where[order[~first]].astype("<i8").tobytes()))
                keep = order[first]
                bucket = (h[keep] >> np.uint64(20)) % np.uint64(buckets)
                by = np.argsort(bucket, kind="stable")
                keep, bucket = keep[by], bucket[by].astype(np.int64)
                for part in np.split(np.arange(len(keep)), np.flatnonzero(np.diff(bucket)) + 1) if len(keep) else []:
                    i = np.sort(keep[part])
                    # column by column: so the shuffle's compression sees the documents' runs
                    entries = _entries(h[i], c[i], ids[own[i]], where[i])
                    rows.append((int(bucket[part[0]]), COMPARE, row["frame"], entries))
                if rows:
                    yield _rows_batch(rows)
        files.close()

    return run


_BYTES = 36


def _entries(h: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray) -> bytes:
    return b"".join(x.astype(kind).tobytes() for x, kind in ((h, "<u8"), (c[:, 0], "<u8"), (c[:, 1], "<u8"), (doc, "<i8"), (at, "<u4")))


def _compare(repeated: int, contexts: bool):
    """A bucket: settle repeated pairs; with contexts, ask for those of anchors that have several."""

    def run(table: pa.Table) -> pa.Table:
        out, h, c, e, doc, frame, at = [], [], [], [], [], [], []
        for kind, of, blob in zip(table.column("kind").to_pylist(), table.column("frame").to_pylist(), table.column("entries").to_pylist(), strict=True):
            if kind != COMPARE:
                out.append((kind, of, blob))
                continue
            n = len(blob) // _BYTES
            h.append(np.frombuffer(blob, "<u8", n))
            c.append(np.frombuffer(blob, "<u8", n, 8 * n))
            e.append(np.frombuffer(blob, "<u8", n, 16 * n))
            doc.append(np.frombuffer(blob, "<i8", n, 24 * n))
            at.append(np.frombuffer(blob, "<u4", n, 32 * n).astype(np.int64))
            frame.append(np.full(n, of, dtype=np.int64))

        def tell(kind: int, pick: np.ndarray) -> None:
            by = np.flatnonzero(pick)
            by = by[np.argsort(frame[by], kind="stable")]
            for i in np.split(by, np.flatnonzero(np.diff(frame[by])) + 1) if len(by) else []:
                body = at[i].astype("<i8").tobytes() + (h[i].astype("<u8").tobytes() if kind in (WANTED, SPLIT) else b"")
                out.append((kind, int(frame[i[0]]), body))

        if h:
            h, c, e, doc, frame, at = (np.concatenate(x) for x in (h, c, e, doc, frame, at))
            order = np.lexsort((at, frame, doc, e, c, h))
            h, c, e, frame, at = h[order], c[order], e[order], frame[order], at[order]
            first = _first_of(h, c, e)
            tell(repeated, ~first)
            if contexts:  # firsts of hashes that have several contexts
                h, frame, at = h[first], frame[first], at[first]
                start = np.flatnonzero(_first_of(h))
                size = np.diff(np.r_[start, len(h)])
                size = np.repeat(size, size)
                tell(WANTED, (size > 1) & (size <= HOT))
                tell(SPLIT, size > HOT)
        return pa.table({"kind": pa.array([r[0] for r in out], pa.int32()), "frame": pa.array([r[1] for r in out], pa.int64()), "entries": pa.array([r[2] for r in out], pa.binary())})

    return run


def _window_rows(buckets: int, length: int, k: int):
    """Of each frame, the windows that hold a hot anchor, dealt by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, side = Ranges(), length - k
        for batch in batches:
            for row in batch.to_pylist():
                data, ids, starts, ends = _read_frame(files, row)
                full = ends > starts
                ids, starts, ends = ids[full], starts[full], ends[full]
                anchors = np.concatenate([np.frombuffer(x, "<i8", len(x) // 16) for x in row["entries"]])
                own = np.searchsorted(starts, anchors, side="right") - 1
                turn = np.empty(len(ids), dtype=np.int64)
                turn[np.argsort(ids, kind="stable")] = np.arange(len(ids))
                for part in np.array_split(np.arange(len(anchors)), len(anchors) // 5_000 + 1):
                    at = (anchors[part, None] + np.arange(-side, 1)).ravel()
                    doc = np.repeat(own[part], side + 1)
                    fits = (at >= starts[doc]) & (at + length <= ends[doc])
                    at, once = np.unique(at[fits], return_index=True)
                    doc = doc[fits][once]
                    c = digests(data, at, at + length)
                    h = c[:, 0]
                    order = np.lexsort((at, turn[doc], c[:, 1], h))
                    first = _first_of(h[order], c[order, 1])
                    again = np.sort(at[order[~first]])
                    rows = [(row["frame"] % buckets, WINDOW, row["frame"], again.astype("<i8").tobytes())] if len(again) else []
                    keep = order[first]
                    bucket = (h[keep] >> np.uint64(20)) % np.uint64(buckets)
                    by = np.argsort(bucket, kind="stable")
                    keep, bucket = keep[by], bucket[by].astype(np.int64)
                    for p in np.split(np.arange(len(keep)), np.flatnonzero(np.diff(bucket)) + 1) if len(keep) else []:
                        i = np.sort(keep[p])
                        rows.append((int(bucket[p[0]]), COMPARE, row["frame"], _entries(h[i], c[i], ids[doc[i]], at[i])))
                    if rows:
                        yield _rows_batch(rows)
        files.close()

    return run


_HEAD = np.dtype([("doc", "<i8"), ("frame", "<i8"), ("lo", "<i8"), ("n", "<i8")])


def _context_rows(groups: int, length: int, k: int):
    """Of each frame, the wanted contexts' texts, dealt by anchor hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, side = Ranges(), length - k
        for batch in batches:
            for row in batch.to_pylist():
                data, ids, starts, ends = _read_frame(files, row)
                full = ends > starts
                ids, starts, ends = ids[full], starts[full], ends[full]
                at = np.concatenate([np.frombuffer(x, "<i8", len(x) // 16) for x in row["entries"]])
                h = np.concatenate([np.frombuffer(x, "<u8", len(x) // 16, len(x) // 2) for x in row["entries"]])
                group = ((h >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
                order = np.lexsort((at, group))
                at, group = at[order], group[order]
                own = np.searchsorted(starts, at, side="right") - 1
                lo, hi = np.maximum(starts[own], at - side), np.minimum(ends[own], at + length)
                # contexts of a group that overlap become one segment
                new = _first_of(group, own)
                new[1:] |= lo[1:] > hi[:-1]
                a = np.flatnonzero(new)
                head = np.empty(len(a), dtype=_HEAD)
                b = np.r_[a[1:], len(at)] - 1
                head["doc"], head["frame"], head["lo"], head["n"] = ids[own[a]], row["frame"], lo[a], hi[b] - lo[a]
                parts = np.split(np.arange(len(a)), np.flatnonzero(np.diff(group[a])) + 1)
                rows = []
                for p in parts:
                    body = b"".join(data[s["lo"] : s["lo"] + s["n"]].tobytes() for s in head[p])
                    rows.append((int(group[a[p[0]]]), len(p), head[p].tobytes() + body))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "n", "entries"])
        files.close()

    return run


def _factors(length: int):
    def run(table: pa.Table) -> pa.Table:
        heads, texts = [], []
        for n, blob in zip(table.column("n").to_pylist(), table.column("entries").to_pylist(), strict=True):
            head = np.frombuffer(blob, _HEAD, n)
            heads.append(head)
            cuts = np.r_[0, np.cumsum(head["n"])] + n * _HEAD.itemsize
            texts += [blob[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        head = np.concatenate(heads)
        order = np.lexsort((head["lo"], head["frame"], head["doc"]))
        head = head[order]
        # a document's segments come from one frame's row of this group, so they don't overlap
        data = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        ends = np.cumsum(head["n"])
        starts = ends - head["n"]
        segment = np.repeat(np.arange(len(head)), head["n"])
        every = np.arange(len(data))
        found = repeated_starts(data, length, every[ends[segment] - every >= length])
        frame = head["frame"][segment[found]]
        at = head["lo"][segment[found]] + found - starts[segment[found]]
        out = []
        by = np.lexsort((at, frame))
        for i in np.split(by, np.flatnonzero(np.diff(frame[by])) + 1) if len(by) else []:
            a = at[i]
            new = np.r_[True, a[1:] > a[:-1] + length]
            low, high = a[new], a[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]] + length
            out.append((COVERED, int(frame[i[0]]), low.astype("<i8").tobytes() + high.astype("<i8").tobytes()))
        return pa.table({"kind": pa.array([r[0] for r in out], pa.int32()), "frame": pa.array([r[1] for r in out], pa.int64()), "entries": pa.array([r[2] for r in out], pa.binary())})

    return run


def _remove(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, side = Ranges(), length - k
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for row in batch.to_pylist():
                data, ids, starts, ends = _read_frame(files, row)
                change = np.zeros(len(data) + 1, dtype=np.int32)
                solid = np.flatnonzero(ends > starts)
                for x in row["found"] or []:
                    if x["kind"] == COVERED:
                        low, high = np.frombuffer(x["entries"], "<i8").reshape(2, -1)
                    elif x["kind"] == WINDOW:
                        low = np.frombuffer(x["entries"], "<i8")
                        high = low + length
                    else:
                        at = np.frombuffer(x["entries"], "<i8")
                        own = solid[np.searchsorted(starts[solid], at, side="right") - 1]
                        low, high = np.maximum(starts[own], at - side), np.minimum(ends[own], at + length)
                    np.add.at(change, low, 1)
                    np.add.at(change, high, -1)
                cover = np.cumsum(change[:-1]) > 0
                for i in range(0, len(ids), 512):
                    kept, spans = [], []
                    for a, b in zip(starts[i : i + 512], ends[i : i + 512], strict=True):
                        own = cover[a:b]
                        low, high = runs(own)
                        spans.append([{"start": s, "end": e} for s, e in zip(low.tolist(), high.tolist(), strict=True)])
                        kept.append(data[a:b][~own].tobytes() if len(low) else data[a:b].tobytes())
                    docs = ids[i : i + 512]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == _NULL), pa.array(ends[i : i + 512] - starts[i : i + 512], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])
        files.close()

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed spans [start, end) and the bytes that stay."""
    spark = docs.sparkSession
    frames = materialise(store(docs, new_dir(spark, "lpf-store")), "lpf-frames")
    total = frames.agg(F.sum("bytes")).first()[0] or 0
    least = spark.sparkContext.defaultParallelism
    buckets = max(least, total * 2 // (length - anchor) * _BYTES // BUCKET_BYTES + 1)
    # frames are few, wide rows: dealt evenly, since files hold very different numbers of them
    spread = frames.repartition(max(least, total // (4 * FRAME) + 1), "frame")
    told = "kind int, frame long, entries binary"
    settled = materialise(spread.mapInArrow(tidy(_anchor_rows(buckets, length, anchor)), "bucket int, kind int, frame long, entries binary").groupBy("bucket").applyInArrow(_compare(REPEATS, True), told), "lpf-settled")
    sizes = {r["kind"]: r["n"] // 16 for r in settled.groupBy("kind").agg(F.sum(F.octet_length("entries")).alias("n")).collect()}

    def asked(kind: int) -> DataFrame:
        return frames.join(settled.where(F.col("kind") == kind).groupBy("frame").agg(F.collect_list("entries").alias("entries")), "frame")

    groups = max(least, sizes.get(WANTED, 0) * (2 * length - anchor) // GROUP_BYTES + 1)
    factors = asked(WANTED).mapInArrow(tidy(_context_rows(groups, length, anchor)), "bucket int, n long, entries binary").groupBy("bucket").applyInArrow(_factors(length), told)
    every = settled.where(F.col("kind") == REPEATS).unionByName(factors)
    if SPLIT in sizes:
        windows = max(least, sizes[SPLIT] * (length - anchor + 1) * _BYTES // BUCKET_BYTES + 1)
        split = asked(SPLIT).mapInArrow(tidy(_window_rows(windows, length, anchor)), "bucket int, kind int, frame long, entries binary")
        every = every.unionByName(split.groupBy("bucket").applyInArrow(_compare(WINDOW, False), told))
    found = every.groupBy("frame").agg(F.collect_list(F.struct("kind", "entries")).alias("found"))
    return frames.join(found, "frame", "left").mapInArrow(tidy(_remove(length, anchor)), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: what every document loses, and the digest of what it keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
