import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import lpf

from .conftest import collect


def brute(rows, length=100):
    """rows in corpus order: (doc_id, bytes)."""
    seen, out = set(), []
    for i, b in rows:
        cover = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                cover[p : p + length] = True
            seen.add(s)
        starts, _ = lpf.runs(cover)
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~cover])
        out.append((i, len(b), int(cover.sum()), len(starts), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, documents, rows):
    out = collect(lpf.query(spark, documents(rows)))
    return sorted((tuple(r[k] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out), key=str)


def texts(seed, n):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(2, 7))) for _ in range(300)]

    def prose(k):
        return " ".join(rng.choice(words, k))

    shared = [prose(40) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [prose(rng.integers(1, 60))]
        for _ in range(rng.integers(0, 3)):
            s = shared[rng.integers(4)]
            a = rng.integers(0, 20)
            parts += [s[a : len(s) - rng.integers(0, 20)], prose(rng.integers(1, 30))]
        out.append((i, " ".join(parts)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, documents, seed):
    rows = texts(seed, 60)
    rows += [(100, None), (101, ""), (102, "short"), (103, "x" * 99), (104, "x" * 100), (105, "x" * 5000), (106, "ab" * 300), (107, rows[3][1]), (108, rows[3][1]), (109, rows[5][1] + rows[5][1])]
    want = brute([(i, (t or "").encode()) for i, t in sorted(rows)])
    assert run(spark, documents, rows[::-1]) == sorted(want, key=str)


def test_frames_and_blocks_do_not_matter(spark, documents, monkeypatch):
    rows = texts(3, 40)
    want = brute([(i, t.encode()) for i, t in rows])
    monkeypatch.setattr(lpf, "BLOCK", 300)
    monkeypatch.setattr(lpf, "FRAME", 2000)
    finder = lpf.Anchors()
    data = np.frombuffer("".join(t for _, t in rows).encode(), dtype=np.uint8)
    ends = np.cumsum([len(t.encode()) for _, t in rows])
    small = finder.find(data, np.r_[0, ends[:-1]], ends)
    monkeypatch.setattr(lpf, "BLOCK", 1 << 18)
    large = lpf.Anchors().find(data, np.r_[0, ends[:-1]], ends)
    assert all(np.array_equal(a, b) for a, b in zip(small, large, strict=True))
    assert run(spark, documents, rows) == sorted(want, key=str)


def test_null_ids_come_first_and_repeated_ids_are_ordered(spark, documents):
    text = "abcdefghij klmnop " * 3 + "".join(map(str, range(60)))
    out = run(spark, documents, [(5, text), (None, text), (5, text)])
    removed = {i: sorted(r[2] for r in out if r[0] == i) for i in (None, 5)}
    assert removed == {None: [0], 5: [len(text), len(text)]}


def test_empty_table(spark, documents):
    assert run(spark, documents, []) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.integers(1, 12))
def test_longest_previous_factors(values, length):
    data = np.array(values, dtype=np.uint8)
    valid = np.arange(max(0, len(data) - length + 1))
    want = [i for i in valid if any(np.array_equal(data[i : i + length], data[j : j + length]) for j in range(i))]
    assert lpf.repeated_starts(data, length, valid).tolist() == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 24))
def test_factor_lengths_are_those_of_all_earlier_positions(values, length):
    data = np.array(values, dtype=np.uint8)
    valid = np.arange(max(0, len(data) - length + 1))

    def match(i, j):
        n = 0
        while n < length and data[i + n] == data[j + n]:
            n += 1
        return n

    want = [max((match(i, j) for j in range(i)), default=0) for i in valid]
    assert lpf.factor_lengths(data, length, valid).tolist() == want


@pytest.mark.parametrize("hot", [1, 5])
def test_hot_anchors_are_split_into_windows(spark, documents, monkeypatch, hot):
    rng = np.random.default_rng(6)
    line = "this very line of a hundred bytes or so is found in each of the documents, with other words around it"

    def word():
        return "".join(rng.choice(list("abcdef"), 4))

    rows = [(i, f"{word()} {word()} {line[: 60 + i % 40]} {word()} {line[i % 30 :]}{word()}") for i in range(80)] + texts(5, 20)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    monkeypatch.setattr(lpf, "HOT", hot)
    assert run(spark, documents, rows) == sorted(brute([(i, t.encode()) for i, t in rows]), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40))
def test_smaller_values(values):
    x = np.array(values, dtype=np.int64)
    before = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(len(x))]
    after = [min((j for j in range(i + 1, len(x)) if x[j] < x[i]), default=len(x)) for i in range(len(x))]
    assert lpf.previous_smaller(x).tolist() == before and lpf.next_smaller(x).tolist() == after


def test_contexts_are_told_apart_by_their_bytes():
    """A context's 128 bits are of its bytes alone: one other byte, and nothing of the anchor's hash remains equal."""
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    ends = np.array([2000, 5000])
    starts = np.r_[0, ends[:-1]]
    where, h, c = lpf.Anchors().find(data, starts, ends)
    side = lpf.LENGTH - lpf.ANCHOR
    for at, own in zip(where.tolist(), c, strict=True):
        d = int(np.searchsorted(starts, at, side="right")) - 1
        context = data[max(starts[d], at - side) : min(ends[d], at + lpf.LENGTH)].tobytes()
        assert own.tobytes() == lpf.xxhash.xxh3_128_digest(context)
    assert len(where) == len(h) and len(np.unique(c[:, 0])) == len(np.unique(c[:, 1])) == len(where)
