import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import packing

from .conftest import collect


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.default_tokenizer())


def check(rows, library, out, window=4096):
    """Every id in one piece, sequences gapless and within the window."""
    known = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for i, t in rows}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(known)
    for i, ids in known.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rest in places.values():
        at = 0
        for offset, length in sorted(rest):
            assert offset == at
            at += length
        assert at <= window
    return sum(n for rest in places.values() for _, n in rest) / len(places) / window


def test_query(spark, documents, library):
    rng = random.Random(1)
    words = ["alpha", "beta's", "Gamma", "δέλτα", "1234", "!!", "épée"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 700)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "word " * 9000), (203, "<|endoftext|> x"), (204, "same"), (205, "same"), (None, "no id")]
    assert check(rows, library, collect(packing.query(spark, documents(rows)))) > 0.95


def test_repeated_rows_are_packed_one_by_one(spark, documents):
    out = collect(packing.query(spark, documents([(1, "a b c")] * 3)))
    assert len(out) == 3 and len({(r["sequence_id"], r["offset"]) for r in out}) == 3


def test_empty_table(spark, documents):
    assert packing.query(spark, documents([])).count() == 0


def test_sequences_hold_the_ids(spark, documents, library):
    rows = [(1, "one two"), (2, "three " * 5000), (3, None)]
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    plan = packing.pack(docs).cache()
    ids = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, plan).collect()}
    assert all(len(x) == 4096 for x in ids.values())
    for r in plan.collect():
        own = library.encode(dict(rows)[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert ids[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == own[r["start"] : r["start"] + r["length"]]


def test_words_encode_as_the_library_does(library):
    rng = random.Random(2)
    pool = list("abcXYZ'  \n\t._-$%0129éÈßœŒŸĲıſ") + ["'s", "'re", "<|endoftext|>", "²", "ª", "中", "İ", "́", "\x1c", "\xa0", "’", "'ll", "Σ", "ς", "don't", "IT'S"]
    encoder = packing.WordTokenizer(packing.default_tokenizer(), remember=50)
    for _ in range(1500):
        text = "".join(rng.choices(pool, k=rng.randint(0, 30)))
        want = np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.encode([text]) == [want], text


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=7), st.integers(0, 60))
def test_fill_is_optimal(counts, capacity):
    sums = {0}
    for x, n in counts.items():
        sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= capacity}
    used = packing.fill(counts, capacity)
    assert sum(x * k for x, k in used.items()) == max(sums)
    assert all(0 < k <= counts[x] for x, k in used.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 50), max_size=20))
def test_patterns_use_every_rest_once(histogram):
    used = defaultdict(int)
    for p in packing.minimum_bin_slack(histogram, 64):
        assert sum(x * k for x, k in p.parts) <= 64
        for x, k in p.parts:
            used[x] += k * p.bins
    assert used == histogram
