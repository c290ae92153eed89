"""Texts longer than a slice, clashing columns, repeated rows: the operators and stages that other tests leave out."""

import hashlib
import random

import numpy as np

from lodestone.llm import lpf, media, mixing, packing, simhash

from .conftest import collect
from .test_packing import Tokenizer, check

LONG = 2_500_000


def long_text(seed, n=LONG):
    rng = random.Random(seed)
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=n))


def plain_fingerprint(text, words=4):
    h = simhash.shingle_hashes(text.encode(), words)
    bits = 0
    for b in range(64):
        if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h):
            bits |= 1 << b
    return f"{bits:016x}"


def test_fingerprints_of_very_long_texts(spark, documents):
    rows = [(1, long_text(1)), (2, "short one"), (3, long_text(1) + " end"), (4, None)]
    out = {r["doc_id"]: r for r in collect(simhash.query(spark, documents(rows)))}
    for i, t in rows[:3]:
        assert out[i]["fingerprint"] == plain_fingerprint(t)
    assert out[1]["component_id"] == out[3]["component_id"] == 1


def test_rows_of_one_doc_id_are_linked_by_their_texts_only(spark, documents):
    a, b, c = (long_text(i, 2000) for i in (2, 3, 4))
    out = collect(simhash.query(spark, documents([(5, a), (5, b), (3, b), (9, c)])))
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(3, 3), (5, 3), (5, 5), (9, 9)]


def test_repeats_in_very_long_texts(spark, documents):
    block = long_text(5, LONG // 2)
    out = {r["doc_id"]: r for r in collect(lpf.query(spark, documents([(1, block + block), (2, block[1000:1300]), (3, block[:99])])))}
    assert (out[1]["n_removed"], out[1]["n_spans"]) == (len(block), 1)
    assert out[1]["kept_sha256"] == hashlib.sha256(block.encode()).hexdigest()
    assert (out[2]["n_removed"], out[3]["n_removed"]) == (300, 0)


def test_media_of_very_long_texts(spark, documents):
    text = long_text(6)
    (row,) = collect(media.query(spark, documents([(1, text)])))
    assert row["payload_sha256"] == hashlib.sha256(media.pad(text.encode())).hexdigest() and row["n_bytes"] == LONG


def test_sizes_and_pieces_of_very_long_texts(spark, documents):
    rows = [(1, long_text(7)), (2, "a few words"), (3, "x" * LONG)]
    d = documents(rows)
    sizes = {r["doc_id"]: r["size"] for r in collect(mixing.query(spark, d))}
    assert sizes == {i: len(t.split()) for i, t in rows}
    check(rows, Tokenizer.from_file(packing.default_tokenizer()), collect(packing.query(spark, d)))


def test_stages_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "d", "size", "phase", "times", "copies", "__row", "node", "group", "fp", "digest", "best", "of", "level", "several", "a.b"]
    rows = [(i, f"some words of text number {i} " * 5, f"s{i % 2}", *[f"{c}{i}" for c in names[3:]]) for i in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    for made in (simhash.drop_near_duplicates(docs, simhash.NEAR_COPIES), mixing.repeat_documents(docs)):
        assert made.columns == names
        got = {tuple(r) for r in made.collect()}
        assert got and got <= set(rows)
    assert simhash.drop_near_duplicates(docs, simhash.NEAR_COPIES).count() == 12


def test_repeated_rows_share_their_copies(spark, documents):
    rows = [(None, "w " * 10, "s0")] * 40 + [(7, "w " * 10, "s0")] * 25 + [(i, "w " * 10, "s1") for i in range(100, 135)]
    d = documents(rows)
    want = mixing.water_fill({"s0": 650, "s1": 350})
    out = collect(mixing.query(spark, d))
    assert len(out) == len(rows)
    taken = {650: 0, 350: 0}
    for r in out:
        assert r["taken"] in (0, 10, 20, 30)
        taken[r["source_size"]] += r["taken"]
    assert abs(taken[650] - want["s0"]) <= 10 and abs(taken[350] - want["s1"]) <= 10
    for key in (None, 7):  # evenly within a group
        own = sorted(r["taken"] for r in out if r["doc_id"] == key)
        assert own[-1] - own[0] <= 10
    docs = spark.read.parquet(d + "/documents.parquet")
    words = {r["source"]: 0 for r in docs.collect()}
    for r in mixing.repeat_documents(docs).collect():
        words[r["source"]] += len(r["text"].split())
    assert abs(words["s0"] - want["s0"]) <= 40 and abs(words["s1"] - want["s1"]) <= 10
