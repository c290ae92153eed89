import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import simhash
from lodestone.llm.components import components

from .conftest import collect


def fp(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=4):
    known = sorted({i for i, _ in rows if i is not None})
    own = [(i, fp(t)) for i, t in rows if i is not None]
    label = {i: i for i in known}
    changed = True
    while changed:
        changed = False
        for i, f in own:
            for j, g in own:
                if (i == j or bin(f ^ g).count("1") <= radius) and label[i] > label[j]:
                    label[i] = label[j]
                    changed = True
    return sorted(((i, format(fp(t), "016x"), None if i is None else label[i]) for i, t in rows), key=str)


def run(spark, documents, rows):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in collect(simhash.query(spark, documents(rows)))), key=str)


def test_query_equals_brute_force(spark, documents):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(6)]
    rows = []
    for i in range(60):
        text = base[i % 6].split()
        for _ in range(i // 12):
            text[rng.integers(120)] = str(rng.choice(words))
        rows.append((i * 3, " ".join(text)))
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "one"), (504, "ONE"), (505, "Ünï ÉX a b c d"), (None, base[0]), (506, base[0]), (506, base[0]), (507, "x " * 5000)]
    assert run(spark, documents, rows) == brute(rows)


def test_empty_table(spark, documents):
    assert run(spark, documents, []) == []


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_forest_equals_all_pairs(data):
    n = data.draw(st.integers(0, 40))
    rng = np.random.default_rng(data.draw(st.integers(0, 2**32)))
    radius = data.draw(st.integers(0, 10))
    words = np.repeat(rng.integers(0, 2**63, (1, 2), dtype=np.uint64), n, 0)
    for i in range(n):
        for b in rng.integers(0, 128, rng.integers(0, 12)):
            words[i, b // 64] ^= np.uint64(1 << int(b) % 64)
    key = rng.integers(0, 2, n).astype(np.uint64)
    a, b = simhash.forest_links(key, words, radius, block=16)
    label = np.arange(n)
    label[a] = b
    want = np.arange(n)
    for _ in range(n):
        for i in range(n):
            near = (np.bitwise_count(words ^ words[i]).sum(1) <= radius) & (key == key[i])
            want[near] = want[near].min()
    assert label.tolist() == want.tolist()


def test_every_pair_within_the_radius_shares_a_shard():
    masks = simhash.CONTRACT.masks()
    rng = np.random.default_rng(5)
    for _ in range(300):
        flips = 0
        for b in rng.choice(64, 4, replace=False):
            flips |= 1 << int(b)
        assert ((masks[:, 0] & np.uint64(flips)) == 0).any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (103, 101), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["root"] for r in components(df).collect()}
    assert found == {i: 0 for i in range(31)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("edits", [0, 1, 3])
def test_near_copies_go_and_others_stay(spark, documents, edits):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(40):
        text = [str(w) for w in rng.choice(words, 200)]
        rows.append((2 * i, " ".join(text)))
        for j in rng.choice(200, edits, replace=False):
            text[j] = "changed"
        rows.append((2 * i + 1, " ".join(text)))
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs, simhash.NEAR_COPIES).collect()}
    assert kept == {2 * i for i in range(40)}


def jaccard(a, b, n=5):
    a, b = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def exact(rows):
    label = list(range(len(rows)))
    changed = True
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = low
    return {rows[i][0] for i in range(len(rows)) if label[i] == i}


def kept_of(spark, documents, rows):
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    return sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs, simhash.NEAR_COPIES).collect())


@pytest.mark.parametrize(("block", "lead"), [(4, 0), (5, 28), (4096, 0)])
def test_a_group_of_any_size_is_split_exactly(spark, documents, monkeypatch, block, lead):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choice(words, 400).tolist()
    rows = []
    for i in range(40):  # copies of one template: some families are closer than 0.8, all of them about 0.7 to each other
        if i % 4 == 0 and i >= lead:
            text = base.copy()
            for j in rng.choice(400, 8, replace=False):
                text[j] = str(rng.choice(words))
        own = text.copy() if i >= lead else base.copy()
        own[int(rng.integers(400))] = f"x{i}"
        rows.append((i, " ".join(own)))
    want = exact(rows)
    assert len(want) > 1
    assert kept_of(spark, documents, rows) == sorted(want)


def test_pairs_at_the_border_are_told_apart_exactly(spark, documents):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5000)]
    rows, n = [], 104  # 100 shingles; k words changed at the end give Jaccard (100 - k) / (100 + k): 0.802 and 0.786
    for i in range(40):
        text = rng.choice(words, n).tolist()
        k = 11 + i % 2
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[: n - k] + [f"y{i}_{j}" for j in range(k)]))]
    want, kept = exact(rows), set(kept_of(spark, documents, rows))
    assert want <= kept and len(kept - want) <= 3  # none goes below 0.8; the fingerprints may miss a few
    assert len(want) == 60


def test_one_row_stays_of_repeated_and_missing_ids(spark, documents):
    rng = np.random.default_rng(5)
    a, b, c = (" ".join(f"w{i}" for i in rng.integers(0, 3000, 200)) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (None, c), (None, c), (None, b), (2, None), (None, None)]
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs, simhash.NEAR_COPIES).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, c), (2, None)], key=str)
