"""Aligned tokenizers against a plain two-pointer walk over the libraries' own tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import alignment

from .conftest import collect

ENCODERS = alignment.Encoders(*alignment.default_tokenizers())


def plain_tokens(text):
    """(a ids, b ids, groups, links) of a text, None without tokens."""
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = ENCODERS.a.encode(" " + text, add_special_tokens=False).ids, ENCODERS.b.encode(text)
    pieces_a, pieces_b = [ENCODERS.a_bytes[i] for i in a], [ENCODERS.b_bytes[i] for i in b]
    if b"".join(pieces_a) != whole or b"".join(pieces_b) != whole:
        return None
    groups, links, i, j, end_a, end_b = [([], [])], [], 0, 0, len(pieces_a[0]), len(pieces_b[0])
    groups[-1][0].append(a[0])
    groups[-1][1].append(b[0])
    while True:
        links.append((a[i], b[j]))
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a and step_b:
            if i + 1 == len(a):
                break
            groups.append(([], []))
        if step_a:
            i += 1
            end_a += len(pieces_a[i])
            groups[-1][0].append(a[i])
        if step_b:
            j += 1
            end_b += len(pieces_b[j])
            groups[-1][1].append(b[j])
    return a, b, groups, links


def plain(rows):
    tokens = [plain_tokens(t) for _, t in rows]
    count = Counter(p for t in tokens if t for p in set(t[3]))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for (doc, _), t in zip(rows, tokens, strict=True):
        if t is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = t
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(count[p] == top[p[0]] for p in links)
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(df):
    return sorted((tuple(r[c] for c in NAMES) for r in collect(df)), key=repr)


def odd_texts(seed, n):
    rng = random.Random(seed)
    bits = ["word", " ", "  ", "\n", "\t", "naïve", "日本語", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x0A>", "'s", "'ll", "123", "4.5", " ", "\x1c", "é", "é", "😀", "…", "\r\n", "a", "the", "Ünïc", "\x00", "　", "?!", " the", " and"]
    return ["".join(rng.choices(bits, k=rng.randrange(0, 30))) for _ in range(n)]


EDGES = [None, "", " ", "  ", "\n", "a", " a", "a ", "▁", "x ▁y z", "a▁ b", "<|endoftext|>", "<s> </s>", "  x", "x \x1c y", "a" * 3000, "é" * 1000, " " * 500, "x\n \ny"]


@pytest.mark.parametrize(("block_chars", "remembered"), [(alignment.BLOCK_CHARS, alignment.REMEMBERED), (60, 20), (5, 4)])
def test_against_a_plain_walk(spark, documents, block_chars, remembered):
    texts = EDGES + odd_texts(block_chars, 150)
    rows = list(enumerate(texts)) + [(None, "the word"), (3, "the word"), (3, "the word")]
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    assert result(alignment.align(docs, block_chars=block_chars, remembered=remembered)) == plain(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" \n\t.'ae▁")), max_size=60), min_size=1, max_size=4))
def test_chunks_give_what_whole_texts_give(texts):
    block = alignment.Block(alignment.Memory(ENCODERS), texts, 40)
    for k, t in enumerate(texts):
        want = plain_tokens(t)
        if want is None:
            assert block.counts[k].tolist() == [0, 0, 0, 0] and block.digests[k] == ""
            continue
        a, b, groups, links = want
        assert block.counts[k].tolist() == [len(a), len(b), len(groups), len(links)]
        own = slice(block.first[k], block.first[k + 1])
        got = {(p // alignment.IDS, p % alignment.IDS): n for p, n in zip(block.pairs[block.pair[own]].tolist(), block.times[own].tolist(), strict=True)}
        assert got == Counter(links)


def test_query_over_a_table(spark, documents):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["the", "quick", "brown-fox", "jumps.", "über", "den", "Zaun\n"], k=rng.randrange(1, 60)))) for i in range(200)]
    out = alignment.query(spark, documents(rows))
    assert out.columns == NAMES
    assert result(out) == plain(rows)


def test_very_long_texts_and_an_empty_table(spark, documents):
    rng = random.Random(4)
    rows = [(1, "".join(rng.choices("abcdefghij    \n", k=5_000_000))), (2, "x" * 300_000 + " y"), (3, "a b")]
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    assert result(alignment.align(docs)) == plain(rows)
    assert collect(alignment.align(docs.limit(0))) == []


def test_blocks_are_small_rows(spark, documents):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=2000))) for i in range(280)]
    docs = spark.read.parquet(documents(rows) + "/documents.parquet").coalesce(1)
    made = collect(alignment.blocks(docs, *alignment.default_tokenizers()))
    sizes = [sum(len(x) * (1 if isinstance(x, (bytes, bytearray)) else 8) for x in r.values() if not isinstance(x, int)) for r in made]
    assert len(sizes) >= 3 and max(sizes) < 1 << 20  # 2.8 million characters
