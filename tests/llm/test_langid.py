import itertools
import math
import zlib

import numpy as np
import pytest

from lodestone.llm import langid

from .conftest import collect

ENGLISH = "the cat and the dog went to the house with their friends because they wanted food"
GERMAN = "der hund und die katze gingen mit ihren freunden nach hause weil sie hunger hatten"


def rows():
    en, de = ENGLISH.split(), GERMAN.split()
    out = []
    for i in range(60):
        words = (en if i % 2 else de)[i % 5 :] * 2
        out.append((i, " ".join(words), "s", "en" if i % 2 else "de"))
    return out


def brute(word, pieces, prob, k):
    """Sum over all segmentations, written out."""
    text, total = langid.START + word, 0.0
    index = {p: i for i, p in enumerate(pieces)}
    for cuts in itertools.product((False, True), repeat=len(text) - 1):
        parts, a = [], 0
        for b, cut in enumerate([*cuts, True], 1):
            if cut:
                parts.append(text[a:b])
                a = b
        p = 1.0
        for part in parts:
            p *= prob[index[part], k] if part in index else prob[-1, k] if len(part) == 1 else 0.0
        total += p
    return math.log(total)


def test_forward_sums_all_segmentations():
    pieces = sorted({langid.START, langid.START + "a", "a", "b", "ab", "ba", "aba", langid.START + "ab"})
    rng = np.random.default_rng(1)
    prob = rng.dirichlet(np.ones(len(pieces) + 1), 2).T
    words = ["a", "ab", "abab", "bza", "ababab", "zz"]
    got = langid.log_probabilities(words, langid.Pieces(pieces), prob)
    want = [[brute(w, pieces, prob, k) for k in range(2)] for w in words]
    assert np.allclose(got, want)


def test_expected_counts_sum_to_the_pieces_of_the_words():
    pieces = sorted({langid.START, "a", "b", "ab"})
    prob = np.full((5, 1), 0.2)
    counts = langid.expected_counts(["ab", "b"], np.array([[1.0], [2.0]]), langid.Pieces(pieces), prob)
    # "▁ab" splits as ▁|a|b (0.2^3) or ▁|ab (0.2^2): shares 1/6 and 5/6
    index = {p: i for i, p in enumerate(pieces)}
    assert counts[index["ab"], 0] == pytest.approx(5 / 6)
    assert counts[index["b"], 0] == pytest.approx(1 / 6 + 2)
    assert counts[index[langid.START], 0] == pytest.approx(3)


def test_query_learns_only_from_the_training_rows(spark, table):
    schema = "doc_id long, text string, source string, lang string, score string"
    data = [(*r, "x") for r in rows()]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 4 == 2][:6]
    # a label that only held-out rows carry is never predicted
    data += [(held[0], ENGLISH, "s", "xx", "x"), (held[1], GERMAN, "s", "xx", "x"), (held[2], None, "s", "en", "x"), (held[3], "123 ...", "s", "en", "x"), (held[4], "", None, None, None), (None, ENGLISH, "s", None, "x")]
    out = {r["doc_id"]: r for r in collect(langid.query(spark, table("documents", data, schema)))}
    assert len(out) == len(data)
    assert (out[held[0]]["lang_pred"], out[held[1]]["lang_pred"]) == ("en", "de")
    for i in held[2:5]:
        assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
    assert out[held[0]]["held_out"] and not out[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    tested = [r for r in out.values() if r["held_out"] and r["doc_id"] < 60]
    assert tested and all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in tested)


def test_no_labels_and_no_rows(spark, table):
    schema = "doc_id long, text string, lang string"
    assert {r["lang_pred"] for r in collect(langid.query(spark, table("documents", [(1, "words", None)], schema)))} == {"und"}


def test_empty_table(spark, table):
    assert langid.query(spark, table("documents", [], "doc_id long, text string, lang string")).count() == 0


def plain_forward(word, pieces, prob, k):
    """The forward sum in logarithms, position by position."""
    text, index = langid.START + word, {p: i for i, p in enumerate(pieces)}
    alpha = [0.0]
    for b in range(1, len(text) + 1):
        terms = []
        for a in range(max(0, b - 20), b):
            i = index.get(text[a:b], len(pieces) if b == a + 1 else None)
            if i is not None:
                terms.append(alpha[a] + math.log(prob[i, k]))
        top = max(terms)
        alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return alpha[-1]


PIECES = sorted({langid.START, langid.START + "a", "a", "b", "ab", "ba", "aba", langid.START + "ab", "abab"})


@pytest.mark.parametrize("length", [31, 32, 38, 100, 1023, 1024, 2500])
def test_long_runs_are_summed_whole(length):
    rng = np.random.default_rng(2)
    prob = rng.dirichlet(np.ones(len(PIECES) + 1), 3).T
    word = "".join(rng.choice(list("abz"), length))
    got = langid.log_probabilities([word, "ab"], langid.Pieces(PIECES), prob)
    assert np.allclose(got[0], [plain_forward(word, PIECES, prob, k) for k in range(3)])


@pytest.mark.parametrize("block", [16, 50, 1024])
def test_long_counts_are_those_of_the_short_way(monkeypatch, block):
    rng = np.random.default_rng(3)
    prob = rng.dirichlet(np.ones(len(PIECES) + 1), 2).T
    words = ["".join(rng.choice(list("abz"), n)) for n in (33, 60, 97)]
    weights = rng.integers(0, 4, (3, 2)).astype(float)
    monkeypatch.setattr(langid, "BLOCK", block)
    long = langid.expected_counts(words, weights, langid.Pieces(PIECES), prob)
    monkeypatch.setattr(langid, "LONG", 1000)
    assert np.allclose(long, langid.expected_counts(words, weights, langid.Pieces(PIECES), prob))


def brute_query(rows, rounds=3, smoothing=0.02, every=False):
    """The query in plain Python: expectation maximisation and scores, word by word; every: learn from all rows."""
    pieces = langid.read_pieces(langid.default_vocabulary())
    index = {p: i for i, p in enumerate(pieces)}
    train = [(t, lang) for d, t, lang in rows if t is not None and lang is not None and (every or d is None or zlib.crc32(str(d).encode()) % 4 != 2)]
    languages = sorted({lang for _, lang in train})
    prob = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))

    def edges(text):
        return [(a, b, index.get(text[a:b], len(pieces) if b == a + 1 else -1)) for a in range(len(text)) for b in range(a + 1, min(len(text), a + 17) + 1)]

    def sums(text, k):
        alpha, every = np.zeros(len(text) + 1), [e for e in edges(text) if e[2] >= 0]
        alpha[0] = 1
        for a, b, i in sorted(every, key=lambda e: e[1]):
            alpha[b] += alpha[a] * prob[i, k]
        return alpha, every

    for _ in range(rounds):
        total = np.full_like(prob, smoothing)
        for text, lang in train:
            k = languages.index(lang)
            for word in langid.words_of(text):
                alpha, every = sums(langid.START + word, k)
                beta = np.zeros(len(alpha))
                beta[-1] = 1
                for a, b, i in sorted(every, key=lambda e: -e[1]):
                    beta[a] += beta[b] * prob[i, k]
                for a, b, i in every:
                    total[i, k] += alpha[a] * prob[i, k] * beta[b] / alpha[-1]
        prob = total / total.sum(0)
    out = {}
    for d, text, _ in rows:
        words = langid.words_of(text or "")
        if not words:
            out[d] = ("und", 0.0)
            continue
        logs = np.array([sum(math.log(sums(langid.START + w, k)[0][-1]) for w in words) for k in range(len(languages))])
        best = int(np.argmax(logs))
        ratio = min(1.0, langid.SCORE_LETTERS / sum(map(len, words)))
        out[d] = (languages[best], float(1 / np.exp((logs - logs[best]) * ratio).sum()))
    return out


def test_query_is_the_plain_computation(spark, table):
    long = "donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft"
    data = [(i, " ".join((ENGLISH if i % 2 else GERMAN).split()[i % 7 :]), "en" if i % 2 else "de") for i in range(24)]
    data += [(30, long, "de"), (31, long[::-1], None), (32, "the " + long, None), (33, None, "en"), (34, "12", None), (35, ENGLISH, None), (36, "zażółć gęślą", None)]
    data += [data[0], data[1]]  # repeated rows count again
    want = brute_query(data)
    got = collect(langid.query(spark, table("documents", data, "doc_id long, text string, lang string")))
    assert len(got) == len(data)
    for r in got:
        assert (r["lang_pred"], r["score"]) == (want[r["doc_id"]][0], pytest.approx(want[r["doc_id"]][1], abs=1e-5))


def test_equal_likelihoods_go_to_the_smallest_label(spark, table):
    data = [(i, "same words here", lang) for i in range(40) for lang in ("b", "a")]
    out = collect(langid.query(spark, table("documents", data, "doc_id long, text string, lang string")))
    assert {r["lang_pred"] for r in out} == {"a"}


def test_a_very_long_text_and_run(spark, table):
    texts = [("x" * 60_000, None), ((ENGLISH + " ") * 30_000, None), (GERMAN, "de"), (ENGLISH, "en")]
    data = [(i, t, lang) for i, (t, lang) in enumerate(texts + texts[2:] * 10)]
    out = {r["doc_id"]: r for r in collect(langid.query(spark, table("documents", data, "doc_id long, text string, lang string")))}
    assert out[1]["lang_pred"] == "en" and 0 < out[0]["score"] <= 1


def test_too_many_labels_are_an_error(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "'some text' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError):
        langid.fit(docs)


def test_added_columns_replace_those_of_the_same_name(spark):
    docs = spark.createDataFrame([(1, ENGLISH, "en", "old", "old")], "doc_id long, text string, lang string, lang_pred string, score string")
    out = langid.identify(docs, langid.fit(docs))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert out.first()["lang_pred"] == "en"
