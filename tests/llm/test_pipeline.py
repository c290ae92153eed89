import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import mixing, packing, secrets_cnn

from .test_langid import brute_query
from .test_simhash import jaccard

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(800)]
    texts = [" ".join(rng.choice(words, 150)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "en", "s0", 1) for i in range(5)]  # exact copies
    rows += [(200, None, "en", "s0", 0), (201, "123 !!", "en", "s0", 6), (202, texts[7] + ' token = "abcdefgh1234"', None, None, 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r.asDict() for r in docs.collect()]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before
    assert {r["doc_id"] for r in kept["language"]} == {r[0] for r in rows} - {200, 201}
    assert {r["doc_id"] for r in kept["near_duplicates"]} == set(range(60))
    assert all("abcdefgh1234" not in r["text"] for r in kept["secrets"])
    assert {r["doc_id"] for r in kept["mixture"]} <= set(range(60))
    assert sorted(r["doc_id"] for r in kept["packed"] if r["start"] == 0) == sorted(r["doc_id"] for r in kept["mixture"])
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    pool = {"en": list("the and of to in is you that it he was for on are with".split()), "de": list("der die und in den von zu das mit sich des auf ist im dem".split())}
    words = {k: v + ["".join(rng.choice(v, 2)) for _ in range(60)] for k, v in pool.items()}

    def prose(lang, n):
        return " ".join(rng.choice(words[lang], n))

    rows = []
    for i in range(40):
        lang = "en" if i % 2 else "de"
        text = prose(lang, 130)
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    for i in range(6):  # near copies, of similarity 0.9 and of 0.6
        changed = rows[i][1].split()
        for j in range(2 if i % 2 else 12):
            changed[j * 10 + 3] = f"x{chr(97 + j)}q"
        rows.append((50 + i, " ".join(changed), "en", "s1", 1))
    rows += [(60, rows[7][1], "en", "s2", 1), (60, prose("en", 130), None, None, 1), (None, prose("de", 140), "de", "s0", 1), (None, None, "en", "s0", 0), (61, "", "en", "s0", 0), (62, "12 34 !!", "de", "s0", 8)]
    rows += [(63, prose("en", 80) + ' password = "abcdef-1" and AKIA' + "Q" * 16, "en", "s1", 1), rows[3]]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = [r.asDict() for r in docs.collect()]

    # language: those of the plain computation whose score is high enough
    scored = brute_query([(n, r[1], r[2]) for n, r in enumerate(rows)], every=True)
    want = sorted(str(r[:2]) for n, r in enumerate(rows) if scored[n][0] != "und" and scored[n][1] >= corpus_pipeline.LEAST_SCORE)
    assert sorted(str((r["doc_id"], r["text"])) for r in after["language"]) == want
    assert len(want) == len(rows) - 3

    # near duplicates: the first row, by doc_id, of each group of all pairs at 0.8 or more
    left = sorted(((r["doc_id"], r["text"]) for r in after["language"]), key=lambda r: (r[0] is None, r[0] or 0))
    label = list(range(len(left)))
    pairs = [(i, j) for i in range(len(left)) for j in range(i) if jaccard(left[i][1], left[j][1]) >= 0.8]
    for _ in left:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    kept = [left[i] for i in range(len(left)) if label[i] == i]
    assert sorted(str((r["doc_id"], r["text"])) for r in after["near_duplicates"]) == sorted(map(str, kept))
    assert len(kept) < len(left)

    # secrets: the rules' values are masked, everything else stays
    def masked(text):
        return text.replace("abcdef-1", secrets_cnn.MASK).replace("AKIA" + "Q" * 16, secrets_cnn.MASK)

    assert sorted(str((r["doc_id"], r["text"])) for r in after["secrets"]) == sorted(str((i, masked(t))) for i, t in kept)
    assert all(r["n_chars"] == len(r["text"]) for r in after["secrets"])

    # mixture: rows of the secrets stage, each up to three times, sources near their targets
    size = lambda t: len(t.split())
    totals, got = {}, {}
    for r in after["secrets"]:
        totals[r["source"]] = totals.get(r["source"], 0) + size(r["text"])
    for r in after["mixture"]:
        got[r["source"]] = got.get(r["source"], 0) + size(r["text"])
    for source, target in mixing.water_fill(totals).items():
        assert abs(got.get(source, 0) - target) <= 145
    known = {str((r["doc_id"], r["text"], r["lang"], r["source"])) for r in after["secrets"]}
    times = Counter(str((r["doc_id"], r["text"], r["lang"], r["source"])) for r in after["mixture"])
    assert set(times) <= known and max(times.values()) <= 3

    # packed: every copy's ids once, in sequences that have no gaps
    library = Tokenizer.from_file(packing.default_tokenizer())
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in after["packed"])
    ids = [(r["doc_id"], np.array(library.encode(r["text"], add_special_tokens=False).ids + [2], dtype="<u4")) for r in after["mixture"]]
    assert pieces == Counter((i, 0, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    places = {}
    for r in after["packed"]:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
