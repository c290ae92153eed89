import hashlib
import re

import numpy as np

from lodestone.llm import secrets_cnn

from .conftest import collect

NAME = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = re.compile("(" + NAME + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
HEX32 = "0123456789abcdef" * 2
TEXTS = [
    None, "", "nothing here at all", 'token = "abcdefgh12"', "TOKEN:short password=abc secret='0123456'",
    "token=token:abcdefgh", "api_key = x api_key=abcdef", "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "xAKIAKIA" + "B2" * 10,
    HEX32[:24], HEX32[:23], f"é{HEX32} ü AKIA{'Z' * 20}", "paſſword=abcdefg toKen=abcdefgh", f"password: {HEX32}",
    "word " * 20000 + "token = " + "q" * 50, f"{HEX32}g{HEX32}", "apikey='a.b-c_d+e/f=='",
]


def brute(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(found)


def test_base_findings_equal_brute_force(spark, documents):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[3]), (3, TEXTS[3])]
    out = collect(secrets_cnn.query(spark, documents(rows)))
    assert len(out) == len(rows)
    for r in out:
        found = brute(TEXTS[3] if r["doc_id"] is None else TEXTS[r["doc_id"]])
        text = ",".join(f"{secrets_cnn.KINDS[k]}:{a}:{b}" for a, k, b in found)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in found) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("cnn")] == [s for s in text.split(",") if s]


def test_empty_table(spark, documents):
    assert secrets_cnn.query(spark, documents([])).count() == 0


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        token = secrets_cnn.planted_secret(rng) if i % 2 else secrets_cnn.planted_plain(rng, ["under", "the", "water", "house"])
        out.append((f"some words {token} and others", 11, 11 + len(token), i % 2))
    return [secrets_cnn.example(t, a, b) for t, a, b, _ in out], np.array([y for *_, y in out], dtype=float)


def test_network_learns_and_keeps_the_recall():
    rng = np.random.default_rng(0)
    net = secrets_cnn.Network.start(rng)
    windows, labels = labelled(600, 1)
    net.train(windows, labels, rng)
    net.calibrate(*labelled(200, 2), 0.95)
    fresh, truth = labelled(400, 3)
    p = net.scores(fresh)
    assert ((p >= net.threshold) & (truth > 0)).sum() >= 0.9 * truth.sum()
    assert ((p >= net.threshold) & (truth == 0)).sum() <= 0.1 * (truth == 0).sum()
    assert net.report["secrets"] == 100 and net.report["found"] >= 95


def test_gradient():
    windows, labels = labelled(6, 5)
    net = secrets_cnn.Network.start(np.random.default_rng(6))
    weight = np.linspace(0.5, 1.5, len(labels))

    def loss():
        p = 1 / (1 + np.exp(-net.logits(windows)))
        return -np.mean(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p)))

    grads = net.gradients(windows, labels, weight)
    rng = np.random.default_rng(7)
    for param, grad in zip((net.embed, net.filters, net.bias, net.out), grads, strict=True):
        for _ in range(8):
            at = tuple(rng.integers(n) for n in param.shape)
            keep, param[at] = param[at], param[at] + 1e-6
            up = loss()
            param[at] = keep - 1e-6
            down = loss()
            param[at] = keep
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-5


def test_a_long_candidate_is_read_whole():
    net = secrets_cnn.Network.start(np.random.default_rng(1))
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abc123"), 5000))
    whole = secrets_cnn.example(text, 0, len(text))
    parts = net.features([whole])
    net.PART = 10_000
    assert np.allclose(parts, net.features([whole]))
    changed = secrets_cnn.example(text[:-1] + "Z", 0, len(text))
    assert not np.allclose(parts, net.features([changed]))
    assert not np.allclose(net.features([whole]), net.features([secrets_cnn.example(text + " after", 0, len(text))]))


def prose(n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghilmnorstu"), rng.integers(2, 9))) for _ in range(300)]
    return [" ".join(rng.choice(words, 60)) + "." for _ in range(n)], words


def test_planted_secrets_that_no_rule_matches_are_found(spark, documents):
    texts, words = prose(400, 3)
    rng = np.random.default_rng(4)
    hidden = {}
    for i in range(0, 100):
        secret = secrets_cnn.planted_secret(rng)
        if not secrets_cnn.rules(secret):
            a = texts[i].index(" ", 40) + 1
            hidden[i] = (a, a + len(secret))
            texts[i] = texts[i][:a] + secret + " " + texts[i][a:]
    for i in range(100, 200):
        texts[i] += " " + secrets_cnn.planted_plain(rng, words) + " end"
    out = {r["doc_id"]: r["spans"] for r in collect(secrets_cnn.query(spark, documents(list(enumerate(texts)))))}
    found = sum(f"cnn:{a}:{b}" in out[i].split(",") for i, (a, b) in hidden.items())
    assert found >= 0.9 * len(hidden) and len(hidden) > 80
    assert sum(out[i] != "" for i in range(100, 400)) <= 6


def test_masking(spark, documents):
    docs = spark.read.parquet(documents([(1, 'a token = "abcdefgh12" b'), (2, None), (3, "clean"), (4, f"x {HEX32} password={HEX32}")]) + "/documents.parquet")
    out = {r["doc_id"]: r for r in collect(secrets_cnn.mask(docs, None))}
    assert out[1]["text"] == 'a token = "[secret]" b' and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == "clean"
    assert out[4]["text"] == "x [secret] password=[secret]"
    assert docs.columns == secrets_cnn.mask(docs, None).columns


def test_candidates_are_what_no_rule_covers():
    text = f"token={HEX32} then Zm9vYmFyMTIzNDU2Nzg5MA== and justletterswithoutdigits 1234567890 ab12345 q1w2e3r4"
    found = secrets_cnn.candidates(text, secrets_cnn.rules(text))
    assert [text[a:b] for a, b in found] == ["Zm9vYmFyMTIzNDU2Nzg5MA==", "q1w2e3r4"]


def test_rules_findings_are_scored_too():
    windows, labels = labelled(300, 8)
    rng = np.random.default_rng(9)
    net = secrets_cnn.Network.start(rng)
    net.train(windows, labels, rng)
    net.calibrate(windows, labels, 0.9)
    ((start, kind, end, value, score),) = secrets_cnn.find([f"the password={HEX32[:20]} it is"], net)[0]
    assert (start, kind, end, value) == (4, 0, 33, 13) and 0 < score < 1


def test_repeated_rows_and_clashing_columns_are_masked_alike(spark):
    rows = [(1, f"x {HEX32} y", "a"), (1, f"x {HEX32} y", "b"), (None, f"x {HEX32} y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, findings string")
    out = collect(secrets_cnn.mask(docs, secrets_cnn.fit(docs)))
    assert sorted((r["doc_id"] or 0, r["text"], r["findings"]) for r in out if r["findings"]) == [(1, "x [secret] y", "a"), (1, "x [secret] y", "b")]
    assert len(out) == 3


def test_characters_beyond_latin_1_have_a_code_of_their_own():
    codes = np.frombuffer(secrets_cnn.example("да? é пар0ль? ю", 6, 13), dtype=np.uint8)
    inside = codes[secrets_cnn.SIDE : -secrets_cnn.SIDE]
    other, mark = secrets_cnn.OTHER + secrets_cnn.INSIDE, ord("?") - 31 + secrets_cnn.INSIDE
    assert inside.tolist() == [other, other, other, ord("0") - 31 + secrets_cnn.INSIDE, other, other, mark]
    assert codes[secrets_cnn.SIDE - 6] == secrets_cnn.OTHER and codes[secrets_cnn.SIDE - 4] == ord("?") - 31


def test_every_document_is_learned_from(spark, documents, monkeypatch):
    """More examples than the bounded sample had: all are trained or calibrated on, in shares, however the table is divided."""
    docs = spark.read.parquet(documents(list(enumerate(prose(3300, 11)[0]))) + "/documents.parquet")
    every = secrets_cnn.examples(docs).distinct().count()
    assert every > 6600
    for name, value in (("ROUNDS", 4), ("SHARE", 500)):
        monkeypatch.setattr(secrets_cnn, name, value, raising=False)
    net = secrets_cnn.fit(docs)
    held = net.report["secrets"] + net.report["harmless"]
    assert abs(held - every / 3) < every / 30 and net.report["secrets"] > 1000
    assert net.report["found"] >= secrets_cnn.RECALL * net.report["secrets"] - 1
    assert net.report["taken_for_secrets"] <= 0.05 * net.report["harmless"]
    trained, kept = [], secrets_cnn.trained
    monkeypatch.setattr(secrets_cnn, "trained", lambda net, some, *a: (trained.append((some.count(), a[0])), kept(net, some, *a))[1])
    again = secrets_cnn.fit(docs.repartition(7))
    assert sum(n for n, _ in trained) + held == every and len(trained) == 4 and trained[0][1] >= 2
    assert again.packed() == net.packed() and again.threshold == net.threshold
