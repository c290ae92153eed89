"""Personal data: the rules against their plain patterns, the bootstrap against a plain computation."""

import hashlib
import math
import random
import re
from collections import defaultdict

from hypothesis import example, given, settings
from hypothesis import strategies as st

from lodestone.llm import identifiers as ids

from .conftest import collect

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_rules(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in re.sub("[ -]", "", m.group())]
        total = sum(x if i % 2 == 0 else sum(map(int, str(2 * x))) for i, x in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def plain_spans(texts, support=ids.SUPPORT, score=ids.SCORE, sure=ids.SURE, rounds=ids.ROUNDS):
    seen = [ids.places(t or "") for t in texts]
    of = defaultdict(set)
    for p in (p for ps in seen for p in ps):
        for x in p["patterns"]:
            of[x].add(p["instance"])
    known, taken = {p["instance"] for ps in seen for p in ps if p["kind"] < 4}, {}
    for _ in range(rounds):
        taken = {}
        for x, held in of.items():
            good = len(held & known)
            if good >= support and good / (len(held) + 1) >= score:
                taken[x] = round(-1e6 * math.log(1 - good / (len(held) + 1)))
        weight = defaultdict(int)
        for x, w in taken.items():
            for i in of[x]:
                weight[i] += w
        more = known | {i for i, w in weight.items() if w >= round(-1e6 * math.log(1 - sure))}
        if more == known:
            break
        known = more
    return [[(p["start"], p["kind"], p["end"]) for p in ps if p["kind"] < 4 or p["instance"] in known and set(p["patterns"]) & set(taken)] for ps in seen]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("ab.@-+ 0127()%é\n"), max_size=40))
@example("a@b@c.d@e.f")
@example("1.2.3.4.5.6.7.8 0300.1.1.1 256.1.1.1")
@example("4111 1111 1111 1111 +1 (017) 555-7713")
def test_rules_are_their_plain_patterns(text):
    assert ids.rules(text) == plain_rules(text)


def test_rules_in_long_runs():
    """Runs that a search from every character would take minutes for."""
    n = 1_000_000
    text = "a" * n + " " + "1" * n + " x@" + "b" * n + " " + "+1" * 10 + "(" * n + "9" + "@" * 1000 + "." * n
    assert ids.rules(text) == []
    assert [b - a for a, b in ids.candidates(text, [])] == [n, n + 2, 19]


def made(seed, n):
    """Visitors' records: known identifiers and badge numbers in the same places, other numbers elsewhere."""
    rng = random.Random(seed)

    def badge():
        return f"Q{rng.randrange(10**6, 10**7)}"

    rows = []
    for i in range(n):
        name = rng.choice(["mail", "host", "desk"])
        kind = i % 6
        if kind < 3:
            text = f"visitor signed as u{i}{rng.randrange(100)}@{name}.example.org at noon"
        elif kind == 3:
            text = f"visitor signed as {badge()} at noon"
        elif kind == 4:
            text = f"invoice total was {rng.randrange(10000, 99999)} euros. version 2024.{i}"
        else:
            text = f'token = "{hashlib.sha256(str(i).encode()).hexdigest()}" ' + f"seen from {rng.randrange(256)}.{rng.randrange(256)}.7.9 today"
        rows.append((i, f"Étude {i % 3}. {text}"))
    return rows + [(None, "visitor signed as Q7654321 at noon"), (n, None), (n + 1, ""), (n + 2, "plain words only"), *rows[:2]]


def as_text(spans):
    return ",".join(f"{ids.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_against_a_plain_bootstrap(spark, documents):
    rows = made(1, 300)
    out = ids.query(spark, documents(rows))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = []
    for (doc, _), spans in zip(rows, plain_spans([t for _, t in rows]), strict=True):
        base = [s for s in spans if s[1] < 4]
        want.append((doc, *[sum(s[1] == k for s in base) for k in range(4)], hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(spans)))
    assert sorted((tuple(r.values()) for r in collect(out)), key=repr) == sorted(want, key=repr)


def test_discovers_badges_and_nothing_else(spark, documents):
    rows = made(2, 300)
    texts = dict(rows)
    found = [(r["doc_id"], a, b) for r in collect(ids.find(spark.read.parquet(documents(rows) + "/documents.parquet"))) for a, k, b in r["spans"] if k == 4]
    tokens = {texts[d][a:b] for d, a, b in found}
    assert tokens == {t for text in texts.values() for t in re.findall(r"Q\d{7}", text or "")} and len(tokens) > 40


def test_rounds_reach_further(spark, documents):
    """What one round finds is a seed of the next: numbers of a second context are found by it alone."""
    rows = made(3, 240)
    badges = [re.search(r"Q\d{7}", t).group() for _, t in rows if t and "Q" in t]
    rows += [(1000 + i, f"locker of {b} is open") for i, b in enumerate(badges)] + [(2000, "locker of Z9999999 is open")]
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    for rounds, reached in ((1, False), (3, True)):
        spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in collect(ids.find(docs, rounds=rounds))}
        assert bool(spans[2000]) == reached
        assert {d: s for (d, _), s in zip(rows, plain_spans([t for _, t in rows], rounds=rounds), strict=True)} == spans


def test_long_texts_and_an_empty_table(spark, documents):
    long = "word " * 600_000 + "me@host.example " + "7" * 2_000_000 + " end"
    rows = [(1, long), (2, "me@host.example")]
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    out = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in collect(ids.find(docs))}
    assert out == {1: [(3_000_000, 0, 3_000_015)], 2: [(0, 0, 15)]}
    assert collect(ids.find(docs.limit(0))) == []
