import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import mixing

from .conftest import collect


def rows(n=400):
    return [(i, "w " * (1 + i * 7919 % 97), f"s{i % 5}") for i in range(n)]


def run(spark, documents, data):
    return collect(mixing.query(spark, documents(data)))


def test_targets_are_met_and_no_document_exceeds(spark, documents):
    data = rows() + [(1000, None, "s1"), (1001, "", "s2"), (1002, "a\x0bb\x0cc", None), (1003, "x " * 40, None), (None, "p q", "s1"), (7, "w w w", "s2"), (7, "w w w", "s2")]
    out = run(spark, documents, data)
    assert len(out) == len(data)
    sizes = {}
    for _, text, source in data:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = mixing.water_fill(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    got, seen = {}, {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        got[r["source_size"]] = got.get(r["source_size"], 0) + r["taken"]
        seen[r["source_size"]] = r["target"]
    assert seen == {sizes[s]: pytest.approx(t) for s, t in want.items()}
    assert len(set(sizes.values())) == len(sizes)
    for size, taken in got.items():
        assert abs(taken - seen[size]) <= max(100, 0.02 * seen[size])


def test_reruns_agree(spark, documents):
    d = documents(rows(100))
    a, b = (sorted((r["doc_id"], r["taken"]) for r in collect(mixing.query(spark, d))) for _ in range(2))
    assert a == b


def test_caps_make_every_document_three_copies(spark, documents):
    data = [(i, "w " * 10, "a" if i else "b") for i in range(50)]
    out = {r["doc_id"]: r for r in run(spark, documents, data)}
    assert out[0]["target"] == 30.0 and out[0]["taken"] == 30


def test_empty_and_wordless(spark, documents):
    out = sorted(tuple(r.values()) for r in run(spark, documents, [(1, None, None), (2, " ", "a")]))
    assert out == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_empty_table(spark, documents):
    assert run(spark, documents, []) == []


def test_repeating_keeps_columns_and_counts(spark, documents):
    docs = spark.read.parquet(documents(rows(60)) + "/documents.parquet")
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.select("doc_id", "text", "source")).collect()}
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert got == {i: n for i, n in plan.items() if n}


def test_each_row_of_a_repeated_or_missing_id_gets_its_own_copies(spark, documents):
    data = [(None, "w " * (1 + i * 7919 % 97), f"s{i % 5}") for i in range(400)] + [(None, "", "s1"), (5, "", "s0"), *[(5, "w " * 30, "s0")] * 9]
    out = collect(mixing.repeat_documents(spark.read.parquet(documents(data) + "/documents.parquet")))
    sizes, got = {}, {}
    for _, text, source in data:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    for r in out:
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    for source, target in mixing.water_fill(sizes).items():
        assert abs(got.get(source, 0) - target) <= max(100, 0.02 * target)


def test_rates_solve_the_dual(spark, documents):
    data = rows(300) + [(900 + i, "w " * 7, "s9") for i in range(20)]
    out = run(spark, documents, data)
    by = {}
    for r in out:
        by.setdefault(r["source_size"], []).append(r)
    assert len(by) == 6
    for size, own in by.items():
        target = own[0]["target"]
        mean = size / len(own)

        def rate(level, x, mean=mean):
            return 3 / (1 + 2 * math.exp(-max(-700, min(700, level * x / mean))))

        low, high = -60.0, 60.0
        for _ in range(200):  # the sum grows with the level: halve
            level = (low + high) / 2
            low, high = (level, high) if sum(r["size"] * rate(level, r["size"]) for r in own) < target else (low, level)
        for r in own:
            assert math.floor(rate(level, r["size"]) - 1e-3) <= r["taken"] / r["size"] <= math.ceil(rate(level, r["size"]) + 1e-3)
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, t, s) for i, t, s in rows(150)] + [(None, "a b c", "s1")] * 9, "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, mixing.mix(docs.repartition(n)).collect()), key=str) for n in (1, 7))
    assert a == b


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=3)), st.integers(0, 1000), max_size=8))
def test_water_filling(sizes):
    target = mixing.water_fill(sizes)
    assert set(target) == set(sizes)
    for s, t in target.items():
        assert t <= 3 * sizes[s] + 1e-6
    assert sum(target.values()) == pytest.approx(sum(sizes.values()), abs=1e-6)
    order = sorted(sizes, key=mixing.code_points)
    free = [(s, 1 + i % 3) for i, s in enumerate(order) if target[s] < 3 * sizes[s] - 1e-6]
    assert len({round(target[s] / w, 6) for s, w in free}) <= 1
