"""Distances of sources and their telling terms, against a plain computation and against SQL."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import duckdb
import numpy as np
import pytest

from lodestone.llm import divergence

from .conftest import collect

SCHEMA = "doc_id long, text string, lang string, source string, value long, rank int, term string, block long, whole boolean"


def plain(rows, least=30, most=50):
    docs = [((t or ""), (la or ""), (s or "")) for _, t, la, s in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(low))
        df[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in df[lang].items() if n >= least}

        def probabilities(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + floor(Fraction(10**9 * (c[t] + 5), n + 5 * len(kept))) for t in kept}

        total = Counter()
        for s in sources:
            total.update(counts[lang, s])
        q, p = probabilities(total), {s: probabilities(counts[lang, s]) for s in sources}
        for s in sources:
            parts = {
                "pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s],
                "term": [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or i <= most:
                        out.append((lang, s, part, item, v, i))
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "école", "ÉCOLE", "naïve", "a", "b1c", "x_y", "日本", "zé", "Kİ", "end"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=rng.randrange(0, 25)))
        rows.append((i, rng.choice([text, text, text, "", None]), rng.choice(["en", "en", "de", "d\0e", "\0", None, ""]), rng.choice(["s0", "s0", "s1", "é", "z", None])))
    return rows + rows[:7]


def frame(spark, rows):
    return spark.createDataFrame([(*r, -1, 0, "t", 3, False) for r in rows], SCHEMA)


def result(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in collect(df))


@pytest.mark.parametrize(("least", "most", "block_terms", "cells"), [(30, 50, 600_000, 1 << 20), (2, 3, 10, 12), (1, 50, 40, 1), (1000, 5, 5, 100)])
def test_against_a_plain_computation(spark, least, most, block_terms, cells):
    rows = made(least, 300)
    found = divergence.audit(frame(spark, rows), least=least, most=most, block_terms=block_terms, cells=cells)
    assert result(found) == plain(rows, least, most)


def test_query_and_its_sql(spark, table):
    rows = made(5, 400) + [(1000 + i, None, "empty", f"s{i % 3}") for i in range(5)] + [(2000, "alone here", "one", "s")]
    d = table("documents", [(*r, -1, 0, "t", 3, False) for r in rows], SCHEMA)
    found = divergence.query(spark, d)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    assert result(found) == plain(rows) == sorted(con.execute(divergence.ORACLE).fetchall())


def test_empty_table(spark):
    assert collect(divergence.audit(frame(spark, [(0, "a", "b", "c")]).limit(0))) == []


def test_very_long_text(spark):
    text = "Aa bb " * 400_000 + "é" * 3_000_000
    rows = [(0, text, "en", "s"), (1, "aa", "en", "t")]
    assert result(divergence.audit(frame(spark, rows), least=1)) == plain(rows, least=1)


def test_a_term_of_most_rows_is_dealt_to_several_partitions(spark):
    """One term fills all documents of one source: its run is cut at borders and put together again."""
    rows = [(i, "same other" if i % 3 else "same", "en", f"s{i % 2}") for i in range(400)]
    blocks = divergence.count_blocks(frame(spark, rows).repartition(40), 1).where("n > 0")
    order = ["key", "source", "block"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = divergence.scan_runs(blocks.repartitionByRange(7, *order).sortWithinPartitions(*order), 1).where("term = 'same'").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["whole"] for r in held}) == 1 and not held[0]["whole"] and len(held) > 2
    assert sum(r["df"] for r in held) == 400
    assert result(divergence.audit(frame(spark, rows), block_terms=1)) == plain(rows)


def test_exact_quotients():
    rng = random.Random(1)
    for _ in range(2000):
        d = rng.randrange(1, 9 * 10**15)
        x = rng.randrange(0, d + 1)
        assert int(divergence.per_billion(np.array([x]), np.array([d]))[0]) == 10**9 * x // d
