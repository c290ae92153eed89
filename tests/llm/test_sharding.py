import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import sharding

from .conftest import collect


def test_law_and_slots(spark, documents):
    rows = [(i, "ab" * (i % 7)) for i in range(203)] + [(None, "x"), (None, None), (5, "again"), (5, "again")]
    out = collect(sharding.query(spark, documents(rows)))
    assert len(out) == len(rows)
    counts = [sorted(r["slot"] for r in out if r["shard"] == s) for s in range(16)]
    assert max(map(len, counts)) - min(map(len, counts)) <= 1
    assert all(c == list(range(len(c))) for c in counts)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == want
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}


def test_same_result_for_any_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    a = sorted(map(tuple, sharding.shuffle_into_shards(df.repartition(7), 4, ["doc_id"]).collect()))
    assert a == sorted(map(tuple, sharding.shuffle_into_shards(df.coalesce(1), 4, ["doc_id"]).collect()))


def test_empty_and_tiny(spark, documents):
    assert sharding.query(spark, documents([(1, "x"), (2, None)])).count() == 2


def test_empty(spark, documents):
    assert sharding.query(spark, documents([])).count() == 0


def test_several_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 20)
    df = spark.range(700).withColumnRenamed("id", "doc_id")
    out = sharding.shuffle_into_shards(df, 3, ["doc_id"]).collect()
    for s in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (233, 234)


def test_query_equals_a_plain_deal(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 40)
    rows = [(i, "ab" * (i % 7)) for i in range(300)] + [(None, None), (None, None), (7, "again"), (7, "again")]
    d = documents(rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = spark.read.parquet(d + "/documents.parquet").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    seed, total, shards = 42, len(rows), 16
    parts, per_shard = total // 40 + 1, total // shards // 40 + 1
    hashed = slim.select("*", F.pmod(F.xxhash64(F.lit(seed), *slim.columns), F.lit(parts)).cast("int").alias("part"), *[F.xxhash64(F.lit(seed + i), *slim.columns).alias(f"t{i}") for i in (1, 2)])
    every = [r.asDict() for r in hashed.collect()]
    sizes, where = [], []
    for s, n in enumerate(sharding.even(total, shards)):
        start = 0
        for m in sharding.even(n, per_shard):
            sizes.append(m)
            where.append((s, start))
            start += m
    matrix = sharding.communication_matrix(np.random.default_rng(seed), [sum(r["part"] == p for r in every) for p in range(parts)], sizes)

    def order(r, tie):
        return (r[tie], r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"])

    blocks = [[] for _ in sizes]
    for p in range(parts):
        own = iter(sorted((r for r in every if r["part"] == p), key=lambda r: order(r, "t1")))
        for block, n in zip(blocks, matrix[p], strict=True):
            block += [next(own) for _ in range(n)]
    want = []
    for (s, start), block in zip(where, blocks, strict=True):
        want += [(r["doc_id"], r["size"], r["text_crc32"], s, start + i) for i, r in enumerate(sorted(block, key=lambda r: order(r, "t2")))]
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in collect(sharding.query(spark, d))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_hypergeometric_law():
    rng = np.random.default_rng(0)
    for good, bad, draws in ((5, 7, 4), (30, 10, 25), (1, 50, 10)):
        got = np.bincount([sharding.hypergeometric(rng, good, bad, draws) for _ in range(20_000)], minlength=draws + 1) / 20_000
        from math import comb

        want = np.array([comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) if k <= good and draws - k <= bad else 0.0 for k in range(draws + 1)])
        assert np.abs(got[: draws + 1] - want).max() < 0.02
    big = [sharding.hypergeometric(rng, 10**12, 10**12, 10**9) for _ in range(50)]
    assert abs(np.mean(big) - 5e8) < 1e5


def test_matrix_sums():
    m = sharding.communication_matrix(np.random.default_rng(1), [5, 0, 9], [4, 4, 3, 3])
    assert m.sum(1).tolist() == [5, 0, 9] and m.sum(0).tolist() == [4, 4, 3, 3] and (m >= 0).all()


def test_native_plan(spark, documents):
    plan = sharding.query(spark, documents([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
