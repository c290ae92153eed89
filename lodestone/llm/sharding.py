"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in source parts (a hash of the key). A matrix of counts, one row a part and one column a
block of a shard, is drawn from the multivariate hypergeometric law: the counts that a uniformly
random permutation of all rows would give. Each part then permutes its rows and deals them out by
its row of counts; each block permutes what it has received. Shard sizes are exact (at most one
apart), and slots follow from the block sizes alone, so nothing is sorted or counted globally.

All on the JVM: the draw itself concerns at most MAX_PARTS x MAX_BLOCKS counts, whatever the input.

Defined results: null keys are a value like any other; rows with equal keys and equal other columns
are interchangeable; an empty table gives no rows; columns `shard` and `slot` are replaced.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a part or a block should have, and how many there may be.
PART_ROWS = 50_000
MAX_PARTS = 1024
MAX_BLOCKS = 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` draws without replacement are good; by inversion around the mode.

    Weights relative to the mode follow from the ratios of neighbours, so sizes beyond 2^31 work.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    spread = (draws * (good / (good + bad)) * (bad / (good + bad)) * (good + bad - draws) / max(1, good + bad - 1)) ** 0.5
    reach = int(12 * spread) + 40
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    over = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    under = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([under[::-1], [1.0], over])
    at = np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right")
    return int(mode - len(under) + min(at, len(weights) - 1))


def communication_matrix(rng: np.random.Generator, rows: list[int], columns: list[int]) -> np.ndarray:
    """Counts with these row and column sums, as a uniform permutation would have them."""
    left = list(columns)
    out = np.zeros((len(rows), len(columns)), dtype=np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for j, have in enumerate(left):
            rest -= have
            out[i, j] = k = hypergeometric(rng, have, rest, n) if n else 0
            left[j] -= k
            n -= k
    return out


def even(n: int, parts: int) -> list[int]:
    return [n // parts + (i < n % parts) for i in range(parts)]


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from a JSON literal, built on the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _ends_below(ends: str, rank: str, most: int) -> Column:
    """How many of the ascending numbers in the array `ends`, at most `most`, are no larger than `rank`: a binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    at = F.col(ends)

    def step(found: Column, n: Column) -> Column:
        return found + F.when((found + n <= F.size(at)) & (F.try_element_at(at, found + n) <= F.col(rank)), n).otherwise(0)

    return F.aggregate(steps, F.lit(0), step)


def shuffle_into_shards(df: DataFrame, shards: int, key: list[str], seed: int = 42) -> DataFrame:
    """df with `shard` (int) and `slot` (long, gapless from 0 in its shard), in uniformly random order.

    The same rows and seed give the same result, however df is partitioned.
    """
    spark = df.sparkSession
    kept = df.drop("shard", "slot")
    total = kept.count()
    parts = min(MAX_PARTS, total // PART_ROWS + 1)
    per_shard = min(max(1, MAX_BLOCKS // shards), total // shards // PART_ROWS + 1)
    tie = [F.xxhash64(F.lit(seed + i), *[F.col(c) for c in kept.columns]) for i in (1, 2)]
    part = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in key]), F.lit(parts)).cast("int")
    placed = kept.withColumn("__part", part)
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}

    sizes, where = [], []
    for s, n in enumerate(even(total, shards)):
        start = 0
        for m in even(n, per_shard):
            sizes.append(m)
            where.append({"b": len(where), "s": s, "start": start})
            start += m
    matrix = communication_matrix(np.random.default_rng(seed), [counts.get(p, 0) for p in range(parts)], sizes)
    dealt = _table(spark, [{"__part": p, "ends": row.cumsum().tolist()} for p, row in enumerate(matrix)], "__part: int, ends: array<bigint>")
    blocks = _table(spark, where, "b: int, s: int, start: bigint")

    rank = F.row_number().over(Window.partitionBy("__part").orderBy(tie[0], *[F.col(c) for c in key])).cast("long") - 1
    # both tables have at most MAX_PARTS x MAX_BLOCKS numbers
    sent = placed.withColumn("__rank", rank).join(F.broadcast(dealt), "__part").withColumn("__block", _ends_below("ends", "__rank", len(sizes))).drop("ends", "__rank", "__part")
    got = F.row_number().over(Window.partitionBy("__block").orderBy(tie[1], *[F.col(c) for c in key])).cast("long") - 1
    out = sent.withColumn("__got", got).join(F.broadcast(blocks), F.col("__block") == F.col("b"))
    return out.select(*kept.columns, F.col("s").alias("shard"), (F.col("start") + F.col("__got")).alias("slot"))


SHARDS = 16


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's shard and slot, under the law `rows`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(slim, SHARDS, slim.columns)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
