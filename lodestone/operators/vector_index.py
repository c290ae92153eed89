"""A stored index of vectors: lists around centroids, of which a search reads the nearest few.

Unit vectors lie in one folder for each list, beside their facets. Centroids come from a few rounds of
spherical k-means, whose sums Spark makes; every vector is then put into its nearest list. How many lists
a search reads is measured when the index is loaded: for a bounded set of its own vectors the true
neighbours are found by comparing with all, and `probes` is the least number of lists that holds the
wanted share of them. So data without clusters get many probes, not low recall. A filter by facets is
applied to a list's rows before the best of them are chosen; where few rows pass it, more `probes` are to be
asked for.

Defined results: vectors that are null, zero, of another length than most, or with null or non-finite
components are not in the index, and such queries find nothing; equal scores go to the smaller id.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Log
from .retrieval import top_k

MOST_LISTS = 4096
#: Vectors that centroids are fitted on, rounds of that, and vectors that the number of probes is measured on.
TRAIN_ROWS = 100_000
ROUNDS = 8
MEASURED = 200
NEIGHBOURS = 10
RECALL = 0.95
#: Vectors and queries that are compared as one matrix product.
VECTOR_ROWS, QUERY_ROWS = 2048, 256


def unit(vectors: DataFrame, key: str, dim: int | None = None) -> DataFrame:
    """Rows whose `vector` can be compared, as unit vectors of doubles; all other columns stay."""
    v = F.col("vector").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    good = (norm > 0) & (norm < float("inf")) & (F.size("vector") == dim if dim is not None else F.lit(True))
    return vectors.where(good).withColumn("vector", F.transform(v, lambda x: x / norm)).withColumn(key, F.col(key).cast("string"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _near(m: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest lists of each row, the nearest first, ties to the smaller number."""
    return np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :n]


def _lists(vectors: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """vectors with `list` and `place` (from 0): a row for each of the n nearest lists. The matrix is of MOST_LISTS rows at most."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), VECTOR_ROWS):
                own = part.iloc[a : a + VECTOR_ROWS]
                near = _near(_matrix(own["vector"]), centroids, n)
                rows = own.loc[own.index.repeat(near.shape[1])].copy()
                rows["list"], rows["place"] = near.ravel().astype(np.int32), np.tile(np.arange(near.shape[1], dtype=np.int32), len(own))
                yield rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInPandas(run, f"{fields}, list int, place int")


def _packed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(list, ids, m): rows(list, key, vector) of one list side by side."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for number, same in part.groupby("list"):
                for a in range(0, len(same), size):
                    own = same.iloc[a : a + size]
                    yield pd.DataFrame({"list": [number], "ids": [own[key].tolist()], "m": [_matrix(own["vector"]).tobytes()]})

    return rows.select("list", key, "vector").mapInPandas(run, "list int, ids array<string>, m binary")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best ids of every query in each pair of packed rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                ids, asked = np.asarray(r.ids, dtype=object), list(r.q_ids)
                scores = np.frombuffer(r.q_m).reshape(len(asked), -1) @ np.frombuffer(r.m).reshape(len(ids), -1).T
                for query, own in zip(asked, scores, strict=True):
                    best = np.lexsort((ids.astype(str), -np.round(own, 6)))[:k]
                    yield pd.DataFrame({"query_id": query, "id": ids[best], "score": own[best]})

    return pairs.mapInPandas(run, "query_id string, id string, score double")


class VectorIndex:
    """Vectors below a folder; see the module."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Log(spark, folder)

    def replace(self, vectors: DataFrame, *, facets: tuple[str, ...] = (), lists: int | None = None, recall: float = RECALL, seed: int = 42) -> None:
        """Load vectors(id, vector, facets) in the place of what the index held. ids are distinct."""
        version, _ = self.log.state()
        root = uuid.uuid4().hex
        at = f"{self.folder}/{root}"
        sizes = vectors.where("vector is not null").groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim = sizes["dim"] if sizes else 0
        unit(vectors.select("id", "vector", *facets), "id", dim).write.parquet(f"{at}/units")
        units = self.spark.read.parquet(f"{at}/units")
        n = units.count()
        state = {"root": root, "dim": dim, "rows": n, "probes": 1, "centroids": 0, "lists": []}
        if n:
            centroids = self._fit(units, n, lists or min(MOST_LISTS, max(1, math.isqrt(16 * n))), seed)
            self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, vector array<double>").coalesce(1).write.parquet(f"{at}/centroids")
            _lists(units, centroids, 1).drop("place").repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("list").parquet(f"{at}/lists")
            state |= {"centroids": len(centroids), "lists": [int(p.removeprefix("list=")) for p in self.log.folders(f"{root}/lists") if p.startswith("list=")]}
            state["probes"] = self._measure(units, at, centroids, recall, seed)
        self.log.remove(f"{at}/units")
        self.log.commit(version, state)

    def _fit(self, units: DataFrame, n: int, lists: int, seed: int) -> np.ndarray:
        order = F.xxhash64(F.lit(seed), F.col("id"))
        share = min(1 << 30, (TRAIN_ROWS << 30) // n + 1)
        sample = units.where(F.pmod(order, F.lit(1 << 30)) < share).select("vector")
        first = units.orderBy(order, "id").limit(lists).select("vector").collect()  # MOST_LISTS at most
        centroids = np.array([r["vector"] for r in first], dtype=np.float64)
        for _ in range(ROUNDS):
            each = _lists(sample, centroids, 1).select("list", F.posexplode("vector").alias("at", "x"))
            sums = each.groupBy("list", "at").agg(F.sum(F.round(F.col("x") * (1 << 40)).cast("decimal(38,0)")).cast("double").alias("x"))  # whole numbers: the order of tasks decides nothing
            found = np.zeros_like(centroids)
            for r in sums.toLocalIterator():  # a row for each list and component
                found[r["list"], r["at"]] = r["x"]
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            centroids = np.where(norm > 0, found / np.where(norm > 0, norm, 1), centroids)
        return centroids

    def _measure(self, units: DataFrame, at: str, centroids: np.ndarray, recall: float, seed: int) -> int:
        """The least number of lists that holds that share of the true neighbours of some of the vectors."""
        asked = units.orderBy(F.xxhash64(F.lit(seed + 1), F.col("id")), "id").limit(MEASURED).select(F.col("id").alias("query_id"), "vector")
        every = self.spark.read.parquet(f"{at}/lists").select(F.col("list").cast("int"), "id", "vector")
        one = _packed(asked.withColumn("list", F.lit(0)), "query_id", MEASURED).select(F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
        near = top_k(_best(_packed(every, "id", VECTOR_ROWS).crossJoin(F.broadcast(one)), NEIGHBOURS + 1).where("id <> query_id"), NEIGHBOURS)  # at most MEASURED queries, one row
        placed = _lists(asked, centroids, len(centroids)).select("query_id", "list", "place")
        needed = sorted(r["place"] for r in near.join(every.select("id", "list"), "id").join(placed, ["query_id", "list"]).select("place").collect())
        return 1 + needed[max(0, math.ceil(recall * len(needed)) - 1)] if needed else 1

    def state(self) -> dict:
        """rows, centroids, and the probes of a search."""
        _, state = self.log.state()
        if not state:
            raise KeyError(f"{self.folder} holds no index")
        return state

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """(list, id, vector, facets) of these lists; only their files are read."""
        state = self.state()
        base = f"{self.folder}/{state['root']}/lists"
        paths = [f"{base}/list={n}" for n in state["lists"] if lists is None or n in set(lists)]
        return self.spark.read.option("basePath", base).parquet(*paths)

    def search(self, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k nearest by cosine of queries(query_id, vector) in the lists read."""
        state = self.state()
        kind = queries.schema["query_id"].dataType
        empty = self.spark.createDataFrame([], "query_id string, id string, score double, rank int").withColumn("query_id", F.col("query_id").cast(kind))
        if not state["lists"]:
            return empty
        known = self.spark.read.parquet(f"{self.folder}/{state['root']}/centroids").orderBy("list").collect()  # MOST_LISTS at most
        centroids = np.array([r["vector"] for r in known])
        asked = _lists(unit(queries.select("query_id", "vector"), "query_id", state["dim"]), centroids, min(len(centroids), probes or state["probes"]))
        wanted = [r["list"] for r in asked.select("list").distinct().collect() if r["list"] in set(state["lists"])]
        if not wanted:
            return empty
        rows = self.rows(wanted)
        rows = (rows if where is None else rows.where(where)).withColumn("list", F.col("list").cast("int"))
        near = _packed(asked, "query_id", QUERY_ROWS).select("list", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
        found = _best(_packed(rows, "id", VECTOR_ROWS).join(near, "list"), k)
        return top_k(found, k).withColumn("query_id", F.col("query_id").cast(kind)).select("query_id", "id", "score", "rank")
