"""Nearest neighbours by cosine with one vantage-point tree per shard.

Vectors are dealt into shards by vec_id; a shard's task builds a tree over its unit vectors: a node
has a vantage point and splits the rest at the median distance to it, keeping for each child the
least and greatest distance. Queries come in blocks from a table in the shared folder, so neither
side is held whole by any task. A child is skipped when its triangle-inequality bound, times
`factor`, exceeds the query's k-th distance so far: factor one is exact, larger ones trade recall
for work. Each shard emits its k nearest of each query; the best k of those remain.

Defined results: vectors that are null, empty or zero, or that hold a null or non-finite component,
take no part, nor do rows with null vec_id; rows sharing a vec_id are one vector, the smallest as an
array; vectors of different length are never compared; equal scores go to the smaller vec_id; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import locate, new_dir

#: Vectors in a shard, points in a leaf (or LEAVES leaves, of a larger shard), queries in a block.
SHARD_ROWS = 20_000
LEAF = 32
LEAVES = 16
BLOCK = 512
#: More than the rounding error of a distance between unit vectors.
SLACK = 1e-7


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows, in double precision; sums run in order of the components."""
    dot = np.cumsum(a * b, axis=1)[:, -1]
    norm = np.sqrt(np.cumsum(a * a, axis=1)[:, -1] * np.cumsum(b * b, axis=1)[:, -1])
    ok = np.isfinite(norm) & (norm > 1e-290) & np.isfinite(dot)
    if not ok.all():  # out of a double's range: scale first
        dot[~ok] = (_unit(a[~ok]) * _unit(b[~ok])).sum(1)
        norm[~ok] = 1
    return dot / norm


class VPTree:
    """A vantage-point tree over the rows of `vectors`, with ids for ties."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, copies: int, seed: int = 42):
        # of equal vectors, only the `copies` with the smallest ids can be among the nearest
        order = np.argsort(ids, kind="stable")
        vectors, ids = np.ascontiguousarray(vectors[order]), ids[order]
        _, same = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
        by = np.argsort(same, kind="stable")
        start = np.r_[0, np.flatnonzero(np.diff(same[by])) + 1]
        place = np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)]))
        keep = np.sort(by[place < copies])
        self.x, self.ids = vectors[keep], ids[keep]
        self.u = _unit(self.x)
        self.rng = np.random.default_rng(seed)
        #: Pairs of a query and a vector that were compared, and vantage points.
        self.scanned = self.vantages = 0
        self.leaf = max(LEAF, len(self.x) // LEAVES)
        self.root = self._build(np.arange(len(self.x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        self.vantages += 1
        vantage = rows[self.rng.integers(len(rows))]
        d = self._distance(self.u[rows] @ self.u[vantage])
        order = np.argsort(d, kind="stable")
        rows, d, half = rows[order], d[order], len(rows) // 2
        return vantage, (d[0], d[half - 1], self._build(rows[:half])), (d[half], d[-1], self._build(rows[half:]))

    @staticmethod
    def _distance(cos: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * cos))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), k a query, best first; missing ones have score -inf. own: ids left out."""
        self.q, self.qu, self.own, self.factor = queries, _unit(queries), own, factor
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(queries)))
        return self.score, self.found

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self._scan(node, active)
            return
        vantage, *children = node
        d = self._distance(self.qu[active] @ self.u[vantage])
        middle = (children[0][1] + children[1][0]) / 2
        near = d <= middle
        for turn in (near, ~near):  # each query's own side first, then the other if its bound allows
            self._enter(children[0] if turn is near else children[1], active[turn], d[turn])
        for turn in (near, ~near):
            self._enter(children[1] if turn is near else children[0], active[turn], d[turn])

    def _enter(self, child, active: np.ndarray, d: np.ndarray) -> None:
        low, high, node = child
        bound = np.maximum(np.maximum(low - d, d - high), 0)
        kth = self.score[active, -1]
        worst = np.where(np.isfinite(kth), self._distance(np.maximum(kth, -1)), np.inf)
        self._visit(node, active[bound * self.factor <= worst + SLACK])

    def _scan(self, rows: np.ndarray, active: np.ndarray) -> None:
        self.scanned += len(active) * len(rows)
        near = self.qu[active] @ self.u[rows].T
        a, b = np.nonzero((near >= self.score[active, -1:] - 1e-9) & (self.own[active][:, None] != self.ids[rows][None]))
        if not len(a):
            return
        exact = cosine(self.q[active[a]], self.x[rows[b]])
        k = self.score.shape[1]
        of = np.r_[np.repeat(active, k), active[a]]
        score, ids = np.r_[self.score[active].ravel(), exact], np.r_[self.found[active].ravel(), self.ids[rows[b]]]
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        start = np.r_[0, np.flatnonzero(np.diff(of)) + 1]
        place = np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))
        keep = place < k
        self.score[of[keep], place[keep]], self.found[of[keep], place[keep]] = score[keep], ids[keep]


def _matrix(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, dtype=np.float64) for v in column.to_pylist()]


def _by_length(ids: np.ndarray, vectors: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lengths = np.array([len(v) for v in vectors])
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        yield int(n), ids[own], np.stack([vectors[i] for i in own])


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of `vectors` nearest to each row of `queries`.

    Both have vec_id and embedding; a query's own vec_id is never among its neighbours.
    """
    spark = vectors.sparkSession
    usable = "vec_id is not null and embedding is not null and forall(embedding, e -> e is not null and not isnan(e) and abs(e) < double('infinity')) and exists(embedding, e -> e <> 0)"
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable)
    queries = queries.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable)
    path = new_dir(spark, "vptree-queries") + "/table"
    queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).write.parquet(path)
    shards = max(spark.sparkContext.defaultParallelism, vectors.count() // SHARD_ROWS + 1)

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.dataset as ds

        one: dict[int, list[float]] = {}
        for i, v in zip(table.column("vec_id").to_pylist(), table.column("embedding").to_pylist(), strict=True):
            one[i] = min(one[i], v) if i in one else v
        ids = np.fromiter(one, dtype=np.int64, count=len(one))
        trees = {n: VPTree(x, own, k + 1) for n, own, x in _by_length(ids, [np.asarray(v) for v in one.values()])}
        fs, where = locate(path)
        out = []
        for batch in ds.dataset(where, filesystem=fs, format="parquet").to_batches(batch_size=BLOCK, batch_readahead=1, fragment_readahead=1):
            if not batch.num_rows:
                continue
            for n, own, q in _by_length(batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding"))):
                if n in trees:
                    score, found = trees[n].search(q, own, k, factor)
                    a, b = np.nonzero(np.isfinite(score))
                    out.append(pa.table({"query_id": own[a], "vec_id": found[a, b], "score": score[a, b]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")
    found = vectors.select(shard, "vec_id", "embedding").groupBy("shard").applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the five nearest of every fiftieth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
