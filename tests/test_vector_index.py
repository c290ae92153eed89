"""The stored vector index against comparing with all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators.vector_index import VectorIndex

DIR = "/root/testdata/sf0.01"


def exact(vectors, queries, k, allowed=None):
    """(query, id, rank) by plain cosine, rounded as the index rounds."""
    def good(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ids = sorted((i for i, v in vectors.items() if good(v) and len(v) == 16 and (allowed is None or i in allowed)))
    m = np.array([np.array(vectors[i], float) / np.linalg.norm(vectors[i]) for i in ids])
    out = []
    for q, v in queries.items():
        if good(v) and len(v) == 16:
            s = m @ (np.array(v, float) / np.linalg.norm(v))
            out += [(q, i, n) for n, (_, i) in enumerate(sorted(zip(-np.round(s, 6), ids))[:k], 1)]
    return sorted(out)


def clustered(seed, n=3000, groups=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 16))
    rows = {f"v{i:05}": [float(x) for x in centres[i % groups] + 0.25 * rng.normal(size=16)] for i in range(n)}
    return rows | {"zero": [0.0] * 16, "none": None, "short": [1.0, 2.0], "gap": [1.0, None] + [1.0] * 14, "nan": [float("nan")] * 16}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = clustered(1)
    table = spark.createDataFrame([(i, v, "even" if n // 40 % 2 == 0 else "odd") for n, (i, v) in enumerate(rows.items())], "id string, vector array<double>, kind string").cache()
    index = VectorIndex(spark, f"file://{tmp_path_factory.mktemp('vectors')}")
    index.replace(table, facets=("kind",))
    return rows, table, index


def asked(spark, rows):
    queries = {n: v for n, (i, v) in enumerate(rows.items()) if n % 50 == 0} | {9001: None, 9002: [0.0] * 16, 9003: [1.0] * 3}
    return queries, spark.createDataFrame(list(queries.items()), "query_id long, vector array<double>")


def result(df):
    return sorted((r["query_id"], r["id"], r["rank"]) for r in df.collect())


def test_all_lists_are_exact(spark, made):
    rows, table, index = made
    queries, frame = asked(spark, rows)
    assert result(index.search(frame, 10, probes=10**6)) == exact(rows, queries, 10)
    odd = {r["id"] for r in table.where("kind = 'odd'").collect()}
    assert result(index.search(frame, 10, F.col("kind") == "odd", probes=10**6)) == exact(rows, queries, 10, odd)


def test_recall_with_few_lists_of_clustered_vectors(spark, made):
    rows, _, index = made
    queries, frame = asked(spark, rows)
    state = index.state()
    assert state["rows"] == 3000 and state["probes"] < 0.1 * state["centroids"]
    found = {x[:2] for x in result(index.search(frame, 10))}
    want = {x[:2] for x in exact(rows, queries, 10)}
    assert len(found & want) >= 0.9 * len(want)
    # a filter is applied before the best are chosen: no query comes out short
    odd = result(index.search(frame, 10, F.col("kind") == "odd"))
    assert len(odd) == len(want) and {i for _, i, _ in odd} <= {r["id"] for r in index.rows().where("kind = 'odd'").collect()}


def test_only_lists_asked_for_are_read(spark, made):
    rows, _, index = made
    few = index.state()["lists"][:3]
    assert {int(f.split("list=")[1].split("/")[0]) for f in index.rows(few).inputFiles()} == set(few)
    assert index.rows().count() == 3000


def test_recall_of_the_given_vectors(spark, tmp_path):
    """They form no clusters: the measured number of lists is large, and recall holds."""
    table = spark.read.parquet(f"{DIR}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label")
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    index.replace(table, facets=("label",))
    q = table.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    near, all_ = (index.search(q, 10, probes=p) for p in (None, 10**6))
    a, b = ({(r["query_id"], r["id"]) for r in x.collect()} for x in (near, all_))
    assert len(a & b) >= 0.9 * len(b)
    assert index.state()["probes"] < index.state()["centroids"]


def test_replaced_and_empty(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    with pytest.raises(KeyError):
        index.search(q, 3)
    schema = "id string, vector array<double>"
    index.replace(spark.createDataFrame([], schema))
    assert index.search(q, 3).collect() == []
    index.replace(spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", [3.0, 0.0])], schema))
    assert result(index.search(q, 3, probes=10)) == [(1, "a", 1), (1, "c", 3), (1, "d", 2)]
