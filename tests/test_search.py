"""The whole jobs of vector and fused search: every hundredth vector and every benchmark item."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval
from lodestone.plans import catalogue

DIR = "/root/testdata/sf0.001"


def run(spark, name):
    return sorted(tuple(r) for r in catalogue.QUERIES[name](spark, DIR).collect())


def nearest(spark, k, label=None):
    rows = sorted((r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect())
    unit = {i: np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) for i, v, _ in rows}
    out = []
    for q in [i for i in unit if i % 100 == 0]:
        order = sorted((-round(float(unit[i] @ unit[q]), 6), i) for i, _, x in rows if label is None or x == label)
        out += [(q, i, n) for n, (_, i) in enumerate(order[:k], 1)]
    return sorted(out)


def test_every_hundredth_vector_is_a_query(spark):
    assert run(spark, "j03_knn_topk") == nearest(spark, 5)
    assert run(spark, "j04_knn_prefiltered") == nearest(spark, 5, 3)
    labels = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    assert run(spark, "j04_knn_postfiltered") == [x for x in nearest(spark, 20) if labels[x[1]] == 3]


@pytest.mark.parametrize(("name", "depth", "keep", "apart"), [("j06_rrf", 20, 5, False), ("j08_cross_stream", 15, 8, True)])
def test_fusion_has_every_benchmark_item(spark, name, depth, keep, apart):
    words = catalogue._bm25(spark, DIR, depth).select("query_id", "id", "rank").collect()
    lists = [("doc" if apart else "", *r) for r in words] + [("vector" if apart else "", *r) for r in nearest(spark, depth)]
    score = {}
    for source, query, i, rank in lists:
        own = score.setdefault(query, {})
        own[source, i] = own.get((source, i), 0) + 1 / (60 + rank)
    want = []
    for query, own in score.items():
        best = sorted((-round(s, 12), source, i) for (source, i), s in own.items())[:keep]
        want += [(query, *((source,) if apart else ()), i, n) for n, (_, source, i) in enumerate(best, 1)]
    assert run(spark, name) == sorted(want)
    assert {r[0] for r in want} > set(range(10))


def test_blocks_equal_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_ROWS", 7)
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None), (62, [1.0, None, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = v.where("id % 6 = 0").select(F.col("id").alias("query_id"), "vector")
    for k in (5, 63):
        a, b = (sorted((r["query_id"], r["id"], r["rank"]) for r in f(v, q, k).collect()) for f in (retrieval.knn, retrieval.knn_blocks))
        assert a == b


def test_words_are_scored_where_their_document_is(spark):
    docs = spark.createDataFrame([(i, f"the cat{i % 7} the") for i in range(50)] + [(50, None), (51, "")], "id long, text string")
    asked = spark.createDataFrame([(0, "The cat3"), (1, "cat5 none"), (2, None)], "query_id int, text string")
    found = retrieval.bm25(docs, asked)
    moves = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert any("hashpartitioning(id" in x for x in moves) and not any("hashpartitioning(query_id" in x for x in moves)
    assert found.where("query_id = 0").count() == 50 and found.where("query_id = 1").count() == 7 and found.count() == 57


def test_a_worker_is_given_few_pairs_of_blocks(spark):
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    retrieval.knn_blocks(v, v.toDF("query_id", "vector"), 1)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == retrieval.BATCH_BYTES


def test_words_are_cut_once_and_gold_is_found_once(spark):
    """Texts are read by one scan for scores and by one for gold, and nothing is exploded by word."""
    plan = catalogue.QUERIES["k25_localization_metrics"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Generate" not in plan
    assert sum("Relation" in x and "text" in x for x in plan.splitlines()) == 1


def test_bm25_of_repeated_rows_and_pruned_rows(spark):
    rows = [(i % 40, f"cat{i % 3} dog {'cat1 ' * (i % 5)}") for i in range(100)] + [(None, "cat1"), (7, ""), (8, None)] + [(200, "dog dog")] * 2
    docs = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([("a", "cat1 dog"), ("b", "cat2"), ("b", "DOG cat2"), ("c", "")], "query_id string, text string")
    found = {(r["query_id"], r["id"]): r["score"] for r in retrieval.bm25(docs, asked).collect()}
    texts = [(i, (t or "").lower().split()) for i, t in rows if t]
    n, avgdl = len(texts), sum(len(w) for _, w in texts) / len(texts)
    tf = {}
    for i, words in texts:
        for w in words:
            tf[i, len(words), w] = tf.get((i, len(words), w), 0) + 1
    want = {}
    for q, t in (("a", "cat1"), ("a", "dog"), ("b", "cat2"), ("b", "dog"), ("b", "cat2")):
        df = sum(w == t for _, _, w in tf)
        for (i, dl, w), x in tf.items():
            if w == t:
                want[q, i] = want.get((q, i), 0) + np.log(1 + (n - df + 0.5) / (df + 0.5)) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    for k in (1, 3, 500):
        best = [sorted(tuple(r) for r in retrieval.top_k(s, k).select("query_id", "id", "rank").where("id is not null").collect()) for s in (retrieval.bm25(docs, asked), retrieval.bm25(docs, asked, k=k))]
        assert best[0] == best[1]


def test_containing(spark):
    docs = spark.createDataFrame([(1, "one two\u00a0x three  four five six"), (2, "wone two three four fives"), (3, None), (4, "one")], "id long, text string")
    items = spark.createDataFrame([(1, "one two three four five"), (2, "three  four five s"), (3, "one"), (4, None), (5, ""), (6, "e two three four f")], "item_id int, item_text string")
    got = {(r["item_id"], r["id"]) for r in retrieval.containing(docs, items).collect()}
    assert got == {(1, 2), (2, 1), (3, 1), (3, 2), (3, 4), (5, 1), (5, 2), (5, 4), (6, 2)}
