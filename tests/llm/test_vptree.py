import duckdb
import numpy as np
import pytest

from lodestone.llm import vptree

from .conftest import collect

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def brute(rows, k=5):
    one = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            one[i] = min(one.get(i, v), v)
    out = []
    for q, v in one.items():
        if q % 50:
            continue
        near = []
        for i, w in one.items():
            if i != q and len(w) == len(v):
                a, b = np.array([v]), np.array([w])
                near.append((-float(vptree.cosine(a, b)[0]), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def run(spark, table, rows):
    out = vptree.query(spark, table("embeddings", [(i, v, 0, -1.0, 9) for i, v in rows], SCHEMA))
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collect(out))


def test_query_equals_brute_force(spark, table):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 460)]  # a common vector: ties by id
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] * 8), (504, [None] + [1.0] * 7), (505, [float("inf")] * 8), (550, [1.0, 2.0]), (551, [2.0, 4.0]), (None, [1.0] * 8), (600, [1e38] * 8), (601, [1e-38] * 8), (3, rows[3][1]), (50, [9.0] * 8)]
    assert run(spark, table, rows) == brute(rows)


def test_few_and_no_rows(spark, table):
    assert run(spark, table, [(0, [1.0, 0.0]), (1, [1.0, 1.0])]) == brute([(0, [1.0, 0.0]), (1, [1.0, 1.0])])


def test_empty_table(spark, table):
    assert run(spark, table, []) == []


@pytest.mark.parametrize("leaf", [4, 64])
def test_factor_one_is_exact_and_larger_ones_trade_recall(monkeypatch, leaf):
    monkeypatch.setattr(vptree, "LEAF", leaf)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 6))
    x = centres[rng.integers(0, 20, 1500)] + 0.05 * rng.normal(size=(1500, 6))
    ids = np.arange(1500)
    tree = vptree.VPTree(x, ids, 6)
    q = x[:40]
    u = vptree._unit(x)
    exact = [set(np.lexsort((ids, -(u @ u[i])))[1:6].tolist()) for i in range(40)]
    found = tree.search(q, ids[:40], 5)[1]
    assert [set(f.tolist()) for f in found] == exact
    loose = tree.search(q, ids[:40], 5, factor=4.0)[1]
    recall = np.mean([len(set(f.tolist()) & e) / 5 for f, e in zip(loose, exact, strict=True)])
    assert 0.3 < recall <= 1


def test_small_shards_have_inner_nodes_too():
    """A shard of the smallest registered run is a tree, not one leaf, and clustered vectors are pruned."""
    rng = np.random.default_rng(3)
    tree = vptree.VPTree(rng.normal(size=(125, 64)), np.arange(125), 6)
    assert tree.vantages >= 3
    centres = rng.normal(size=(20, 6))
    x = centres[rng.integers(0, 20, 1500)] + 0.05 * rng.normal(size=(1500, 6))
    tree = vptree.VPTree(x, np.arange(1500), 6)
    tree.search(x[:40], np.arange(40), 5)
    assert tree.vantages >= 15 and tree.scanned < 0.5 * 40 * 1500


def test_equals_sql_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({vptree.ORACLE})").fetchall())
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collect(vptree.query(spark, d))) == want
