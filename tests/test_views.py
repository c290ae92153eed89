"""Views, stored postings, capped walks, texts that contain items: against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import findings, graph, inverted, mining, retrieval, views


def edges(spark, *pairs):
    return spark.createDataFrame([(1, a, b, "call", 10) for a, b in pairs], "repo_id int, src long, dst long, edge_type string, tenths int")


def plain_capped(pairs, start, depth, most):
    seen, layer = {}, {start}
    for d in range(1, depth + 1):
        new = sorted({b for a, b in pairs if a in layer and a != b} - set(seen) - {start})
        new = new[: max(0, most - len(seen))]
        if not new:
            break
        seen |= dict.fromkeys(new, d)
        layer = set(new)
    return seen


@pytest.mark.parametrize(("seed", "most"), [(1, 60), (2, 5), (3, 1), (4, 9)])
def test_capped_walks(spark, seed, most):
    rng = random.Random(seed)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(90)}
    found = graph.capped_reach(edges(spark, *pairs), spark.range(0, 30, 7), 3, most).collect()
    for start in range(0, 30, 7):
        assert {r["node"]: r["depth"] for r in found if r["start"] == start} == plain_capped(pairs, start, 3, most)


def test_a_walk_without_edges(spark):
    assert graph.reach(edges(spark, (1, 2)), spark.range(5, 6), 3).count() == 0
    assert graph.capped_reach(edges(spark, (5, 5)), spark.range(5, 6), 3).count() == 0


def test_texts_that_contain_items(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=60))) for i in range(80)] + [(90, ""), (91, None), (92, "w1  w2\nw3 w4 w5 w6")]
    items = []
    for i in range(60):
        text = rng.choice(docs[:80])[1]
        a = rng.randrange(len(text) - 40)
        items.append((i, text[a : a + rng.choice([3, 9, 20, 40])]))
    items += [(100, "w1 w2"), (101, "w1  w2\nw3 w4 w5"), (102, "not there at all in any of them")]
    found = retrieval.containing(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"))
    want = sorted((i, j) for i, item in items for j, text in docs if text is not None and item in text)
    assert sorted(map(tuple, found.collect())) == want


def test_stored_postings_are_replaced_and_filtered(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "x", "c"), (2, "a a", "y", "c"), (3, "b", "a", "d")], "id long, title string, text string, kind string")
    index = inverted.InvertedIndex(spark, f"file://{tmp_path}/index")
    index.replace(docs.limit(1), ["title", "text"], facets=("kind",))
    index.replace(docs, ["title", "text"], facets=("kind",))
    asked = spark.createDataFrame([(0, "a")], "query_id int, text string")
    boosts = {"title": 2.0, "text": 1.0}
    got = [(r["id"], r["score"]) for r in index.search(asked, boosts, 5).orderBy("rank").collect()]
    plain = docs.withColumn("id", F.col("id").cast("string"))
    want = [(r["id"], r["score"]) for r in retrieval.top_k(retrieval.bm25_fields(plain, asked, boosts), 5).orderBy("rank").collect()]
    assert got == want and len(got) == 3
    only = {r["id"]: r["score"] for r in index.search(asked, boosts, 5, F.col("kind") == "d").collect()}
    assert only == {"3": dict(want)["3"]}  # the filter does not change the statistics


def test_bm25_of_null_empty_and_repeated_texts(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, None), (3, ""), (4, "cat cat"), (5, "cat dog")], "id long, text string")
    asked = spark.createDataFrame([(0, "Cat cat"), (1, "nothing"), (2, None)], "query_id int, text string")
    rows = retrieval.top_k(retrieval.bm25(docs, asked), 5).collect()
    assert [(r["query_id"], r["id"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(0, 4), (0, 1), (0, 5)]


def test_fusing_keeps_the_last_source_and_the_first_seen_order(spark):
    schema = "query_id int, id string, rank int, source string"
    a = spark.createDataFrame([(0, "a", 1, "A"), (0, "b", 2, "A")], schema)
    b = spark.createDataFrame([(0, "b", 1, "B"), (0, "a", 2, "B"), (0, "c", 3, "B")], schema)
    rows = retrieval.fuse([a, b]).orderBy("rank").collect()
    assert [(r["id"], r["source"]) for r in rows] == [("a", "B"), ("b", "B"), ("c", "B")]


def test_too_many_queries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 2)
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "id long, vector array<double>")
    with pytest.raises(ValueError):
        retrieval.knn(v, v.withColumnRenamed("id", "query_id"), 1)


def test_first_seen_and_order(spark):
    rows = spark.createDataFrame([(1, 5, "x"), (2, 3, "y"), (1, 2, "z"), (None, 9, "n")], "id long, rank int, t string")
    assert {r["id"]: (r["rank"], r["t"]) for r in views.first_seen(rows, ["id"], "rank").collect()} == {1: (2, "z"), 2: (3, "y"), None: (9, "n")}
    assert [r["id"] for r in views.first_seen(rows, ["id"], "rank", 2).orderBy("rank").collect()] == [1, 2]


def test_steps_of_what_is_not_reached(spark):
    pairs, nodes = edges(spark, (1, 2), (2, 3), (3, 1)), spark.range(1, 6)
    assert {r["id"]: r["step"] for r in views.steps(pairs, nodes, 1).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1}
    assert {r["id"]: r["step"] for r in views.steps(pairs, nodes, 1, trailing=True).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}


def test_a_large_commit_is_never_gathered(spark):
    commits = spark.createDataFrame([(1, f"c{i}") for i in range(8)], "repo_id int, sha string").withColumn("authored_at", F.lit("2024-01-01").cast("timestamp"))
    files = [(1, f"c{i}", p) for i in range(4) for p in ("a", "b", "a")] + [(1, "c5", f"f{i}") for i in range(21)] + [(1, "c6", "a")]
    rows = mining.coupling(commits, spark.createDataFrame(files, "repo_id int, sha string, path string")).collect()
    assert [(r["a"], r["b"], r["co_changes"], r["strength"]) for r in rows] == [("a", "b", 4, 1.0)]


def test_snippets_and_refusals(spark):
    files = spark.createDataFrame([(1, "a.py", "\n".join(f"line{i}" for i in range(1, 101)))], "repo_id int, path string, content string")
    found = spark.createDataFrame([(1, i, "a.py", a, b, "new" if i else "ticketed") for i, (a, b) in enumerate([(2, 4), (1, 100), (200, 210), (0, 1)])] + [(1, 9, "b.py", 1, 2, "new")], "repo_id int, id long, file_path string, start_line long, end_line long, status string")
    got = {r["id"]: r["snippet"] for r in findings.with_files(found, files).collect()}
    assert got[0] == "line2\nline3\nline4" and got[1].endswith("line46\n…") and got[2] == "" and got[3] == "line1" and got[9] == ""
    assert [findings.refusal(found, i) for i in (0, 1, 77)] == [409, None, 404]


def test_lines_and_strips(spark):
    row = spark.createDataFrame([("\n a\r\nb\r \t",)], "x string").select(T.strip(F.col("x")).alias("s"), T.plain_newlines(F.col("x")).alias("n"), T.line_count(F.col("x")).alias("l"), T.line_count(F.lit("")).alias("e")).first()
    assert (row["s"], row["n"], row["l"], row["e"]) == ("a\r\nb", "\n a\nb\n \t", 3, 0)
