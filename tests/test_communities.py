"""Communities found in parallel against greedy merging and brute force; places over many tasks against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import communities, graph, ordering


def plain_modularity(edges, part):
    total = sum(w for _, _, w in edges)
    adjacent = {}
    for a, b, w in edges:
        adjacent[a, b] = adjacent.get((a, b), 0) + w
        adjacent[b, a] = adjacent.get((b, a), 0) + w
    degree = dict.fromkeys(part, 0)
    for (a, _), w in adjacent.items():
        degree[a] += w
    return sum(adjacent.get((i, j), 0) - degree[i] * degree[j] / (2 * total) for i in part for j in part if part[i] == part[j]) / (2 * total)


def planted(seed, groups, size, n):
    dice, found = random.Random(seed), {}
    for _ in range(n):
        a = dice.randrange(groups * size)
        b = a // size * size + dice.randrange(size) if dice.random() < 0.75 else dice.randrange(groups * size)
        found[min(a, b), max(a, b)] = found.get((min(a, b), max(a, b)), 0) + 1
    return [(a, b, w) for (a, b), w in found.items()]


@pytest.fixture(scope="module")
def found(spark):
    star = [(0, i, 1) for i in range(1, 60)]
    graphs = {1: planted(3, 8, 12, 500), 2: star, 3: [(1, 2, 5)], 4: [(7, 7, 2)]}
    rows = [(r, a, b, w) for r, edges in graphs.items() for a, b, w in edges]
    # turned, split, without an end, without weight
    rows += [(3, 2, 1, 1), (3, None, 1, 4), (3, 1, 9, 0)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    table = spark.createDataFrame(rows, "repo_id int, a long, b long, weight long").repartition(8)
    members = communities.merged(table).cache()
    part = {}
    for r in members.collect():
        assert r["id"] not in part.setdefault(r["repo_id"], {})
        part[r["repo_id"]][r["id"]] = r["community"]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    return graphs, table, members, part


def test_modularity_is_that_of_brute_force_and_near_greedy(found):
    graphs, table, members, part = found
    told = {r["repo_id"]: r["modularity"] for r in communities.modularity(table.where("repo_id < 3 or repo_id = 4"), members).collect()}
    for repo in (1, 2):
        edges = [e for e in graphs[repo] if e[0] != e[1]]
        assert set(part[repo]) == {x for a, b, _ in graphs[repo] for x in (a, b)}
        assert told[repo] == pytest.approx(plain_modularity(graphs[repo], part[repo]), abs=1e-9)
        greedy = graph.greedy_modularity([(a, b, float(w)) for a, b, w in edges])
        own = {x: part[repo][x] for x in greedy}
        assert plain_modularity(edges, own) >= 0.98 * plain_modularity(edges, greedy) - 1e-9


def test_communities_are_named_by_their_least_node(found):
    part = found[3]
    for own in part.values():
        assert all(c == min(x for x in own if own[x] == c) for c in own.values())
    assert len(set(part[1].values())) in range(6, 11)
    assert part[3] == {1: 1, 2: 1} and part[4] == {7: 7} and set(part[2].values()) == {0}


def test_no_edges(spark):
    empty = spark.createDataFrame([], "repo_id int, a long, b long, weight long")
    assert communities.merged(empty).count() == 0


def test_places_of_one_group_come_from_many_tasks(spark, monkeypatch):
    dice = random.Random(5)
    rows = [(None if i % 11 == 0 else 1, dice.randrange(50), i) for i in range(4000)]
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    kept = []
    cut = ordering.cut
    monkeypatch.setattr(ordering, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    table = spark.createDataFrame(rows, "repo_id int, x int, id long")
    out = ordering.numbered(table, ("repo_id",), F.desc("x"), "id").collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    for repo in (None, 1):
        want = sorted(((-x, i) for r, x, i in rows if r == repo))
        got = sorted((r for r in out if r["repo_id"] == repo), key=lambda r: r["place"])
        assert [r["place"] for r in got] == list(range(1, len(want) + 1))
        assert [(-r["x"], r["id"]) for r in got] == want
    sizes = [r["count"] for r in kept[0].where("repo_id = 1").groupBy(F.shiftright("__id", 33)).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1000
    assert ordering.numbered(table.where("id < 0"), ("repo_id",), "x").count() == 0


def test_parts_are_joined_without_a_broadcast(spark):
    rows = spark.createDataFrame([(1, 2, 3, 1)], "repo_id int, a long, b long, weight long")
    merges = spark.createDataFrame([(1, 3, 2)], "repo_id int, x long, hub long")
    plan = communities._folded(rows, merges)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_large_graph_is_merged_in_parallel_and_in_no_task(spark, monkeypatch):
    edges = planted(3, 4, 6, 120)
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    symbols = spark.createDataFrame([(1, x, "function", "src/a.py") for x in nodes], "repo_id int, id long, kind string, file_path string")
    table = spark.createDataFrame([(1, a, b, "call", w) for a, b, w in edges if a != b], "repo_id int, src long, dst long, edge_type string, tenths long")
    small = graph.communities(table, symbols, least=1).collect()
    monkeypatch.setattr(graph, "greedy_modularity", None)
    large = graph.communities(table, symbols, least=1, most_edges=10).collect()
    want = communities.merged(graph.weighted_graph(table, symbols)).collect()
    assert sorted(map(tuple, large)) == sorted(map(tuple, want))
    assert sorted(r["id"] for r in large) == sorted(r["id"] for r in small)
