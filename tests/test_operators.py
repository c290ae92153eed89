from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators import agent, codemap, evaluation, findings, graph, mining, retrieval, wiki

EDGE = "repo_id int, src long, dst long, edge_type string, tenths int"
SYMBOL = "repo_id int, id long, file_path string, kind string, name string, qualified_name string, start_line int, signature string, code string"


def edges(spark, *pairs, kind="call", tenths=10):
    return spark.createDataFrame([(1, p[0], p[1], kind, p[2] if len(p) > 2 else tenths) for p in pairs], EDGE)


def symbols(spark, *rows):
    full = [(1, i, path, kind, name, qual or name, 1, f"def {name}()", code or f"def {name}(): pass") for i, path, kind, name, qual, code in rows]
    return spark.createDataFrame(full, SYMBOL)


def history(spark, *commits):
    """commits: lists of paths; the last is the newest."""
    day = datetime(2024, 1, 1)
    c = spark.createDataFrame([(1, i, day + timedelta(days=i)) for i in range(len(commits))], "repo_id int, sha int, authored_at timestamp")
    f = spark.createDataFrame([(1, i, p) for i, ps in enumerate(commits) for p in ps], "repo_id int, sha int, path string")
    return c, f


def test_coupling(spark):
    c, f = history(spark, ["x", "y"], ["x", "y"], ["y", "x"], ["x", "z"], ["y"])
    (row,) = mining.coupling(c, f).collect()
    assert (row["a"], row["b"], row["co_changes"], row["support_a"], row["support_b"], row["strength"]) == ("x", "y", 3, 4, 3, 1.0)
    assert mining.change_window(c, f).first()["windowed"] is False


def test_coupling_ignores_large_commits_and_noise(spark):
    c, f = history(spark, *[[f"f{i}" for i in range(21)]] * 3, *[["a", "uv.lock"]] * 3)
    assert mining.coupling(c, f).count() == 0


def test_coupling_of_nothing(spark):
    c, f = history(spark)
    assert mining.coupling(c, f).count() == 0


def test_edge_tiers(spark):
    s = symbols(spark, (1, "a.py", "function", "one", "", ""), (2, "a.py", "function", "two", "", ""), (3, "b.py", "function", "two", "", ""), (4, "c.py", "class", "Base", "", ""), (5, "c.py", "method", "m", "Base.m", ""), (6, "d.py", "class", "Sub", "", ""), (7, "d.py", "method", "go", "Sub.go", ""), *[(20 + i, f"x{i}.py", "function", "many", "", "") for i in range(9)])
    refs = spark.createDataFrame(
        [(1, 7, "plain", None, "one"), (1, 7, "plain", None, "two"), (1, 7, "plain", None, "many"), (1, 7, "self", None, "m"), (1, 7, "receiver", "Base", "m"), (1, 7, "receiver", "x", "one"), (1, 6, "base", None, "Base"), (1, 1, "plain", None, "one"), (1, 7, "plain", None, "len")],
        "repo_id int, src long, kind string, receiver string, name string",
    )
    found, counters = graph.resolve_references(refs, s)
    assert {(r["src"], r["dst"], r["edge_type"]): r["tenths"] for r in found.collect()} == {(7, 1, "call"): 10, (7, 2, "call"): 5, (7, 3, "call"): 5, (7, 5, "call"): 9, (6, 4, "inherit"): 10}
    assert {r["tier"]: r["references"] for r in counters.collect()} == {"exact": 2, "fuzzy": 2, "receiver": 2, "inherit": 1, "unresolved": 1}


def test_edges_to_bases_are_not_moved(spark, monkeypatch):
    """Pairs of a base's references and classes are no shuffled rows; a class of two names is met once, by the most confident."""
    monkeypatch.setattr(graph, "BLOCK_REFERENCES", 3)
    monkeypatch.setattr(graph, "TASK_EDGES", 10)
    rows = [(i, "a.py", "class", "Same", "", "") for i in range(20)] + [(20, "a.py", "class", "One", "", ""), (21, "b.py", "class", "B", "", ""), (21, "b.py", "class", "A", "", ""), (21, "b.py", "class", "A", "", "")]
    s = symbols(spark, *rows)
    refs = spark.createDataFrame([(1, i, "base", None, n) for i in range(20) for n in ("Same", "One", "A", "B", "Missing")], "repo_id int, src long, kind string, receiver string, name string")
    found, counters = graph.resolve_references(refs, s)
    got = sorted((r["src"], r["dst"], r["name"], r["tenths"]) for r in found.collect())
    same = [(i, j, "Same", 6) for i in range(20) for j in range(20) if i != j]
    assert got == sorted(same + [(i, 20, "One", 10) for i in range(20)] + [(i, 21, "B", 10) for i in range(20)])
    assert {r["tier"]: r["references"] for r in counters.collect()} == {"inherit": 80}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    direct = [x for x in plan.splitlines() if "Aggregate [repo_id" in x and "src" in x and "edge_type" in x]
    assert len(direct) == 2  # calls, and classes of several names
    before = graph.base_edges(refs.select("repo_id", "src", "name"), s.select("repo_id", "name", F.col("id").alias("dst")), s.groupBy("repo_id", "name").agg(F.count("*").alias("n")))
    assert before.rdd.getNumPartitions() > 40


def test_method_resolution_is_depth_first_and_ends_in_cycles(spark):
    s = symbols(spark, (1, "a", "method", "m", "C.m", ""), (2, "a", "method", "m", "D.m", ""), (3, "a", "method", "k", "A.k", ""))
    bases = spark.createDataFrame([(1, "A", "B"), (1, "A", "D"), (1, "B", "C"), (1, "C", "A")], "repo_id int, owner string, base string")
    found = {(r["owner"], r["method"]): r["id"] for r in graph.method_table(s, bases).collect()}
    assert found["A", "m"] == 1  # A, B, C comes before A, D
    assert found["C", "k"] == 3 and found["D", "m"] == 2


def test_unfinished_method_tables_are_errors(spark):
    """A chain of 40 classes resolves to its end, and a bound that is too low raises."""
    s = symbols(spark, (1, "a", "method", "m", "C40.m", ""))
    bases = spark.createDataFrame([(1, f"C{i}", f"C{i + 1}") for i in range(40)], "repo_id int, owner string, base string")
    owners = spark.createDataFrame([(1, "C0")], "repo_id int, owner string")
    assert [(r["owner"], r["id"]) for r in graph.method_table(s, bases, owners).collect()] == [("C0", 1)]
    with pytest.raises(RuntimeError, match="rounds"):
        graph.method_table(s, bases, owners, rounds=32)


def test_call_path(spark):
    rows = graph.call_path(edges(spark, (1, 2), (2, 3), (3, 1)), 1).collect()
    assert sorted((r["depth"], r["node"]) for r in rows) == [(0, 1), (1, 2), (2, 3)]


def test_call_flow_caps(spark):
    nodes, links = graph.call_flow(edges(spark, *[(1, i) for i in range(2, 11)]), 1)
    assert (len(nodes), len(links)) == (9, 8)
    nodes, links = graph.call_flow(edges(spark, (1, 2), (1, 3), (2, 1)), 1, max_nodes=2)
    assert [n for n, _ in nodes] == [1, 2] and [(a, b) for a, b, _ in links] == [(1, 2)]
    assert graph.call_flow(edges(spark, (5, 6)), 1) == ([(1, 0)], [])


def test_reach_keeps_a_start_on_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "id long")
    assert sorted(tuple(r) for r in graph.reach(e, start, 3).collect()) == [(1, 1, 2), (1, 2, 1)]


def test_shortest_path(spark):
    e = edges(spark, (1, 2), (3, 2), (3, 4), (9, 8))
    assert graph.shortest_path(e, 1, 4) == [1, 2, 3, 4]
    assert graph.shortest_path(e, 1, 1) == [1]
    assert graph.shortest_path(e, 1, 9) is None


def test_shortest_path_has_no_limit(spark):
    e = edges(spark, *[(i, i + 1) for i in range(1, 15)])
    assert graph.shortest_path(e, 1, 15) == list(range(1, 16))
    assert graph.shortest_path(e, 1, 15, limit=13) is None


def test_communities():
    clique = [(a, b, 1.0) for a in range(4) for b in range(a)]
    both = clique + [(a + 10, b + 10, 1.0) for a, b, _ in clique] + [(0, 10, 0.5)]
    found = graph.greedy_modularity(both)
    assert {frozenset(x for x in found if found[x] == c) for c in found.values()} == {frozenset(range(4)), frozenset(range(10, 14))}


def test_communities_table(spark):
    pairs = [(a, b) for a in range(4) for b in range(a)]
    s = symbols(spark, *[(i, "src/a/x.py", "class" if i == 0 else "function", f"n{i}", "", "") for i in range(4)], (9, "tests/t.py", "function", "t", "", ""))
    e = edges(spark, *pairs, (0, 9))
    (row,) = graph.describe_communities(graph.communities(e, s), e, s).collect()
    assert (row["size"], row["label"], row["folders"]) == (4, "n0", 1)


def test_dead_code(spark):
    s = symbols(spark, (1, "a.py", "function", "_f", "", ""), (2, "a.py", "function", "g", "", ""), (3, "a.py", "method", "__init__", "", ""), (4, "a.py", "function", "h", "", "  @x\ndef h(): pass"), (5, "a.py", "function", "test_x", "", ""), (6, "tests/a.py", "function", "k", "", ""), (7, "a.py", "class", "C", "", ""), (8, "a.py", "function", "used", "", ""))
    found = mining.dead_code(s, edges(spark, (2, 8))).collect()
    assert {r["qualified_name"]: r["visibility"] for r in found} == {"_f": "private", "g": "public"}


@pytest.mark.parametrize(("fan_in", "fan_out", "role"), [(8, 2, "hot core"), (3, 1, "foundational"), (1, 9, "orchestration"), (1, 1, "leaf / utility")])
def test_folder_roles(spark, fan_in, fan_out, role):
    df = spark.createDataFrame([(fan_in, fan_out)], "i int, o int")
    assert df.select(mining.folder_role(F.col("i"), F.col("o"), F.col("i") / (F.col("i") + F.col("o"))).alias("r")).first()["r"] == role


@pytest.mark.parametrize(("fan_in", "tests", "entry", "level"), [(0, 0, False, "low"), (0, 0, True, "medium"), (3, 0, False, "high"), (1, 0, False, "medium"), (6, 1, False, "medium"), (2, 1, False, "low")])
def test_risk(spark, fan_in, tests, entry, level):
    df = spark.createDataFrame([(fan_in, tests, entry)], "i int, t int, e boolean")
    assert df.select(mining.risk(F.col("i"), F.col("t"), F.col("e")).alias("r")).first()["r"] == level


def test_entrypoints(spark):
    code = {1: '@app.get("/x")\ndef a(): pass', 2: "@click.command()\ndef b(): pass", 3: "@shared_task\ndef c(): pass", 6: "@app.route(path)\ndef r(): pass"}
    s = symbols(spark, *[(i, "src/a.py", "function", n, "", code.get(i, "")) for i, n in ((1, "a"), (2, "b"), (3, "c"), (4, "create_app"), (5, "main"), (6, "r"), (7, "other"))], (8, "tests/t.py", "function", "main", "", ""))
    files = spark.createDataFrame([(1, "run.py", "code", "x\nif __name__ == '__main__':\n  main()"), (1, "lib.py", "code", "x")], "repo_id int, path string, category string, content string")
    found = {(r["kind"], r["label"], r["line"]) for r in mining.entrypoints(s, files).collect()}
    assert found == {("route", "/x", 1), ("cli", "b", 1), ("worker", "c", 1), ("factory", "create_app", 1), ("main", "main", 1), ("route", "r", 1), ("module", "run.py", 2)}


def test_rrf(spark):
    lists = spark.createDataFrame([(0, "x", i, r) for r, i in enumerate("abc", 1)] + [(0, "y", i, r) for r, i in enumerate("ca", 1)], "query_id int, list string, id string, rank int")
    fused = {r["id"]: r["score"] for r in retrieval.rrf(lists).collect()}
    assert fused == pytest.approx({"a": 1 / 61 + 1 / 62, "c": 1 / 63 + 1 / 61, "b": 1 / 62})
    assert [r["id"] for r in retrieval.top_k(retrieval.rrf(lists), 3, places=12).orderBy("rank").collect()] == ["a", "c", "b"]


def test_hybrid_and_embedder(spark):
    docs = spark.createDataFrame([("1", "red bolt"), ("2", "blue nut"), ("3", None)], "id string, text string")
    asked = spark.createDataFrame([(0, "blue nut")], "query_id int, text string")
    e = retrieval.HashingEmbedder(16)
    v = retrieval.embed(docs, e)
    q = spark.createDataFrame([(0, e.embed(["blue nut"])[0])], "query_id int, vector array<double>")
    assert retrieval.hybrid(docs, asked, v, q).where("rank = 1").first()["id"] == "2"
    assert [r["id"] for r in retrieval.hybrid(docs, asked, None, None).collect()] == ["2"]


def test_metrics(spark):
    p = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "b", 3), (0, "c", 4)], "query_id int, item string, rank int")
    g = spark.createDataFrame([(0, "b"), (0, "z"), (1, "q")], "query_id int, item string")
    rows = {r["query_id"]: r for r in evaluation.localisation(p, g).collect()}
    assert (rows[0]["recall_1"], rows[0]["recall_3"], rows[0]["hit_3"], rows[0]["mrr"]) == (0.0, 0.5, 1, 0.5)
    assert rows[1]["mrr"] == 0.0
    assert evaluation.summarise(evaluation.localisation(p, g)).first()["mrr"] == 0.25


GOOD = {"title": "t", "description": "d", "category": "Logic", "severity": "HIGH", "start_line": 5, "end_line": 7}


@pytest.mark.parametrize("bad", [0, -3, "7", 2.5, None, True])
def test_findings_need_a_line(bad):
    assert findings.coerce_finding(GOOD | {"start_line": bad}, 60) is None


def test_findings_are_clamped():
    assert findings.coerce_finding(GOOD, 60)["severity"] == "high"
    clamp = lambda a, b, n: (lambda f: (f["start_line"], f["end_line"]))(findings.coerce_finding(GOOD | {"start_line": a, "end_line": b}, n))
    assert clamp(50, 500, 60) == (50, 60)
    assert clamp(8, 3, 60) == (8, 8)
    assert findings.coerce_finding(GOOD | {"severity": "odd", "title": "x" * 400}, 60)["severity"] == "medium"
    assert len(findings.coerce_finding(GOOD | {"title": "x" * 400}, 60)["title"]) == 300
    for key, value in (("category", "x"), ("title", " "), ("description", "")):
        assert findings.coerce_finding(GOOD | {key: value}, 60) is None
    assert findings.coerce_finding("text", 60) is None


@pytest.mark.parametrize(("reply", "found"), [('```json\n{"a": 1}\n```', {"a": 1}), ('Here: {"a": {"b": 2}} ok', {"a": {"b": 2}}), ("garbage", {}), ("[1, 2]", {})])
def test_replies(reply, found):
    assert findings.parse_reply(reply) == found


def test_snippets():
    source = "\n".join(f"line{i}" for i in range(1, 101))
    assert findings.snippet(source, 2, 4) == "line2\nline3\nline4"
    assert findings.snippet(source, 1, 100).count("\n") == 46
    assert findings.snippet(source, 200, 300) == ""


def test_finding_life(spark):
    old = spark.createDataFrame([(1, "new"), (2, "ticketed")], "id int, status string")
    new = spark.createDataFrame([(3, "new")], "id int, status string")
    assert sorted(r["id"] for r in findings.replace_findings(old, new).collect()) == [2, 3]
    every = spark.createDataFrame([(1,), (2,)], "id int")
    assert {r["id"]: r["status"] for r in findings.set_status(old, every, "dismissed").collect()} == {1: "dismissed", 2: "ticketed"}


def test_codemaps(spark):
    s = symbols(spark, *[(i, "a.py" if i < 3 else "b.py", "function", f"f{i}", "", "") for i in range(1, 6)])
    e = edges(spark, (1, 2), (2, 3), (3, 4), (1, 1))
    m = codemap.codemap(e, s, [1, 2])
    assert {n["id"]: n["step"] for n in m["nodes"]} == {1: 1, 2: 2, 3: 3}
    assert m["edges"] == [(1, 2), (2, 3)]
    f = codemap.file_codemap(e, s, "a.py")
    assert {n["id"]: n["step"] for n in f["nodes"]} == {1: 1, 2: 2, 3: 3}
    more = codemap.extend(e, s, [1, 2], [2, 3])  # 4 is a neighbour of the new node
    assert [n["id"] for n in sorted(more["nodes"], key=lambda n: n["id"])] == [3, 4] and more["edges"] == [(2, 3), (3, 4)]
    assert [n["id"] for n in codemap.extend(e, s, [1, 2], [2, 3], limit=1, call=lambda t: " a note ")["nodes"]] == [3]
    assert codemap.extend(e, s, [1, 2], [2]) == {"nodes": [], "edges": [], "note": ""}
    loose = codemap.file_codemap(edges(spark, (4, 1)), s, "a.py")  # no symbol of its own calls anything
    assert {n["step"] for n in loose["nodes"]} == {1}
    assert [n["side"] for n in codemap.expand(e, s, 2, 2)] == ["caller", "callee"]
    assert "calls" in codemap.explain_edge(s, 1, 2, "call")
    assert codemap.codemap(e, s, []) == {"nodes": [], "edges": []}


def test_traces(spark):
    s = symbols(spark, (1, "a.py", "function", "f", "", ""))
    plain = codemap.simulate(s, [1, 7], "q")
    assert plain["mechanical"] and plain["truncated"] and plain["steps"][0]["name"] == "f"
    cut = codemap.simulate(s, [1], "q", lambda _: '{"scenario": "s", "steps": [{"name": "f", "output": 1}, {"na')
    assert (cut["scenario"], len(cut["steps"])) == ("s", 1)
    assert codemap.signature_parts("def f(self, a: int, *b, c=1) -> int:") == (["a", "b", "c"], "int")
    cache = codemap.TraceCache(1)
    assert [cache.get(k, lambda k=k: {"k": k}) for k in ((1,), (1,), (2,))] == [{"k": (1,)}, {"k": (1,)}, {"k": (2,)}]


def test_agent_offline():
    hits = [{"stream": "doc", "citation": f"c{i}", "title": "t", "body": "b"} for i in range(3)]
    out = agent.investigate("q", lambda q, s: hits)
    assert out["enough"] and out["round"] == 1 and "[3]" in out["answer"]
    assert not agent.investigate("q", lambda q, s: hits[:2])["enough"]
    assert len(agent.merge_evidence(hits, hits)) == 3
    assert agent.ask("q", lambda q, s: [])["answer"].startswith("No evidence")


def test_agent_with_model():
    replies = iter(['{"queries": ["a", "b"], "streams": ["doc"]}', '{"sufficient": false, "queries": ["c"]}', '{"sufficient": true}', "done"])
    asked = []
    out = agent.investigate("q", lambda q, s: asked.append((q, tuple(s))) or [], lambda p: next(replies))
    assert asked == [("a", ("doc",)), ("b", ("doc",)), ("c", ("doc",))] and out["answer"] == "done" and out["round"] == 2


def test_diagrams():
    nodes = [{"id": i, "qualified_name": f'n"{i}', "file_path": "a/x.py"} for i in (1, 2, 3)]
    text = wiki.flowchart(nodes, [(1, 2), (1, 2), (2, 2)])
    assert text.count("-->") == 1 and "n3" not in text and '"' in text
    assert wiki.page_order(["a", "b", "c"], ["c", "x"]) == ["c", "a", "b"]
