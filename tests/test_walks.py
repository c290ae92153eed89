"""The upstream walk, impact and communities, each whole, against plain Python."""

from lodestone.plans import catalogue
from lodestone.sources import tables as S

DIR = "/root/testdata/sf0.001"


def walks(spark):
    callers = {}
    for r in S.edges(spark, DIR).where("edge_type = 'call'").collect():
        callers.setdefault(r["dst"], set()).add(r["src"])
    for start in [r["id"] for r in S.symbols(spark, DIR).where("kind <> 'class'").collect()]:
        depth, layer = {}, {start}
        for d in (1, 2, 3):
            layer = {x for y in layer for x in callers.get(y, ())} - set(depth)
            depth |= dict.fromkeys(layer, d)
        yield start, depth


def test_upstream_has_every_callable_and_the_third_step(spark):
    want = sorted((start, node, d) for start, depth in walks(spark) for node, d in depth.items())
    assert sorted(tuple(r) for r in catalogue.QUERIES["i07_upstream"](spark, DIR).collect()) == want
    assert {d for _, _, d in want} == {1, 2, 3}


def test_impact_has_every_callable_and_the_third_step(spark):
    tests = {r["id"]: r["file_path"].startswith("tests/") for r in S.symbols(spark, DIR).collect()}
    want = []
    for start, depth in walks(spark):
        direct, inside = sum(d == 1 for d in depth.values()), sum(tests[n] for n in depth)
        if direct == 0 and start % 40:
            risk = "low"
        elif inside == 0:
            risk = "high" if direct >= 3 else "medium"
        else:
            risk = "medium" if direct >= 6 else "low"
        want.append((start, direct, len(depth), inside, risk))
    assert sorted(tuple(r) for r in catalogue.QUERIES["k12_impact"](spark, DIR).collect()) == sorted(want)


def plain_communities(weights):
    """Greedy modularity: of all pairs of linked parts the one with the largest gain is merged, while there is a gain."""
    total = sum(weights.values())
    part = {x: x for pair in weights for x in pair}
    degree = dict.fromkeys(part, 0.0)
    for (a, b), w in weights.items():
        degree[a] += w
        degree[b] += w
    while True:
        between, size = {}, {}
        for x, d in degree.items():
            size[part[x]] = size.get(part[x], 0.0) + d
        for (a, b), w in weights.items():
            x, y = sorted((part[a], part[b]))
            if x != y:
                between[x, y] = between.get((x, y), 0.0) + w
        gains = [(-(w / total - 2 * size[x] * size[y] / (2 * total) ** 2), x, y) for (x, y), w in between.items()]
        if not gains or min(gains)[0] >= -1e-15:
            return part
        _, x, y = min(gains)
        part = {k: x if v == y else v for k, v in part.items()}


def test_communities_of_the_query_are_greedy(spark):
    from lodestone.operators import graph

    e, s = S.edges(spark, DIR), S.symbols(spark, DIR)
    weights = {(r["a"], r["b"]): float(r["weight"]) for r in graph.weighted_graph(e, s).collect()}
    part = plain_communities(weights)
    sizes = {}
    for x in part.values():
        sizes[x] = sizes.get(x, 0) + 1
    want = sorted((n for n in sizes.values() if n >= 3), reverse=True)
    rows = catalogue.QUERIES["k10_communities"](spark, DIR).orderBy("place").collect()
    assert [r["size"] for r in rows] == want[:12] and {r["total"] for r in rows} == {len(want)}
    for r in rows:
        own = {x for x, c in part.items() if c == r["community"]}
        assert len(own) == r["size"] and {m["id"] for m in r["members"]} <= own and len(r["members"]) == min(20, len(own))
