"""Graphs: building edges from references, walks, paths, communities, exports."""

from __future__ import annotations

import heapq
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..lineage import cut
from .communities import merged

# Names too common to mean an edge, and how many definitions are too many.
STOP_NAMES = (
    "len", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "type",
    "isinstance", "issubclass", "getattr", "setattr", "hasattr", "delattr",
    "super", "print", "repr", "format", "open", "range", "enumerate", "zip",
    "map", "filter", "sorted", "reversed", "iter", "next", "vars", "dir",
    "min", "max", "sum", "any", "all", "abs", "id", "hash", "callable",
    "property", "staticmethod", "classmethod", "object", "Exception",
)
MAX_DEFINITIONS = 8
#: Confidence in tenths: one definition, a receiver's method, one of several, one of several bases.
EXACT, RECEIVER, FUZZY, AMBIGUOUS_BASE = 10, 9, 5, 6
#: References of one name that meet its classes together, and edges of bases of one task.
BLOCK_REFERENCES, TASK_EDGES = 4096, 4_000_000
#: Edges of a repository's call graph that one task merges greedily.
GREEDY_EDGES = 200_000


def best_edges(candidates: DataFrame) -> DataFrame:
    """The most confident of the edges between two symbols, and the (smallest) name that gave it."""
    return candidates.where("src <> dst").groupBy("repo_id", "src", "dst", "edge_type").agg(F.min_by("name", F.struct(-F.col("tenths"), F.col("name"))).alias("name"), F.max("tenths").alias("tenths"))


def method_table(symbols: DataFrame, bases: DataFrame, owners: DataFrame | None = None, rounds: int = 1000) -> DataFrame:
    """(repo_id, owner, method, id): each class's methods, its own first, then its bases' depth first.

    bases: (repo_id, owner, base); owners: (repo_id, owner), those asked for. Bases are tried in order of name. A class sees the methods of a
    base at the base's first place in that order: the least of the paths that lead to it, as arrays.
    Only the least path to each base is kept and followed, so a round's rows are at most one for each
    pair of classes; a path ends where it would repeat a class. Rounds end when no path improves; if
    `rounds` are not enough, that is an error, never an unfinished table.
    """
    own = symbols.where("kind = 'method'").withColumn("owner", F.regexp_replace("qualified_name", r"\.[^.]*$", ""))
    own = own.groupBy("repo_id", "owner", F.col("name").alias("method")).agg(F.min("id").alias("id"))
    edges = cut(bases.select("repo_id", F.col("owner").alias("at"), "base").distinct())
    if owners is None:
        owners = own.select("repo_id", "owner").unionByName(bases.select("repo_id", "owner"))
    key = ["repo_id", "owner", "at"]
    best = owners.distinct().select("repo_id", "owner", F.col("owner").alias("at"), F.array("owner").alias("path"), F.lit(0).alias("round"))
    for i in range(1, rounds + 1):
        new = best.where(F.col("round") == i - 1).join(edges, ["repo_id", "at"]).where("not array_contains(path, base)")
        new = new.select("repo_id", "owner", F.col("base").alias("at"), F.concat("path", F.array("base")).alias("path"), F.lit(i).alias("round"))
        best = cut(best.unionByName(new).groupBy(*key).agg(F.min(F.struct("path", "round")).alias("b")).select(*key, "b.path", "b.round"))
        if best.where(F.col("round") == i).isEmpty():
            break
    else:
        raise RuntimeError(f"chains of bases are not at their end after {rounds} rounds")
    seen = best.join(own.withColumnRenamed("owner", "at"), ["repo_id", "at"])
    return seen.groupBy("repo_id", "owner", "method").agg(F.min_by("id", "path").alias("id"))


def base_edges(bases: DataFrame, classes: DataFrame, class_names: DataFrame) -> DataFrame:
    """The best edges from bases(repo_id, src, name) to classes(repo_id, name, dst), every class of the name.

    class_names: (repo_id, name, n). There are as many edges as the pairs that share a name, so what is
    moved are references and classes, never pairs: a class has one name, so an edge is met once. Classes
    under several names alone are compared afterwards. A name's references are dealt out in blocks, each
    of which meets all classes of the name; tasks are as many as the edges ask for.
    """
    key = ["repo_id", "name"]
    bases = bases.distinct()
    met = bases.groupBy(*key).agg(F.count("*").alias("refs")).join(class_names, key)
    met = cut(met.withColumn("blocks", F.ceil(F.col("refs") / BLOCK_REFERENCES)))
    pairs = met.agg(F.sum(F.col("refs") * F.col("n"))).first()[0] or 0
    tasks = max(bases.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_EDGES))
    named = classes.where("dst is not null").groupBy("repo_id", "dst").agg(F.collect_set("name").alias("names"))

    def edges(some: DataFrame) -> DataFrame:
        each = some.select("repo_id", "dst", F.explode("names").alias("name")).join(met, key)
        each = each.select(*key, "dst", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        asked = bases.join(met.select(*key, "blocks"), key).select(*key, "src", F.pmod(F.xxhash64("src"), F.col("blocks")).alias("block"))
        pairs = asked.repartition(tasks, *key, "block").join(each.repartition(tasks, *key, "block"), [*key, "block"]).where("src <> dst")
        return pairs.select("repo_id", "src", "dst", F.lit("inherit").alias("edge_type"), "name", F.when(F.col("n") == 1, EXACT).otherwise(AMBIGUOUS_BASE).alias("tenths"))

    return edges(named.where("size(names) = 1")).unionByName(best_edges(edges(named.where("size(names) > 1"))))


def resolve_references(references: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and counters from references(repo_id, src, kind, receiver, name).

    kind: plain, self, receiver or base. Returns the best edges, and the number of references by tier
    (exact, receiver, fuzzy, inherit, unresolved). References are equal rows with the number of times
    they occur, so nothing depends on how rows are numbered; they are computed once.
    """
    callables = symbols.where(F.col("kind").isin("function", "method")).select("repo_id", "id", "name")
    # the names' groups are capped before anything is joined to them
    few = callables.groupBy("repo_id", "name").agg(F.count("*").alias("n")).where(F.col("n") <= MAX_DEFINITIONS)
    defined = callables.join(few, ["repo_id", "name"]).withColumnRenamed("id", "dst")
    classes = symbols.where("kind = 'class'").select("repo_id", "name", F.col("id").alias("dst"))
    class_names = classes.groupBy("repo_id", "name").agg(F.count("*").alias("n"))
    owner = symbols.select("repo_id", F.col("id").alias("src"), F.col("name").alias("src_name"), F.col("kind").alias("src_kind"), F.when(F.col("kind") == "method", F.regexp_replace("qualified_name", r"\.[^.]*$", "")).alias("owner"))
    own_columns = ["repo_id", "src", "kind", "receiver", "name"]
    times = references.groupBy(*own_columns).agg(F.count("*").alias("times"))
    key = F.struct(F.col("kind"), F.col("receiver"), F.col("name"))
    refs = cut(times.join(owner, ["repo_id", "src"]).where("src_kind <> 'import'").withColumn("ref", key))
    bases = refs.where("kind = 'base' and src_kind = 'class'").select("repo_id", F.col("src_name").alias("owner"), F.col("name").alias("base"))
    asked = refs.where("kind = 'self' and owner is not null").select("repo_id", "owner").unionByName(refs.where("kind = 'receiver'").join(class_names.withColumnRenamed("name", "receiver"), ["repo_id", "receiver"]).select("repo_id", F.col("receiver").alias("owner")))
    methods = method_table(symbols, bases, asked).select("repo_id", "owner", F.col("method").alias("name"), F.col("id").alias("dst"))

    itself = refs.where("kind = 'self' and owner is not null").join(methods, ["repo_id", "owner", "name"], "left").withColumn("tenths", F.lit(RECEIVER))
    open_ = refs.where(F.col("kind").isin("plain", "receiver") & ~F.col("name").isin(*STOP_NAMES))
    known = open_.join(class_names.select("repo_id", F.col("name").alias("receiver"), F.lit(True).alias("is_class")), ["repo_id", "receiver"], "left")
    typed = known.where("kind = 'receiver' and is_class").drop("owner").withColumnRenamed("receiver", "owner").join(methods, ["repo_id", "owner", "name"], "left").withColumn("tenths", F.lit(RECEIVER))
    # a reference's tier follows from how many definitions there are; only edges meet each of them
    loose = known.where("kind = 'plain' or is_class is null").join(few, ["repo_id", "name"], "left").withColumn("tenths", F.when((F.col("kind") == "plain") & (F.col("n") == 1), EXACT).otherwise(FUZZY))
    inherit = refs.where("kind = 'base'").join(class_names, ["repo_id", "name"], "left_semi")

    columns = ["repo_id", "src", "dst", "name", "tenths"]
    calls = itself.select(*columns).unionByName(typed.select(*columns)).unionByName(loose.join(defined.drop("n"), ["repo_id", "name"]).select(*columns))
    edges = best_edges(calls.where("dst is not null").withColumn("edge_type", F.lit("call"))).unionByName(base_edges(inherit.select("repo_id", "src", "name"), classes, class_names))

    told = ["repo_id", "tier", "src", "ref", "times"]
    own = itself.select("repo_id", "src", "ref", "times", "dst").unionByName(typed.select("repo_id", "src", "ref", "times", "dst")).withColumn("tier", F.when(F.col("dst").isNull(), "unresolved").otherwise("receiver"))
    tier = F.when(F.col("n").isNull(), "unresolved").when(F.col("tenths") == EXACT, "exact").otherwise("fuzzy")
    every = own.select(*told).unionByName(loose.withColumn("tier", tier).select(*told)).unionByName(inherit.withColumn("tier", F.lit("inherit")).select(*told))
    counters = every.distinct().groupBy("repo_id", "tier").agg(F.sum("times").alias("references"))
    return edges, counters


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): everything within `depth` steps of each start, at its least distance.

    edges: (src, dst); starts: (id). One join a step, with what was seen before taken out; each step
    is computed once, and the walk ends where nothing is new. A start on a cycle is a node too.
    """
    steps = cut(edges.select("src", "dst").distinct())
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node"))
    seen = frontier.withColumn("depth", F.lit(0)).where("false")
    for d in range(1, depth + 1):
        new = frontier.join(steps, frontier["node"] == steps["src"]).select("start", F.col("dst").alias("node")).distinct()
        if d > 1:
            new = new.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        if d < depth:
            new = cut(new)
            if new.isEmpty():
                break
        seen = seen.unionByName(new.withColumn("depth", F.lit(d)))
        frontier = new
    return seen


def capped_reach(edges: DataFrame, starts: DataFrame, depth: int = 3, max_nodes: int = 60) -> DataFrame:
    """What reach gives with at most max_nodes nodes a start, without the start itself.

    No step begins once a start has that many. Within a step the nodes of the smallest ids are taken,
    and only nodes that were taken are walked on from.
    """
    steps = cut(edges.select("src", "dst").where("src <> dst").distinct())
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node"))
    seen = frontier.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        new = frontier.join(steps, frontier["node"] == steps["src"]).select("start", F.col("dst").alias("node")).distinct()
        new = new.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        used = seen.where("depth > 0").groupBy("start").agg(F.count("*").alias("used"))
        place = F.row_number().over(Window.partitionBy("start").orderBy("node"))
        room = max_nodes - F.coalesce("used", F.lit(0))
        new = new.withColumn("place", place).where(F.col("place") <= max_nodes).join(used, "start", "left").where(F.col("place") <= room).select("start", "node")
        new = cut(new)
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new.withColumn("depth", F.lit(d))), new
    return seen.where("depth > 0")


def call_path(edges: DataFrame, start: int, depth: int = 4) -> DataFrame:
    """(node, depth) of the breadth-first path from one symbol over call edges, the start at 0."""
    spark = edges.sparkSession
    first = spark.range(start, start + 1)
    found = reach(edges.where("edge_type = 'call'"), first, depth).where(F.col("node") != start)
    return first.select(F.col("id").alias("node"), F.lit(0).alias("depth")).unionByName(found.select("node", "depth"))


def call_flow(edges: DataFrame, start: int, depth: int = 3, fanout: int = 8, max_nodes: int = 48) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """(nodes with depth, edges with tenths) of the capped downstream flow of one symbol.

    A step takes at most `fanout` edges of a source, by confidence, then target; targets beyond
    max_nodes are left out, and so are their edges; edges back to visited nodes stay and count. The
    result, at most max_nodes nodes, is held by the driver; each step's query returns at most
    max_nodes x fanout rows.
    """
    calls = cut(edges.where("edge_type = 'call' and src <> dst").groupBy("src", "dst").agg(F.max("tenths").alias("tenths")))
    nodes, kept, frontier = {start: 0}, [], [start]
    order = Window.partitionBy("src").orderBy(F.desc("tenths"), "dst")
    for d in range(1, depth + 1):
        if not frontier or len(nodes) >= max_nodes:
            break
        layer = calls.where(F.col("src").isin(frontier)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= fanout)
        rows = sorted(layer.select("src", "dst", "tenths").collect(), key=lambda r: (-r["tenths"], r["src"], r["dst"]))
        frontier = []
        for r in rows:
            kept.append((r["src"], r["dst"], r["tenths"]))
            if r["dst"] not in nodes and len(nodes) < max_nodes:
                nodes[r["dst"]] = d
                frontier.append(r["dst"])
    return sorted(nodes.items(), key=lambda x: (x[1], x[0])), [e for e in kept if e[0] in nodes and e[1] in nodes]


def shortest_path(edges: DataFrame, start: int, end: int, limit: int | None = None) -> list[int] | None:
    """One shortest undirected path, [start] for equal ends, None where no path (of at most `limit` steps) leads.

    The walk ends at the target or where nothing is new; what was seen is cut with each step, so the
    plan does not grow with the length of the path.
    """
    if start == end:
        return [start]
    one_way = edges.select("src", "dst")
    both = cut(one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    spark = edges.sparkSession
    frontier = spark.range(start, start + 1).select(F.col("id").alias("node"), F.array("id").alias("path"))
    seen = frontier.select("node")
    for _ in range(limit) if limit is not None else itertools.count():
        new = frontier.join(both, frontier["node"] == both["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path")).join(seen, "node", "left_anti")
        new = cut(new)
        hit = new.where(F.col("node") == end).select("path").first()
        if hit:
            return list(hit["path"])
        if new.isEmpty():
            return None
        frontier, seen = new, cut(seen.unionByName(new.select("node")))
    return None


def weighted_graph(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Undirected edges between non-test callables and classes, tenths summed over parallels."""
    nodes = symbols.where(F.col("kind").isin("class", "method", "function") & ~P.under_tests(F.col("file_path"))).select("repo_id", "id")
    inside = edges.join(nodes.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi").join(nodes.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi")
    return inside.groupBy("repo_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("tenths").alias("weight"))


def greedy_modularity(edges: list[tuple[int, int, float]]) -> dict[int, int]:
    """Node to its community's smallest node, by greedy merging while modularity grows.

    Merges the pair with the largest gain; ties go to the smallest ids.
    """
    total = sum(w for _, _, w in edges)
    links: dict[int, dict[int, float]] = {}
    degree: dict[int, float] = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            links.setdefault(x, {})
            if x != y:
                links[x][y] = links[x].get(y, 0.0) + w
            degree[x] = degree.get(x, 0.0) + w
    share = {x: d / (2 * total) for x, d in degree.items()}
    member, version = {x: x for x in links}, dict.fromkeys(links, 0)

    def gain(x: int, y: int) -> float:
        return links[x][y] / total - 2 * share[x] * share[y]

    heap = [(-gain(x, y), x, y, 0, 0) for x in links for y in links[x] if x < y]
    heapq.heapify(heap)
    while heap:
        g, x, y, vx, vy = heapq.heappop(heap)
        if g >= -1e-15:
            break
        if version.get(x) != vx or version.get(y) != vy:
            continue
        for z, w in links.pop(y).items():
            del links[z][y]
            if z != x:
                links[x][z] = links[z][x] = links[x].get(z, 0.0) + w
        share[x] += share.pop(y)
        del version[y]
        version[x] += 1
        member[y] = x
        for z in links[x]:
            a, b = min(x, z), max(x, z)
            heapq.heappush(heap, (-gain(a, b), a, b, version[a], version[b]))

    def root(x: int) -> int:
        while member[x] != x:
            x = member[x]
        return x

    return {x: root(x) for x in member}


def merged_communities(edges: DataFrame, symbols: DataFrame, least: int = 3) -> DataFrame:
    """(repo_id, community, id) of communities of `least` members or more, found in parallel, whatever the graph's size."""
    found = merged(weighted_graph(edges, symbols))
    large = found.groupBy("repo_id", "community").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return found.join(large, ["repo_id", "community"], "left_semi").select("repo_id", "community", "id")


def communities(edges: DataFrame, symbols: DataFrame, least: int = 3, most_edges: int = GREEDY_EDGES) -> DataFrame:
    """(repo_id, community, id) of communities of `least` members or more, computed once.

    By greedy merging where a repository's call graph has at most most_edges edges: one merge depends on
    the one before it, so a task holds the graph. Larger ones merge in parallel, which finds others of
    like modularity and holds no graph in a task.
    """
    graph = cut(weighted_graph(edges, symbols))

    def cluster(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = greedy_modularity(list(zip(part["a"].tolist(), part["b"].tolist(), part["weight"].astype(float).tolist(), strict=True)))
        return pd.DataFrame({"repo_id": key[0], "community": list(found.values()), "id": list(found.keys())})

    large = cut(graph.groupBy("repo_id").agg(F.count("*").alias("n")).where(F.col("n") > most_edges).select("repo_id"))
    found = graph.join(F.broadcast(large), "repo_id", "left_anti").groupBy("repo_id").applyInPandas(cluster, "repo_id int, community long, id long")
    if not large.isEmpty():
        found = found.unionByName(merged(graph.join(F.broadcast(large), "repo_id", "left_semi")))
    found = cut(found)
    kept = found.groupBy("repo_id", "community").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return found.join(kept, ["repo_id", "community"], "left_semi").select("repo_id", "community", "id")


def describe_communities(members: DataFrame, edges: DataFrame, symbols: DataFrame, limit: int = 12, shown: int = 20) -> DataFrame:
    """The largest communities: size, folders, commonest folder, label, most linked members, total.

    The label is the name of the class with the largest degree, else the commonest file. total is the
    number of all communities, also of those beyond the limit. Ties go to the smallest id or path.
    """
    graph = weighted_graph(edges, symbols)
    ends = graph.select("repo_id", F.explode(F.array("a", "b")).alias("id"), "weight")
    degree = ends.groupBy("repo_id", "id").agg(F.sum("weight").alias("degree"))
    rows = members.join(symbols, ["repo_id", "id"]).join(degree, ["repo_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    key = ["repo_id", "community"]

    def commonest(column: Column, name: str) -> DataFrame:
        return rows.groupBy(*key, column.alias("x")).agg(F.count("*").alias("n")).groupBy(*key).agg(F.min_by("x", F.struct(-F.col("n"), F.col("x"))).alias(name))

    best_class = F.max_by("name", F.when(F.col("kind") == "class", F.struct("degree", -F.col("id"))))
    out = rows.groupBy(*key).agg(F.count("*").alias("size"), F.countDistinct(P.dirname(F.col("file_path"))).alias("folders"), best_class.alias("best_class"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("degree"), "id"))
    first = rows.withColumn("at", place).where(F.col("at") <= shown).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "id", "qualified_name", "file_path"))).alias("members"))
    out = out.join(commonest(F.col("file_path"), "file"), key).join(commonest(P.dirname(F.col("file_path")), "primary_dir"), key).join(first, key)
    out = out.withColumn("label", F.coalesce("best_class", P.basename(F.col("file")))).drop("best_class", "file")
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("size"), "community"))
    total = F.count("*").over(Window.partitionBy("repo_id"))
    return out.withColumn("place", rank).withColumn("total", total).where(F.col("place") <= limit)


def file_graph(edges: DataFrame, symbols: DataFrame, min_weight: int = 1, exclude_tests: bool = False) -> DataFrame:
    """Directed links between files with the number of edges behind them."""
    from .mining import file_edges

    crossing = file_edges(edges, symbols).where("src_file <> dst_file")
    if exclude_tests:
        crossing = crossing.where(~P.under_tests(F.col("src_file")) & ~P.under_tests(F.col("dst_file")))
    return crossing.groupBy("repo_id", F.col("src_file").alias("source"), F.col("dst_file").alias("target")).agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight)


def file_graph_nodes(links: DataFrame, groups: int = 3) -> DataFrame:
    """The linked files with weighted degree and group: one of the busiest folders, or other."""
    ends = links.select("repo_id", F.explode(F.array("source", "target")).alias("path"), "weight")
    nodes = ends.groupBy("repo_id", "path").agg(F.sum("weight").alias("degree")).withColumn("folder", P.dirname(F.col("path")))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("sum"), "folder"))
    top = nodes.groupBy("repo_id", "folder").agg(F.sum("degree").alias("sum")).withColumn("place", place).where(F.col("place") <= groups).select("repo_id", "folder", F.col("folder").alias("group"))
    return nodes.join(top, ["repo_id", "folder"], "left").select("repo_id", "path", "degree", F.coalesce("group", F.lit("other")).alias("group"))


def symbol_graph(edges: DataFrame, symbols: DataFrame, prefix: str, max_nodes: int = 90, neighbours: bool = True) -> DataFrame:
    """Links of the symbols below a path prefix; outsiders fill up to max_nodes by their edges to them."""
    own = symbols.where(F.col("file_path").startswith(prefix)).select("id")
    touching = edges.join(own.select(F.col("id").alias("src"), F.lit(True).alias("s")), "src", "left").join(own.select(F.col("id").alias("dst"), F.lit(True).alias("d")), "dst", "left").where("s or d")
    inside = touching.where("s and d")
    if not neighbours:
        return inside.select("src", "dst", "edge_type", "tenths")
    strength = touching.where("s is null or d is null").groupBy(F.when(F.col("s"), F.col("dst")).otherwise(F.col("src")).alias("id")).agg(F.count("*").alias("n"))
    linked = inside.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(touching.where("s is null or d is null").select(F.when(F.col("s"), F.col("src")).otherwise(F.col("dst")).alias("id"))).distinct()
    room = max(0, max_nodes - linked.count())
    added = strength.orderBy(F.desc("n"), "id").limit(room).select("id")
    nodes = own.unionByName(added).distinct()
    return touching.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "edge_type", "tenths")


def combined(edges: DataFrame, symbols: DataFrame, prefix: str) -> DataFrame:
    """(level, source, target, weight): the file graph, and the symbol graph below a path prefix, in one export."""
    files = file_graph(edges, symbols).select(F.lit("file").alias("level"), "source", "target", "weight")
    inside = symbol_graph(edges, symbols, prefix, neighbours=False).groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return files.unionByName(inside.select(F.lit("symbol").alias("level"), F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), "weight"))
