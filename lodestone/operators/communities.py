"""Communities of graphs of any size: parts merge in parallel while modularity grows, then nodes move.

The graph is a table (repo_id, a, b, weight) of undirected edges, a < b or a loop. No task holds a
repository's graph: a round is a few joins and groupings by part, whose rows become fewer with each
round. What is kept for each part is its degree, for each repository its total weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import Rounds


def _by_id(rows: DataFrame) -> DataFrame:
    """rows of parts or nodes, joined by sorting: sent to all tasks they would pass through the driver each round."""
    return rows.hint("merge")


#: Below this a gain is rounding.
LEAST_GAIN = 1e-15
#: Rounds of moving single nodes after the merging; each must raise modularity.
MOVES = 12


def _degrees(graph: DataFrame) -> DataFrame:
    """(repo_id, id, degree): the weight at each node, a loop's counting twice."""
    ends = graph.select("repo_id", F.explode(F.array("a", "b")).alias("id"), "weight")
    return ends.groupBy("repo_id", "id").agg(F.sum("weight").cast("double").alias("degree"))


def _total(graph: DataFrame) -> DataFrame:
    return graph.groupBy("repo_id").agg(F.sum("weight").cast("double").alias("total"))


def modularity(graph: DataFrame, members: DataFrame) -> DataFrame:
    """(repo_id, modularity) of members(repo_id, community, id), which names each node once."""
    of = members.select("repo_id", "id", "community")
    ends = graph.join(_by_id(of.toDF("repo_id", "a", "ca")), ["repo_id", "a"]).join(_by_id(of.toDF("repo_id", "b", "cb")), ["repo_id", "b"])
    inside = ends.groupBy("repo_id").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"), F.sum("weight").alias("total"))
    shares = _degrees(graph).join(_by_id(of), ["repo_id", "id"]).groupBy("repo_id", "community").agg(F.sum("degree").alias("degree"))
    squares = shares.groupBy("repo_id").agg(F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    value = F.col("inside") / F.col("total") - F.col("squares") / (4 * F.col("total") * F.col("total"))
    return inside.join(F.broadcast(squares), "repo_id").select("repo_id", value.alias("modularity"))


def _head(column: str, turn: int) -> Column:
    """A coin of each part and turn, the same whenever it is tossed."""
    return F.xxhash64(F.col(column), F.lit(turn)) % 2 == 0


def _merges(links: DataFrame, degrees: DataFrame, total: DataFrame, turn: int, rounds: Rounds) -> DataFrame:
    """(repo_id, x, hub): the parts x that go into another, so that modularity grows by each hub's merges.

    Each part asks for its best neighbour. Two that ask for each other merge into the smaller; of the
    rest those with tails join a hub that they ask for (heads, or the smaller of such a two). Parts that join one
    hub lose by being in one part; they are taken by classes of their gain, the best class first, each
    if its gain is more than that loss against all parts of its class and the better ones. So gains add
    up however many join, a hub's parts are never sorted, and a merge that two ask for always happens.
    """
    d = degrees.select("repo_id", "id", "degree")
    both = links.join(_by_id(d.toDF("repo_id", "a", "da")), ["repo_id", "a"]).join(_by_id(d.toDF("repo_id", "b", "db")), ["repo_id", "b"]).join(F.broadcast(total), "repo_id")
    gain = F.col("weight") / F.col("total") - F.col("da") * F.col("db") / (2 * F.col("total") * F.col("total"))
    both = both.withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN)
    way = lambda x, y, dx: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(dx).alias("dx"))
    ways = both.select("repo_id", "a", "b", "gain", "total", F.explode(F.array(way("a", "b", "da"), way("b", "a", "db"))).alias("w"))
    # the order of pairs is one for both ends, so that only two that ask for each other form a circle
    best = ways.groupBy("repo_id", "w.x").agg(F.max_by(F.struct("w.y", "w.dx", "gain", "total"), F.struct("gain", -F.col("a"), -F.col("b"))).alias("m")).select("repo_id", "x", "m.*")
    best = rounds.keep(best)
    back = best.select("repo_id", F.col("x").alias("y"), F.col("y").alias("z"))
    asked = best.join(_by_id(back), ["repo_id", "y"]).withColumn("mutual", F.col("z") == F.col("x"))
    hubs = asked.where((F.col("mutual") & (F.col("x") < F.col("y"))) | (~F.col("mutual") & _head("x", turn))).select("repo_id", F.col("x").alias("y"))
    joins = F.when(F.col("mutual"), F.col("x") > F.col("y")).otherwise(~_head("x", turn))
    leaves = asked.where(joins).join(_by_id(hubs), ["repo_id", "y"], "left_semi")
    # classes of gain by powers of two; the asked-for merge is in a class before all others
    leaves = leaves.withColumn("class", F.when(F.col("mutual"), F.lit(-(1 << 20))).otherwise(-F.floor(F.log2("gain"))))
    classes = leaves.groupBy("repo_id", "y", "class").agg(F.sum("dx").alias("own"))
    upto = F.sum("own").over(Window.partitionBy("repo_id", "y").orderBy("class"))
    loss = F.col("dx") * (F.col("upto") - F.col("dx")) / (2 * F.col("total") * F.col("total"))
    taken = leaves.join(_by_id(classes.withColumn("upto", upto).drop("own")), ["repo_id", "y", "class"]).where(F.col("mutual") | (F.col("gain") - loss > LEAST_GAIN))
    return taken.select("repo_id", "x", F.col("y").alias("hub"))


def _renamed(rows: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """rows whose column holds the hub of each part that has gone into one."""
    to = merges.select("repo_id", F.col("x").alias(column), F.col("hub").alias("__hub"))
    return rows.join(_by_id(to), ["repo_id", column], "left").withColumn(column, F.coalesce("__hub", column)).drop("__hub")


def _folded(links: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges between the parts after the merges, those within a part left out."""
    ends = _renamed(_renamed(links, "a", merges), "b", merges).where("a <> b")
    return ends.groupBy("repo_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))


def _moved(graph: DataFrame, degrees: DataFrame, members: DataFrame, total: DataFrame, turn: int) -> DataFrame:
    """members after one round of moves: nodes of parts with heads go to the part with tails that gains most."""
    m = members.select("repo_id", "id", "community")
    arcs = graph.where("a <> b").select("repo_id", "weight", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near")), F.struct(F.col("b").alias("id"), F.col("a").alias("near")))).alias("e")).select("repo_id", "e.id", "e.near", "weight")
    near = arcs.join(_by_id(m.toDF("repo_id", "near", "part")), ["repo_id", "near"]).groupBy("repo_id", "id", "part").agg(F.sum("weight").cast("double").alias("w"))
    sizes = degrees.join(_by_id(m), ["repo_id", "id"]).groupBy("repo_id", "community").agg(F.sum("degree").alias("size"))
    own = m.where(_head("community", turn)).join(_by_id(degrees), ["repo_id", "id"]).join(_by_id(sizes), ["repo_id", "community"]).join(F.broadcast(total), "repo_id")
    stay = near.select("repo_id", "id", F.col("part").alias("community"), F.col("w").alias("stays"))
    own = own.join(_by_id(stay), ["repo_id", "id", "community"], "left")
    others = near.where(~_head("part", turn)).join(_by_id(sizes.toDF("repo_id", "part", "there")), ["repo_id", "part"])
    gain = (F.col("w") - F.coalesce("stays", F.lit(0.0))) / F.col("total") - F.col("degree") * (F.col("there") - F.col("size") + F.col("degree")) / (2 * F.col("total") * F.col("total"))
    moves = own.join(_by_id(others), ["repo_id", "id"]).withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN)
    moves = moves.groupBy("repo_id", F.col("id").alias("x")).agg(F.max_by("part", F.struct("gain", -F.col("part"))).alias("hub"))
    to = moves.withColumnRenamed("x", "id")
    return m.join(_by_id(to), ["repo_id", "id"], "left").select("repo_id", F.coalesce("hub", "community").alias("community"), "id")


def merged(graph: DataFrame, moves: int = MOVES, most: int = 1000) -> DataFrame:
    """(repo_id, community, id): every node of the graph with its community, named by its smallest node.

    Merging ends where no merge raises modularity; if `most` rounds are not enough, that is an error. Then
    single nodes move, a round of moves being kept by those repositories alone whose modularity it
    raises. Results depend on the graph alone. Loops count for degrees, nulls in ids or weights are no
    edges, repeated edges add up, and an empty graph has no communities.
    """
    graph = graph.where("a is not null and b is not null and weight > 0").groupBy("repo_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))
    rounds = Rounds(graph.sparkSession, "communities")
    cut = rounds.keep
    graph = cut(graph)
    degrees, total = cut(_degrees(graph)), cut(_total(graph))
    members = degrees.select("repo_id", F.col("id").alias("community"), "id")
    links, sizes = graph.where("a <> b"), degrees
    for turn in range(most):
        merges = cut(_merges(links, sizes, total, turn, rounds))
        if merges.isEmpty():
            break
        members = cut(_renamed(members, "community", merges))
        links = cut(_folded(links, merges))
        sizes = cut(_renamed(sizes, "id", merges).groupBy("repo_id", "id").agg(F.sum("degree").alias("degree")))
    else:
        raise RuntimeError(f"parts still merge after {most} rounds")
    value = cut(modularity(graph, members))
    idle = 0
    for turn in range(moves):
        new = cut(_moved(graph, degrees, members, total, turn))
        better = modularity(graph, new).join(F.broadcast(value.withColumnRenamed("modularity", "old")), "repo_id")
        better = cut(better.withColumn("up", F.col("modularity") > F.col("old") + LEAST_GAIN))
        if better.where("up").isEmpty():
            idle += 1
            if idle == 4:
                break
            continue
        idle = 0
        up = better.select("repo_id", "up")
        both = new.join(_by_id(members.withColumnRenamed("community", "old")), ["repo_id", "id"]).join(F.broadcast(up), "repo_id")
        members = cut(both.select("repo_id", F.when(F.col("up"), F.col("community")).otherwise(F.col("old")).alias("community"), "id"))
        value = better.select("repo_id", F.greatest("modularity", "old").alias("modularity"))
    named = members.groupBy("repo_id", "community").agg(F.min("id").alias("name"))
    return members.join(_by_id(named), ["repo_id", "community"]).select("repo_id", F.col("name").alias("community"), "id")
