"""What views show: ordered lists, first occurrences, neighbourhoods and steps, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from . import graph
from .ordering import numbered

# How much of an evidence's text is shown and kept, and how many lines of a snippet.
SNIPPET_CHARS, BODY_CHARS = 200, 1500
MAX_EVIDENCE = 24
MAX_CALLEES = 6
MAX_EXPANDED = 6
MAX_FACTS = 15
CONNECTED = 10


def placed(rows: DataFrame, *order: Column | str, limit: int | None = None, by: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """rows with `place` (from 1) in their order, the first `limit` of each repository.

    With a limit each task keeps its first rows alone before any move; without one ranges are numbered apart.
    """
    if limit is None:
        return numbered(rows, by, *order)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def first_seen(rows: DataFrame, keys: list[str], order: str, limit: int | None = None) -> DataFrame:
    """Of the rows that are equal in the keys the one that comes first; the first `limit` of these."""
    others = [c for c in rows.columns if c not in keys]
    once = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("__row")).select(*keys, "__row.*")
    return once if limit is None else once.orderBy(order).limit(limit)


def in_order(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows(id, ...) that asked(id, rank) names, each at its first rank."""
    return first_seen(asked, ["id"], "rank").join(rows, "id")


def not_shown(candidates: DataFrame, shown: DataFrame, limit: int) -> DataFrame:
    """candidates(id, rank) that are not among shown(id), the first `limit`."""
    return first_seen(candidates, ["id"], "rank").join(shown.select("id"), "id", "left_anti").orderBy("rank").limit(limit)


def _ends(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(own.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_own")).distinct() for c in ("src", "dst"))


def touching(edges: DataFrame, own: DataFrame) -> DataFrame:
    """Edges with an end among own(id), and which ends: src_own, dst_own (true or null)."""
    src, dst = _ends(own)
    return edges.join(src, "src", "left").join(dst, "dst", "left").where("src_own or dst_own")


def neighbours(edges: DataFrame, own: DataFrame, room: int) -> DataFrame:
    """(id, strength): the outsiders with most edges to own(id), at most `room`."""
    crossing = touching(edges, own).where("src_own is null or dst_own is null")
    outside = F.when(F.col("src_own"), F.col("dst")).otherwise(F.col("src"))
    return crossing.groupBy(outside.alias("id")).agg(F.count("*").alias("strength")).orderBy(F.desc("strength"), "id").limit(max(room, 0))


def inner_pairs(edges: DataFrame, own: DataFrame) -> DataFrame:
    """Distinct (src, dst) among own(id), without loops: of several edges between two nodes the first is enough."""
    return touching(edges, own).where("src_own and dst_own and src <> dst").select("src", "dst").distinct()


def steps(pairs: DataFrame, nodes: DataFrame, root: int, trailing: bool = False, depth: int = 64) -> DataFrame:
    """(id, step) of nodes(id): 1 for the root, one more for each edge on the shortest way from it.

    What is not reached is in step 1, or with `trailing` in a last step of its own.
    """
    start = nodes.where(F.col("id") == root).select("id")
    found = graph.reach(pairs, start, depth).where(F.col("node") != root).select(F.col("node").alias("id"), (F.col("depth") + 1).alias("step"))
    known = start.withColumn("step", F.lit(1)).unionByName(found)
    last = known.agg((F.max("step") + 1).alias("last"))
    rows = nodes.select("id").join(known, "id", "left")
    if not trailing:
        return rows.select("id", F.coalesce("step", F.lit(1)).alias("step"))
    return rows.crossJoin(F.broadcast(last)).select("id", F.coalesce("step", "last", F.lit(1)).alias("step"))  # one row


def ego(edges: DataFrame, node: int) -> DataFrame:
    """The edges among a symbol and its direct neighbours."""
    near = edges.where((F.col("src") == node) | (F.col("dst") == node)).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")


def expand(edges: DataFrame, node: int, step: int, limit: int = MAX_EXPANDED) -> DataFrame:
    """(side, id, step): up to `limit` callers a step before a node, and as many callees a step after, the most confident first."""
    out = None
    for side, own, other, at in (("caller", "dst", "src", step - 1), ("callee", "src", "dst", step + 1)):
        rows = edges.where((F.col(own) == node) & (F.col(other) != node)).groupBy(F.col(other).alias("id")).agg(F.max("tenths").alias("tenths"))
        part = rows.orderBy(F.desc("tenths"), "id").limit(limit).select(F.lit(side).alias("side"), "id", F.lit(at).alias("step"))
        out = part if out is None else out.unionByName(part)
    return out


def first_callees(calls: DataFrame, most: int = MAX_CALLEES) -> DataFrame:
    """(src, name, place): the first distinct names that each symbol calls, of calls(src, name, rank)."""
    return placed(first_seen(calls.where("name is not null"), ["src", "name"], "rank"), "rank", limit=most, by=("src",)).select("src", "name", "place")


def strongest_calls(edges: DataFrame, fanout: int = 8) -> DataFrame:
    """(src, dst, tenths, n): each symbol's most confident calls, at most `fanout`."""
    calls = edges.where("edge_type = 'call'").groupBy("src", "dst").agg(F.max("tenths").alias("tenths"))
    return placed(calls, F.desc("tenths"), "dst", limit=fanout, by=("src",)).withColumnRenamed("place", "n")


def last_turns(turns: DataFrame, most: int = 4) -> DataFrame:
    """The last `most` turns of each conversation: turns(conv_id, turn, ...)."""
    return placed(turns, F.desc("turn"), limit=most, by=("conv_id",)).drop("place")


def history_of(commits: DataFrame, commit_files: DataFrame, path: str, limit: int = 8) -> DataFrame:
    """A file's last changes: (path, sha, authored_at, insertions), the newest first."""
    changes = commit_files.where(F.col("path") == path).join(commits, ["repo_id", "sha"])
    return changes.select("path", "sha", "authored_at", "insertions").orderBy(F.desc("authored_at"), F.desc("sha")).limit(limit)


def most_connected(links: DataFrame, limit: int = CONNECTED) -> DataFrame:
    """The files with most links, weights summed: (path, degree, place)."""
    ends = links.select("repo_id", F.explode(F.array("source", "target")).alias("path"), "weight")
    return placed(ends.groupBy("repo_id", "path").agg(F.sum("weight").alias("degree")), F.desc("degree"), "path", limit=limit)


def linked_files(links: DataFrame, path: str) -> DataFrame:
    """A file's neighbours with the weights of both directions: (path, weight, place)."""
    near = links.where((F.col("source") == path) | (F.col("target") == path)).select("repo_id", F.when(F.col("source") == path, F.col("target")).otherwise(F.col("source")).alias("path"), "weight")
    return placed(near.groupBy("repo_id", "path").agg(F.sum("weight").alias("weight")), F.desc("weight"), "path")


def facts(edges: DataFrame, symbols: DataFrame, node: int, limit: int = MAX_FACTS) -> DataFrame:
    """One row about a symbol: its first dependents by edge type and name, and what it leads to in two steps."""
    names = symbols.select(F.col("id").alias("other"), F.col("qualified_name").alias("name"))
    users = edges.where(F.col("dst") == node).join(names, F.col("src") == F.col("other")).select(F.concat_ws(":", "edge_type", "name").alias("x")).distinct().orderBy("x").limit(limit)
    path = graph.call_path(edges, node, 2).where("depth > 0").join(names, F.col("node") == F.col("other")).orderBy("depth", "name", "node").limit(limit)

    def listed(rows: DataFrame, item: Column, empty: str) -> DataFrame:
        return rows.agg(F.array_sort(F.collect_list(item)).alias("a")).select(F.when(F.size("a") == 0, F.lit(empty)).otherwise(F.array_join(F.transform("a", lambda x: x["x"]), ", ")).alias("t"))

    breaks = listed(users, F.struct(F.col("x").alias("k"), F.col("x")), "(none internal)").withColumnRenamed("t", "dependents")
    leads = listed(path, F.struct("depth", F.col("name").alias("k"), F.col("name").alias("x")), "(none resolved)").withColumnRenamed("t", "leads_to")
    own = symbols.where(F.col("id") == node).select("id", "qualified_name", F.concat_ws(":", "file_path", "start_line").alias("citation"))
    return own.crossJoin(breaks).crossJoin(leads)  # one row each


def code_evidence(symbols: DataFrame) -> DataFrame:
    """Symbols as evidence: (id, stream, title, citation, snippet, body, path)."""
    doc, code = (F.nullif(F.coalesce(c, F.lit("")), F.lit("")) if c in symbols.columns else F.lit(None).cast("string") for c in ("docstring", "code"))
    first, whole = F.coalesce(doc, code, F.lit("")), F.coalesce(code, doc, F.lit(""))
    title = F.coalesce(F.nullif("qualified_name", F.lit("")), "name")
    return symbols.select("id", F.lit("code").alias("stream"), title.alias("title"), F.concat_ws(":", "file_path", "start_line").alias("citation"), T.strip(F.left(first, F.lit(SNIPPET_CHARS))).alias("snippet"), T.strip(F.left(whole, F.lit(BODY_CHARS))).alias("body"), F.col("file_path").alias("path"))


def text_evidence(documents: DataFrame) -> DataFrame:
    """Evidence documents as evidence: (id, stream, title, citation, snippet, body)."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.concat_ws(":", "stream", "ref_id").alias("id"), "stream", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("citation", F.lit("")).alias("citation"), T.strip(F.left(text, F.lit(SNIPPET_CHARS))).alias("snippet"), T.strip(F.left(text, F.lit(BODY_CHARS))).alias("body"))


def merged_evidence(rows: DataFrame, limit: int = MAX_EVIDENCE) -> DataFrame:
    """Evidence(rank, stream, citation, title, ...) once for each stream, citation and title, in order, capped."""
    return first_seen(rows, ["stream", "citation", "title"], "rank", limit)


def files_by_folder(files: DataFrame, part: str = "") -> DataFrame:
    """(repo_id, folder, paths): files whose path holds `part`, whatever its case, without those of category other."""
    found = files.where(F.lower("path").contains(part.lower()) & (F.col("category") != "other"))
    return found.groupBy("repo_id", P.dirname(F.col("path")).alias("folder")).agg(F.sort_array(F.collect_list("path")).alias("paths"))


def readme(files: DataFrame) -> DataFrame:
    """The file that a reader starts at: of those named like a readme, the shortest path."""
    return files.where(F.lower("path").contains("readme")).orderBy(F.length("path"), "path").limit(1)


def source_of(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, source): a symbol's lines in its file."""
    content = files.select("repo_id", F.col("path").alias("file_path"), "content")
    return symbols.join(content, ["repo_id", "file_path"]).select("id", T.line_slice(F.col("content"), F.col("start_line"), F.col("end_line")).alias("source"))


def section_files(sections: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, paths): the distinct files behind each section's symbols; sections(key, id), ids(id, file_path)."""
    return sections.join(ids, "id").groupBy("key").agg(F.sort_array(F.collect_set("file_path")).alias("paths"))


def flow_nodes(flow: DataFrame, symbols: DataFrame) -> DataFrame:
    """A call flow's nodes(node, depth) as those of a codemap: (id, qualified_name, role, step)."""
    role = T.role(F.col("qualified_name"), F.col("file_path"), F.col("kind"))
    return flow.join(symbols, F.col("node") == F.col("id")).select("id", "qualified_name", role.alias("role"), (F.col("depth") + 1).alias("step"))


def merged_nodes(first: DataFrame, more: DataFrame) -> DataFrame:
    """Nodes of two views(id, step) together: those of the first stay as they are."""
    both = first.withColumn("rank", F.lit(0)).unionByName(more.withColumn("rank", F.lit(1)))
    return first_seen(both, ["id"], "rank").drop("rank")
