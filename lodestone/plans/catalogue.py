"""Queries over the driver's tables, one or more for each operator, and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import evaluation, findings, graph, mining, retrieval, views
from ..sources import tables as S
from ..streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The symbol that single-start queries begin at.
START = 7


def register(name: str, sql: str | None = None, *tables: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (S.with_tables(*tables) + "\n" if tables else "") + sql
        return f

    return add


GRAPH = (S.SYMBOLS_SQL, S.EDGES_SQL)
HISTORY = (S.SYMBOLS_SQL, S.COMMITS_SQL, S.COMMIT_FILES_SQL)
# edges with the files of both ends
ENDS = "ends AS (SELECT e.*, s.file_path AS src_file, d.file_path AS dst_file, s.qualified_name AS src_name, d.qualified_name AS dst_name FROM edges e JOIN symbols s ON e.src = s.id JOIN symbols d ON e.dst = d.id)"


@register(
    "e01_entity_counts",
    "SELECT 'symbols' AS entity, count(*) AS n FROM symbols UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'commit_files', count(*) FROM commit_files UNION ALL SELECT 'issues', count(*) FROM issues",
    *GRAPH, S.COMMITS_SQL, S.COMMIT_FILES_SQL, S.ISSUES_SQL,
)
def _(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("symbols", "edges", "commits", "commit_files", "issues"):
        part = getattr(S, name)(spark, d).agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@register("e02_issue_state_counts", "SELECT is_pull_request, state, count(*) AS n, count(DISTINCT author) AS authors FROM issues GROUP BY ALL", S.ISSUES_SQL)
def _(spark, d):
    return S.issues(spark, d).groupBy("is_pull_request", "state").agg(F.count("*").alias("n"), F.countDistinct("author").alias("authors"))


@register("e03_churn_topk", "SELECT path, count(*) AS churn FROM commit_files GROUP BY path ORDER BY churn DESC, path LIMIT 10", *HISTORY)
def _(spark, d):
    return mining.churn(S.commit_files(spark, d)).select("path", "churn").orderBy(F.desc("churn"), "path").limit(10)


@register("e04_symbols_per_file", "SELECT file_path AS path, count(*) AS symbols, count(*) FILTER (WHERE kind = 'class') AS classes FROM symbols GROUP BY file_path", S.SYMBOLS_SQL)
def _(spark, d):
    return S.symbols(spark, d).groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("symbols"), F.count_if(F.col("kind") == "class").alias("classes"))


DEGREE = "degree AS (SELECT path, count(*) AS degree FROM (SELECT src_file AS path FROM ends WHERE src_file <> dst_file UNION ALL SELECT dst_file FROM ends WHERE src_file <> dst_file) GROUP BY path)"


@register("e05_file_degree", "SELECT path, degree FROM degree", *GRAPH, ENDS, DEGREE)
def _(spark, d):
    return mining.file_degree(S.edges(spark, d), S.symbols(spark, d)).select("path", "degree")


@register(
    "e08_symbol_fan_in_out",
    "SELECT id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM (SELECT dst AS id, CAST(sum(tenths) AS BIGINT) AS fan_in FROM ends WHERE NOT starts_with(src_file, 'tests/') GROUP BY dst) FULL JOIN (SELECT src AS id, CAST(sum(tenths) AS BIGINT) AS fan_out FROM ends WHERE edge_type = 'call' AND NOT starts_with(dst_file, 'tests/') GROUP BY src) USING (id)",
    *GRAPH, ENDS,
)
def _(spark, d):
    return mining.fan_in_out(S.edges(spark, d), S.symbols(spark, d)).select("id", "fan_in", "fan_out")


@register(
    "e09_callers_confident",
    "SELECT s.id, s.qualified_name, s.file_path AS path, coalesce(c.callers, 0) AS callers, coalesce(c.confident, 0) AS confident_callers FROM symbols s LEFT JOIN (SELECT dst, count(*) AS callers, count(*) FILTER (WHERE tenths >= 8) AS confident FROM edges GROUP BY dst) c ON c.dst = s.id",
    *GRAPH,
)
def _(spark, d):
    return mining.symbol_index(S.symbols(spark, d), S.edges(spark, d)).select("id", "qualified_name", "path", "callers", "confident_callers")


@register("e17_edge_dedup_best", "SELECT src, dst, edge_type, max(t) AS tenths FROM raw_edges WHERE q >= 45 AND dst IS NOT NULL AND src <> dst GROUP BY ALL", S.EDGES_SQL)
def _(spark, d):
    return S.edges(spark, d).select("src", "dst", "edge_type", "tenths")


@register("e13_window_decision", "SELECT repo_id, latest, since, n AS multi_file_commits, n >= 5 AS windowed FROM (SELECT 1 AS repo_id, max(authored_at) AS latest, max(authored_at) - INTERVAL 180 DAY AS since FROM commits), (SELECT count(*) AS n FROM (SELECT f.sha FROM commit_files f JOIN commits c ON c.sha = f.sha WHERE c.authored_at >= (SELECT max(authored_at) - INTERVAL 180 DAY FROM commits) GROUP BY f.sha HAVING count(DISTINCT path) >= 2))", *HISTORY)
def _(spark, d):
    return mining.change_window(S.commits(spark, d), S.commit_files(spark, d))


@register("d01_dependents_of", f"SELECT s.id, s.qualified_name, s.file_path AS path, e.edge_type, e.tenths FROM edges e JOIN symbols s ON e.src = s.id WHERE e.dst = {START}", *GRAPH)
def _(spark, d):
    detail = mining.symbol_detail(S.edges(spark, d), S.symbols(spark, d), START)
    return detail.where("side = 'caller'").select("id", "qualified_name", "path", "edge_type", "tenths")


@register("d02_coupled_files", "SELECT src_file AS source, dst_file AS target, count(*) AS weight FROM ends WHERE src_file <> dst_file AND starts_with(src_file, 'src/') AND starts_with(dst_file, 'src/') GROUP BY ALL ORDER BY weight DESC, source, target LIMIT 10", *GRAPH, ENDS)
def _(spark, d):
    links = graph.file_graph(S.edges(spark, d), S.symbols(spark, d)).where(F.col("source").startswith("src/") & F.col("target").startswith("src/"))
    return links.select("source", "target", "weight").orderBy(F.desc("weight"), "source", "target").limit(10)


@register("d03_file_history", "SELECT f.path, c.sha, c.authored_at, f.insertions FROM commit_files f JOIN commits c USING (sha) WHERE f.path = (SELECT path FROM commit_files GROUP BY path ORDER BY count(*) DESC, path LIMIT 1) ORDER BY c.authored_at DESC, c.sha DESC LIMIT 8", *HISTORY)
def _(spark, d):
    changed = S.commit_files(spark, d)
    busiest = mining.churn(changed).orderBy(F.desc("churn"), "path").first()
    return views.history_of(S.commits(spark, d), changed, busiest["path"] if busiest else "")


@register("d04_symbol_detail", f"SELECT 'caller' AS side, src AS id, src_name AS qualified_name, src_file AS path, edge_type, tenths FROM ends WHERE dst = {START} UNION ALL SELECT 'callee', dst, dst_name, dst_file, edge_type, tenths FROM ends WHERE src = {START}", *GRAPH, ENDS)
def _(spark, d):
    return mining.symbol_detail(S.edges(spark, d), S.symbols(spark, d), START)


# references made from the raw edges: a third plain, by receiver, and as bases
REFS = "refs AS (SELECT DISTINCT src, CASE edge_type WHEN 'inherit' THEN 'base' ELSE 'plain' END AS kind, s.name || CASE WHEN e.t = 5 THEN '' ELSE '_' || (s.id % 40) END AS name FROM raw_edges e JOIN symbols s ON e.dst = s.id WHERE e.q >= 45 AND e.dst IS NOT NULL)"
DEFS = "defs AS (SELECT id, CASE WHEN id % 2 = 0 THEN name ELSE name || '_' || (id % 40) END AS name, kind FROM symbols)"


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    symbols = S.symbols(spark, d)
    defined = symbols.withColumn("name", F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit("_"), (F.col("id") % 40).cast("string"))))
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    raw = S.read(spark, d, "lineitem").withColumn("dst", F.lead("l_partkey").over(in_order)).where("l_quantity >= 45 and dst is not null")
    named = raw.join(symbols.select("id", "name"), raw["dst"] == symbols["id"])
    name = F.when(F.col("l_quantity") < 46, F.col("name")).otherwise(F.concat("name", F.lit("_"), (F.col("id") % 40).cast("string")))
    refs = named.select(F.lit(1).alias("repo_id"), F.col("l_partkey").alias("src"), F.when(F.col("l_returnflag") == "R", "base").otherwise("plain").alias("kind"), F.lit(None).cast("string").alias("receiver"), name.alias("name")).distinct()
    return refs, defined


@register(
    "d14_name_resolution",
    "SELECT src, dst, edge_type, max(tenths) AS tenths FROM (SELECT r.src, d.id AS dst, 'call' AS edge_type, CASE WHEN n.n = 1 THEN 10 ELSE 5 END AS tenths FROM refs r JOIN defs d ON d.name = r.name AND d.kind IN ('function', 'method') JOIN (SELECT name, count(*) AS n FROM defs WHERE kind IN ('function', 'method') GROUP BY name HAVING count(*) <= 8) n ON n.name = r.name WHERE r.kind = 'plain' UNION ALL SELECT r.src, d.id, 'inherit', CASE WHEN n.n = 1 THEN 10 ELSE 6 END FROM refs r JOIN defs d ON d.name = r.name AND d.kind = 'class' JOIN (SELECT name, count(*) AS n FROM defs WHERE kind = 'class' GROUP BY name) n ON n.name = r.name WHERE r.kind = 'base') WHERE src <> dst GROUP BY ALL",
    *GRAPH, REFS, DEFS,
)
def _(spark, d):
    refs, defined = _references(spark, d)
    return graph.resolve_references(refs, defined)[0].select("src", "dst", "edge_type", "tenths")


@register(
    "e18_resolution_counters",
    "SELECT tier, count(*) AS references FROM (SELECT CASE WHEN n.n IS NULL THEN 'unresolved' WHEN n.n = 1 THEN 'exact' ELSE 'fuzzy' END AS tier FROM refs r LEFT JOIN (SELECT name, count(*) AS n FROM defs WHERE kind IN ('function', 'method') GROUP BY name HAVING count(*) <= 8) n ON n.name = r.name WHERE r.kind = 'plain' UNION ALL SELECT 'inherit' FROM refs r WHERE r.kind = 'base' AND r.name IN (SELECT name FROM defs WHERE kind = 'class')) GROUP BY tier",
    *GRAPH, REFS, DEFS,
)
def _(spark, d):
    refs, defined = _references(spark, d)
    return graph.resolve_references(refs, defined)[1].select("tier", "references")


@register(
    "d15_mro_resolution",
    "WITH RECURSIVE own AS (SELECT n_name AS owner, 'm' || (n_nationkey % 4) AS method, n_nationkey AS id FROM nation), bases AS (SELECT a.n_name AS owner, b.n_name AS base FROM nation a JOIN nation b ON b.n_nationkey IN (a.n_nationkey * 2 + 1, a.n_nationkey * 2 + 2)), walk AS (SELECT n_name AS owner, n_name AS at, [n_name] AS path FROM nation UNION ALL SELECT w.owner, b.base, list_append(w.path, b.base) FROM walk w JOIN bases b ON b.owner = w.at WHERE NOT list_contains(w.path, b.base)) SELECT w.owner, o.method, CAST(arg_min(o.id, w.path) AS BIGINT) AS id FROM walk w JOIN own o ON o.owner = w.at GROUP BY ALL",
)
def _(spark, d):
    nation = S.read(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("k"))
    method = F.concat(F.lit("m"), (F.col("k") % 4).cast("string"))
    symbols = nation.select(F.lit(1).alias("repo_id"), F.col("k").alias("id"), F.lit("method").alias("kind"), method.alias("name"), F.concat("n_name", F.lit("."), method).alias("qualified_name"))
    a, b = nation.alias("a"), nation.alias("b")
    bases = a.select("n_name", F.explode(F.array(F.col("k") * 2 + 1, F.col("k") * 2 + 2)).alias("base_k")).join(b, F.col("base_k") == F.col("b.k")).select(F.lit(1).alias("repo_id"), F.col("a.n_name").alias("owner"), F.col("b.n_name").alias("base"))
    return graph.method_table(symbols, bases).select("owner", "method", "id")


@register("f02_fanout_cap", "SELECT src, dst, tenths, n FROM (SELECT src, dst, max(tenths) AS tenths, row_number() OVER (PARTITION BY src ORDER BY max(tenths) DESC, dst) AS n FROM edges WHERE edge_type = 'call' GROUP BY src, dst) WHERE n <= 8", *GRAPH)
def _(spark, d):
    return views.strongest_calls(S.edges(spark, d))


@register("f08_last_turns", "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def _(spark, d):
    return views.last_turns(S.read(spark, d, "conversations").select("conv_id", "turn", "role"))


@register("f09_latest_by_key", "SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def _(spark, d):
    return stream.latest_by_key(S.read(spark, d, "events").select("user_id", "ts", "event_type"), "user_id", "ts")


GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    items = S.read(spark, d, "benchmark").select("item_id", F.col("text").alias("item_text"))
    found = retrieval.containing(S.read(spark, d, "documents").select("doc_id", "text"), items, key="doc_id")
    return found.select(F.col("item_id").alias("query_id"), F.col("id").alias("item"))


@register("h03_recall_sets", "SELECT query_id, count(*) AS n_gold, min(item) AS first_item FROM gold GROUP BY query_id", GOLD)
def _(spark, d):
    return _gold(spark, d).groupBy("query_id").agg(F.count("*").alias("n_gold"), F.min("item").alias("first_item"))


REACH = """walk AS (SELECT id AS start, id AS node, 0 AS depth FROM starts UNION SELECT w.start, e.{to} AS node, w.depth + 1 FROM walk w JOIN (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'call') e ON e.{of} = w.node WHERE w.depth < {depth})"""


def _recursive(*tables: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(tables)


@register("i06_call_path", _recursive(*GRAPH, f"starts AS (SELECT {START} AS id)", REACH.format(to="dst", of="src", depth=4)) + " SELECT CAST(node AS BIGINT) AS node, min(depth) AS depth FROM walk GROUP BY node")
def _(spark, d):
    return graph.call_path(S.edges(spark, d), START)


STARTS = "starts AS (SELECT id FROM symbols WHERE kind <> 'class')"


def _starts(spark: SparkSession, d: str) -> DataFrame:
    return S.symbols(spark, d).where("kind <> 'class'").select("id")


@register("i07_upstream", _recursive(*GRAPH, STARTS, REACH.format(to="src", of="dst", depth=3)) + " SELECT start, node, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY start, node")
def _(spark, d):
    return graph.reach(mining.callers_of(S.edges(spark, d)), _starts(spark, d), 3)


# the SQL's bound of 40 steps lies beyond any distance here; the walk itself has none
@register("i18_shortest_path", _recursive(*GRAPH, "both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)", f"walk AS (SELECT {START} AS node, 0 AS depth UNION SELECT b.dst, w.depth + 1 FROM walk w JOIN both_ways b ON b.src = w.node WHERE w.depth < 40)") + f" SELECT {START} AS start, 19 AS stop, min(depth) AS steps FROM walk WHERE node = 19")
def _(spark, d):
    path = graph.shortest_path(S.edges(spark, d), START, 19)
    return spark.createDataFrame([(START, 19, None if path is None else len(path) - 1)], "start int, stop int, steps int")


LINKS = "links AS (SELECT src_file AS source, dst_file AS target, count(*) AS weight FROM ends WHERE src_file <> dst_file GROUP BY ALL)"


@register("i13_file_graph_links", "SELECT source, target, weight FROM links WHERE weight >= 2", *GRAPH, ENDS, LINKS)
def _(spark, d):
    return graph.file_graph(S.edges(spark, d), S.symbols(spark, d), min_weight=2).select("source", "target", "weight")


@register(
    "i13_file_graph_nodes",
    "SELECT n.path, n.degree, coalesce(t.folder, 'other') AS \"group\" FROM nodes n LEFT JOIN (SELECT folder FROM (SELECT folder, sum(degree) AS s FROM nodes GROUP BY folder) ORDER BY s DESC, folder LIMIT 3) t USING (folder)",
    *GRAPH, ENDS, LINKS, "nodes AS (SELECT path, CAST(sum(weight) AS BIGINT) AS degree, regexp_replace(path, '/[^/]*$', '') AS folder FROM (SELECT source AS path, weight FROM links UNION ALL SELECT target, weight FROM links) GROUP BY path)",
)
def _(spark, d):
    return graph.file_graph_nodes(graph.file_graph(S.edges(spark, d), S.symbols(spark, d))).select("path", "degree", "group")


@register("i14_symbol_graph", "SELECT src, dst, edge_type, tenths FROM ends WHERE starts_with(src_file, 'src/small/') AND starts_with(dst_file, 'src/small/')", *GRAPH, ENDS)
def _(spark, d):
    return graph.symbol_graph(S.edges(spark, d), S.symbols(spark, d), "src/small/", neighbours=False)


@register("i11_weighted_graph", "SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(tenths) AS BIGINT) AS weight FROM ends WHERE NOT starts_with(src_file, 'tests/') AND NOT starts_with(dst_file, 'tests/') GROUP BY ALL", *GRAPH, ENDS)
def _(spark, d):
    return graph.weighted_graph(S.edges(spark, d), S.symbols(spark, d)).select("a", "b", "weight")


@register("k10_communities")
def _(spark, d):
    edges, symbols = S.edges(spark, d), S.symbols(spark, d)
    return graph.describe_communities(graph.communities(edges, symbols), edges, symbols)


@register("k10_communities_merged")
def _(spark, d):
    return graph.merged_communities(S.edges(spark, d), S.symbols(spark, d))


HOT = "hot AS (SELECT coalesce(g.path, c.path) AS path, coalesce(degree, 0) AS degree, coalesce(churn, 0) AS churn FROM degree g FULL JOIN (SELECT path, count(*) AS churn FROM commit_files GROUP BY path) c ON g.path = c.path WHERE starts_with(coalesce(g.path, c.path), 'src/'))"


@register("k01_hotspots", "SELECT path, degree, churn, churn * (degree + 1) AS raw, (churn * (degree + 1)) / (SELECT max(churn * (degree + 1)) FROM hot) AS score FROM hot", *GRAPH, S.COMMIT_FILES_SQL, ENDS, DEGREE, HOT)
def _(spark, d):
    return mining.hotspots(S.edges(spark, d), S.symbols(spark, d), S.commit_files(spark, d)).drop("repo_id")


@register("k01_reading_path", "SELECT path, degree FROM degree WHERE starts_with(path, 'src/') ORDER BY degree DESC, path LIMIT 6", *GRAPH, ENDS, DEGREE)
def _(spark, d):
    degree = mining.file_degree(S.edges(spark, d), S.symbols(spark, d)).where(F.col("path").startswith("src/"))
    return degree.select("path", "degree").orderBy(F.desc("degree"), "path").limit(6)


FILES = "files AS (SELECT DISTINCT 1 AS repo_id, file_path AS path FROM symbols)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return S.symbols(spark, d).select("repo_id", F.col("file_path").alias("path")).distinct()


@register("k02_tree", "SELECT f.path, count(s.id) AS symbols FROM files f LEFT JOIN symbols s ON s.file_path = f.path AND s.kind <> 'import' GROUP BY f.path", S.SYMBOLS_SQL, FILES)
def _(spark, d):
    return mining.tree(_files(spark, d), S.symbols(spark, d)).select("path", "symbols")


@register("k06_top_folders", "SELECT split_part(path, '/', 1) AS folder, count(*) AS files FROM files GROUP BY 1", S.SYMBOLS_SQL, FILES)
def _(spark, d):
    return mining.top_folders(_files(spark, d)).select("folder", "files")


@register("k06_packages", "SELECT CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS package, count(*) AS files FROM files GROUP BY 1", S.SYMBOLS_SQL, FILES)
def _(spark, d):
    return mining.packages(_files(spark, d)).select("package", "files")


@register(
    "k06_submodules",
    "SELECT submodule, CAST(sum(n) AS BIGINT) AS symbols, count(*) AS files FROM (SELECT f.path, f.path[length(p.package) + 2:] AS submodule, (SELECT count(*) FROM symbols s WHERE s.file_path = f.path) AS n FROM files f, p WHERE starts_with(f.path, p.package || '/')) GROUP BY submodule",
    S.SYMBOLS_SQL, FILES, "p AS (SELECT split_part(path, '/', 1) AS package FROM (SELECT replace(path, 'src/', 'src_') AS path FROM files) WHERE false)",
)
def _(spark, d):
    return mining.submodules(_files(spark, d), S.symbols(spark, d)).select("submodule", "symbols", "files")


ORACLE_SQL["k06_submodules"] = (
    S.with_tables(S.SYMBOLS_SQL, FILES, "pk AS (SELECT CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS package FROM files), p AS (SELECT package FROM pk GROUP BY package ORDER BY count(*) DESC, package LIMIT 1)", "r AS (SELECT f.path, substr(f.path, length(p.package) + 2) AS rest FROM files f, p WHERE starts_with(f.path, p.package || '/'))")
    + " SELECT CASE WHEN contains(rest, '/') THEN split_part(rest, '/', 1) ELSE 'core' END AS submodule, CAST(sum(n) AS BIGINT) AS symbols, count(*) AS files FROM r JOIN (SELECT file_path, count(*) AS n FROM symbols GROUP BY file_path) s ON s.file_path = r.path GROUP BY 1"
)


@register("k08_dead_code", "SELECT id, qualified_name, kind, file_path AS path, start_line AS line, CASE WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END AS visibility FROM symbols s WHERE kind IN ('function', 'method') AND id NOT IN (SELECT dst FROM edges) AND NOT starts_with(file_path, 'tests/') AND NOT starts_with(name, 'test_') AND NOT starts_with(code, '@')", *GRAPH)
def _(spark, d):
    return mining.dead_code(S.symbols(spark, d), S.edges(spark, d)).drop("repo_id")


COUPLING = """recent AS (SELECT f.sha, f.path FROM commit_files f JOIN commits c ON c.sha = f.sha WHERE c.authored_at >= (SELECT max(authored_at) - INTERVAL 180 DAY FROM commits)),
multi AS (SELECT count(*) AS n FROM (SELECT sha FROM recent GROUP BY sha HAVING count(DISTINCT path) >= 2)),
used AS (SELECT sha, path FROM recent WHERE (SELECT n FROM multi) >= 5 UNION ALL SELECT sha, path FROM commit_files WHERE (SELECT n FROM multi) < 5),
kept AS (SELECT sha, path FROM used WHERE sha IN (SELECT sha FROM used GROUP BY sha HAVING count(*) BETWEEN 2 AND 20)),
support AS (SELECT path, count(*) AS n FROM kept GROUP BY path),
pairs AS (SELECT a.path AS a, b.path AS b, count(*) AS co_changes FROM kept a JOIN kept b ON a.sha = b.sha AND a.path < b.path GROUP BY ALL HAVING count(*) >= 3),
coupling AS (SELECT a, b, co_changes, x.n AS support_a, y.n AS support_b, co_changes / least(x.n, y.n) AS strength FROM pairs JOIN support x ON x.path = a JOIN support y ON y.path = b)"""


@register("k09_change_coupling", "SELECT a, b, co_changes, support_a, support_b, strength FROM coupling", *HISTORY, COUPLING)
def _(spark, d):
    return mining.coupling(S.commits(spark, d), S.commit_files(spark, d)).drop("repo_id")


@register(
    "k11_folder_heat",
    """SELECT dir, files, symbols, fan_in, fan_out, CASE WHEN fan_in >= 8 AND ratio >= 0.6 THEN 'hot core' WHEN ratio >= 0.6 AND fan_in >= 3 THEN 'foundational' WHEN fan_out >= 8 AND ratio <= 0.4 THEN 'orchestration' ELSE 'leaf / utility' END AS role, fan_in / greatest((SELECT max(fan_in) FROM r), 1) AS heat
FROM (SELECT *, CASE WHEN fan_in + fan_out > 0 THEN fan_in / (fan_in + fan_out) ELSE 0.0 END AS ratio FROM r)""",
    *GRAPH,
    "dirs AS (SELECT id, file_path, regexp_replace(file_path, '/[^/]*$', '') AS dir FROM symbols)",
    "x AS (SELECT s.dir AS sd, t.dir AS td, tenths FROM edges e JOIN dirs s ON e.src = s.id JOIN dirs t ON e.dst = t.id WHERE s.dir <> t.dir)",
    "r AS (SELECT dir, files, symbols, CAST(round_even(coalesce(i, 0) / 10, 0) AS BIGINT) AS fan_in, CAST(round_even(coalesce(o, 0) / 10, 0) AS BIGINT) AS fan_out FROM (SELECT dir, count(DISTINCT file_path) AS files, count(*) AS symbols FROM dirs GROUP BY dir) LEFT JOIN (SELECT td AS dir, sum(tenths) AS i FROM x GROUP BY td) USING (dir) LEFT JOIN (SELECT sd AS dir, sum(tenths) AS o FROM x GROUP BY sd) USING (dir) WHERE NOT starts_with(dir, 'tests'))",
)
def _(spark, d):
    return mining.folder_heat(S.edges(spark, d), S.symbols(spark, d)).drop("repo_id")


@register(
    "k12_impact",
    _recursive(*GRAPH, STARTS, REACH.format(to="src", of="dst", depth=3), "best AS (SELECT start, node, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY start, node)", "sums AS (SELECT start, count(*) FILTER (WHERE depth = 1) AS direct, count(*) AS callers, count(*) FILTER (WHERE starts_with(s.file_path, 'tests/')) AS test_callers FROM best JOIN symbols s ON s.id = node GROUP BY start)")
    + " SELECT id, direct, callers, test_callers, CASE WHEN direct = 0 AND NOT entrypoint THEN 'low' WHEN test_callers = 0 AND direct >= 3 THEN 'high' WHEN test_callers = 0 THEN 'medium' WHEN direct >= 6 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT id, id % 40 = 0 AS entrypoint, coalesce(direct, 0) AS direct, coalesce(callers, 0) AS callers, coalesce(test_callers, 0) AS test_callers FROM starts LEFT JOIN sums ON start = id)",
)
def _(spark, d):
    starts = _starts(spark, d).withColumn("entrypoint", F.col("id") % 40 == 0)
    return mining.impact(S.edges(spark, d), S.symbols(spark, d), starts)


# the queries are a fixed list: the benchmark's items
TERMS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
BM25 = f"""q AS (SELECT item_id AS query_id, unnest(list_distinct({TERMS.format("text")})) AS term FROM benchmark),
w AS (SELECT doc_id AS id, {TERMS.format("text")} AS terms FROM documents),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM w WHERE len(terms) > 0),
p AS (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM w),
tf AS (SELECT id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT q.query_id, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
bm AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    docs = S.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.top_k(retrieval.bm25(docs, _items(spark, d), k=k), k)


@register("j01_bm25_topk", "SELECT query_id, id, rank FROM bm WHERE rank <= 10", BM25)
def _(spark, d):
    return _bm25(spark, d, 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


KNN = "kn AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 {})"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


@register("j03_knn_topk", "SELECT query_id, id, rank FROM kn WHERE rank <= 5", KNN.format(""))
def _(spark, d):
    v, q = _vectors(spark, d)
    return retrieval.knn_blocks(v, q, 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@register("j04_knn_prefiltered", "SELECT query_id, id, rank FROM kn WHERE rank <= 5", KNN.format("AND v.label = 3"))
def _(spark, d):
    v, q = _vectors(spark, d)
    return retrieval.knn_blocks(v, q, 5, where=F.col("label") == 3).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@register("j04_knn_postfiltered", "SELECT query_id, id, rank FROM kn WHERE rank <= 20 AND label = 3", KNN.format(""))
def _(spark, d):
    v, q = _vectors(spark, d)
    return retrieval.knn_blocks(v, q, 20, where=F.col("label") == 3, post_filter=True).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


FUSED = "fu AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, id, rank FROM kn WHERE rank <= 20) GROUP BY ALL)"


@register("j06_rrf", "SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM fu) WHERE rank <= 5", BM25, KNN.format(""), FUSED)
def _(spark, d):
    v, q = _vectors(spark, d)
    words = _bm25(spark, d, 20).select("query_id", F.lit("bm25").alias("list"), "id", "rank")
    near = retrieval.knn_blocks(v, q, 20).select("query_id", F.lit("knn").alias("list"), "id", "rank")
    return retrieval.top_k(retrieval.rrf(words.unionByName(near)), 5, places=12).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@register("j08_cross_stream", "SELECT query_id, source, id, rank FROM (SELECT query_id, source, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, source, id) AS rank FROM (SELECT query_id, 'doc' AS source, id, rank FROM bm WHERE rank <= 15 UNION ALL SELECT query_id, 'vector', id, rank FROM kn WHERE rank <= 15) GROUP BY query_id, source, id) WHERE rank <= 8", BM25, KNN.format(""))
def _(spark, d):
    v, q = _vectors(spark, d)
    words = _bm25(spark, d, 15).select("query_id", F.lit("doc").alias("source"), "id", "rank")
    near = retrieval.knn_blocks(v, q, 15).select("query_id", F.lit("vector").alias("source"), "id", "rank")
    return retrieval.search_streams([words, near]).select("query_id", "source", "id", F.col("rank").cast("long").alias("rank"))


# the whole jobs behind queries whose SQL, all pairs of rows, is kept to ten queries: every hundredth
# vector as a query, and every benchmark item
SCAN = "fl AS (SELECT 'src/' || source || '_' || (doc_id % 9) || '.py' AS path, CAST(max(n_chars) AS BIGINT) AS loc FROM documents GROUP BY 1), ch AS (SELECT 'src/src' || (o_custkey % 20) || '_' || (o_orderkey % 9) || '.py' AS path, count(*) AS churn FROM orders GROUP BY 1)"


@register("k22_scan_selection", "SELECT path, loc, churn, place FROM (SELECT path, loc, coalesce(churn, 0) AS churn, row_number() OVER (ORDER BY coalesce(churn, 0) DESC, loc DESC, path) AS place FROM fl LEFT JOIN ch USING (path)) WHERE place <= 50", SCAN)
def _(spark, d):
    docs, orders = S.read(spark, d, "documents"), S.read(spark, d, "orders")
    name = F.concat(F.lit("src/"), F.col("source"), F.lit("_"), (F.col("doc_id") % 9).cast("string"), F.lit(".py"))
    files = docs.groupBy(name.alias("path")).agg(F.max("n_chars").alias("loc")).select(F.lit(1).alias("repo_id"), "path", "loc", P.category(F.col("path")).alias("category"))
    changed = F.concat(F.lit("src/src"), (F.col("o_custkey") % 20).cast("string"), F.lit("_"), (F.col("o_orderkey") % 9).cast("string"), F.lit(".py"))
    churn = mining.churn(orders.select(F.lit(1).alias("repo_id"), changed.alias("path")))
    return findings.select_files(files, churn).select("path", "loc", "churn", F.col("place").cast("long").alias("place"))


RAW = "raw AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN ' Logic' WHEN 1 THEN 'security' WHEN 2 THEN 'STYLE ' ELSE 'other' END AS category, CASE quality WHEN 1 THEN 'HIGH' ELSE 'none' END AS severity, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'T' || doc_id END AS title, CASE WHEN doc_id % 5 = 0 THEN '2.5' ELSE CAST(n_chars % 300 - 3 AS VARCHAR) END AS start_line, CAST(n_chars % 200 AS VARCHAR) AS end_line, CAST(n_chars % 250 AS BIGINT) AS n_lines FROM labels JOIN documents USING (doc_id))"


@register("k22_coercion", "SELECT id, lower(trim(category)) AS category, CASE WHEN lower(severity) IN ('high', 'medium', 'low') THEN lower(severity) ELSE 'medium' END AS severity, trim(title) AS title, b AS start_line, CASE WHEN e >= b THEN least(e, greatest(n_lines, 1)) ELSE b END AS end_line FROM (SELECT *, least(s, greatest(n_lines, 1)) AS b FROM (SELECT *, CASE WHEN contains(start_line, '.') THEN NULL ELSE CAST(start_line AS BIGINT) END AS s, CAST(end_line AS BIGINT) AS e FROM raw) WHERE s >= 1 AND length(trim(title)) > 0 AND lower(trim(category)) IN ('logic', 'security', 'style'))", RAW)
def _(spark, d):
    rows = S.read(spark, d, "labels").join(S.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    k = F.col("doc_id")
    category = F.when(k % 4 == 0, " Logic").when(k % 4 == 1, "security").when(k % 4 == 2, "STYLE ").otherwise("other")
    start = F.when(k % 5 == 0, F.lit(None)).otherwise((F.col("n_chars") % 300 - 3).cast("string"))
    raw = rows.select(k.alias("id"), category.alias("category"), F.when(F.col("quality") == 1, "HIGH").otherwise("none").alias("severity"), F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("T"), k.cast("string"))).alias("title"), start.alias("start_line"), (F.col("n_chars") % 200).cast("string").alias("end_line"), (F.col("n_chars") % 250).alias("n_lines"))
    return findings.coerce_columns(raw)


@register("k23_finding_list", "SELECT id, status, severity, file_path, start_line, row_number() OVER (ORDER BY status, severity, file_path, start_line, id) AS place, CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank FROM findings", S.FINDINGS_SQL)
def _(spark, d):
    out = findings.listed(S.findings(spark, d))
    return out.select("id", "status", "severity", "file_path", "start_line", F.col("place").cast("long").alias("place"), F.col("severity_rank").cast("int").alias("severity_rank"))


@register("b05_replace_findings", "SELECT id, title, status FROM findings WHERE status = 'ticketed' UNION ALL SELECT id + 1000000, 'again ' || title, 'new' FROM findings WHERE category = 'logic'", S.FINDINGS_SQL)
def _(spark, d):
    old = S.findings(spark, d).select("id", "title", "status", "category")
    new = old.where("category = 'logic'").select((F.col("id") + 1000000).alias("id"), F.concat(F.lit("again "), "title").alias("title"), F.lit("new").alias("status"), "category")
    return findings.replace_findings(old, new).select("id", "title", "status")


@register("b06_set_status", "SELECT id, CASE WHEN status = 'new' AND severity = 'low' THEN 'dismissed' ELSE status END AS status FROM findings", S.FINDINGS_SQL)
def _(spark, d):
    all_ = S.findings(spark, d)
    return findings.set_status(all_, all_.where("severity = 'low'").select("id"), "dismissed").select("id", "status")


GOLD_SET = "gs AS (SELECT c.sha, trim(message) AS subject, c.authored_at, count(*) AS n_gold, min(path) AS first_path FROM commits c JOIN commit_files f ON f.sha = c.sha AND ends_with(path, '.py') AND NOT starts_with(path, 'tests/') WHERE n_parents <= 1 AND length(trim(message)) >= 12 GROUP BY ALL HAVING count(*) BETWEEN 1 AND 4)"


@register("k24_gold_set", "SELECT sha, subject, n_gold, first_path FROM gs ORDER BY authored_at DESC, sha DESC LIMIT 40", *HISTORY, GOLD_SET)
def _(spark, d):
    out = evaluation.gold_set(S.commits(spark, d), S.commit_files(spark, d))
    return out.select("sha", "subject", F.size("gold").cast("long").alias("n_gold"), F.col("gold")[0].alias("first_path"))


LOCAL = "m AS (SELECT g.query_id, count(DISTINCT g.item) AS n_gold, min(bm.rank) AS best, " + ", ".join(f"count(bm.rank) FILTER (WHERE bm.rank <= {k}) AS f{k}" for k in evaluation.CUTS) + " FROM gold g LEFT JOIN bm ON bm.query_id = g.query_id AND bm.id = g.item AND bm.rank <= 15 GROUP BY g.query_id)"


@register("k25_localization_metrics", "SELECT query_id, n_gold, " + ", ".join(f"f{k} / n_gold AS recall_{k}, CASE WHEN f{k} > 0 THEN 1 ELSE 0 END AS hit_{k}" for k in evaluation.CUTS) + ", coalesce(1 / best, 0.0) AS mrr FROM m", GOLD, BM25, LOCAL)
def _(spark, d):
    predicted = _bm25(spark, d, 15).select("query_id", F.col("id").alias("item"), "rank")
    return evaluation.localisation(predicted, _gold(spark, d))


CITE = "ans AS (SELECT conv_id * 100 + turn AS id, 'see [' || (turn + 1) || '] and [' || (conv_id % 9) || '] or [' || (turn + 1) || ']' AS text, 5 AS n_sources, turn + 1 AS a, conv_id % 9 AS b FROM conversations)"


@register("k26_citation_validity", "SELECT id, 3 AS total, CASE WHEN a = b THEN 1 ELSE 2 END AS \"distinct\", 2 * CASE WHEN a BETWEEN 1 AND 5 THEN 1 ELSE 0 END + CASE WHEN b BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS valid FROM ans", CITE)
def _(spark, d):
    c = S.read(spark, d, "conversations")
    a, b = (F.col("turn") + 1).cast("string"), (F.col("conv_id") % 9).cast("string")
    text = F.concat(F.lit("see ["), a, F.lit("] and ["), b, F.lit("] or ["), a, F.lit("]"))
    return evaluation.citation_validity(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), text.alias("text"), F.lit(5).alias("n_sources")))


@register("k03_file_view", "SELECT id, name, kind, start_line FROM symbols WHERE file_path = (SELECT min(file_path) FROM symbols) AND kind <> 'import'", S.SYMBOLS_SQL)
def _(spark, d):
    symbols = S.symbols(spark, d)
    first = symbols.agg(F.min("file_path").alias("file_path"))  # one row
    return symbols.where("kind <> 'import'").join(F.broadcast(first), "file_path").select("id", "name", "kind", "start_line")


@register("l01_path_parts", "SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]+$') AS base, regexp_extract(path, '\\.[^.]+$') AS ext, array_to_string(string_split(path, '/')[-2:], '/') AS label FROM files", S.SYMBOLS_SQL, FILES)
def _(spark, d):
    p = F.col("path")
    return _files(spark, d).select("path", P.dirname(p).alias("dir"), P.basename(p).alias("base"), P.extension(p).alias("ext"), P.last_two(p).alias("label"))


@register("a01_url_normalise", "SELECT page_id, regexp_replace(u, '^(https?://[^/]+/[^/]+/[^/]+)/(tree|blob|commits|commit|pull|pulls|issues|releases|wiki)(/.*)?$', '\\1') AS url FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+') || '/o/r' || CASE page_id % 3 WHEN 0 THEN '/tree/main' WHEN 1 THEN '' ELSE '/other/x' END AS u FROM pages)")
def _(spark, d):
    pages = S.read(spark, d, "pages").select("page_id", "url")
    tail = F.when(F.col("page_id") % 3 == 0, "/tree/main").when(F.col("page_id") % 3 == 1, "").otherwise("/other/x")
    url = F.concat(F.regexp_extract("url", "^https?://[^/]+", 0), F.lit("/o/r"), tail)
    return pages.select("page_id", P.normalise_repo_url(url).alias("url"))


@register("l04_first_sentence", "SELECT doc_id, left(CASE WHEN strpos(c, '. ') > 0 THEN left(c, strpos(c, '. ')) ELSE c END, 220) AS sentence FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS c FROM documents)")
def _(spark, d):
    return S.read(spark, d, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@register("x_events_windowed", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    out = stream.windowed_counts(S.read(spark, d, "events").select("ts", "event_type"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
