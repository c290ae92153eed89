"""Change history and structure: coupling, hotspots, dead code, folders, architecture, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..lineage import cut

# The window, the largest commit that says anything, the least support of a pair.
WINDOW_DAYS = 180
MAX_COMMIT_FILES = 20
MIN_SUPPORT = 3
SPARSE_COMMITS = 5


def commit_sizes(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(repo_id, sha, n, latest, since, recent): distinct files of each commit that has any, and the window."""
    latest = commits.groupBy("repo_id").agg(F.max("authored_at").alias("latest")).withColumn("since", F.expr(f"latest - interval {WINDOW_DAYS} days"))
    n = commit_files.groupBy("repo_id", "sha", "path").agg(F.lit(1).alias("one")).groupBy("repo_id", "sha").agg(F.count("*").alias("n"))
    # a repository is a row: small next to its commits
    return commits.select("repo_id", "sha", "authored_at").join(n, ["repo_id", "sha"]).join(latest, "repo_id").select("repo_id", "sha", "n", "latest", "since", (F.col("authored_at") >= F.col("since")).alias("recent"))


def change_window(commits: DataFrame, commit_files: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row a repository: latest, since, multi-file commits in the window, whether it holds."""
    latest = commits.groupBy("repo_id").agg(F.max("authored_at").alias("latest")).withColumn("since", F.expr(f"latest - interval {WINDOW_DAYS} days"))
    sizes = commit_sizes(commits, commit_files) if sizes is None else sizes
    counted = sizes.where("recent and n >= 2").select("repo_id", "sha").distinct().groupBy("repo_id").agg(F.count("*").alias("multi_file_commits"))
    n = F.coalesce("multi_file_commits", F.lit(0))
    return latest.join(counted, "repo_id", "left").select("repo_id", "latest", "since", n.alias("multi_file_commits"), (n >= SPARSE_COMMITS).alias("windowed"))


def coupling(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Pairs of files that change together: (repo_id, a, b, co_changes, support_a, support_b, strength).

    Commits of 2 to MAX_COMMIT_FILES files count. They are known by their number of files, counted
    once for the window and the cap, before any paths are gathered; so no array holds more than the
    cap, and a commit gives at most 190 pairs.
    """
    sizes = cut(commit_sizes(commits, commit_files))
    window = change_window(commits, commit_files, sizes).select("repo_id", "windowed")
    used = sizes.where(F.col("n").between(2, MAX_COMMIT_FILES)).join(window, "repo_id").where("not windowed or recent").select("repo_id", "sha")
    changed = commit_files.select("repo_id", "sha", "path").join(used, ["repo_id", "sha"], "left_semi")
    sets = changed.groupBy("repo_id", "sha").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    support = sets.select("repo_id", F.explode("paths").alias("path")).groupBy("repo_id", "path").agg(F.count("*").alias("support"))
    # pairs inside a bounded array: no join
    later = F.transform("paths", lambda a, i: F.transform(F.slice("paths", i + 2, MAX_COMMIT_FILES), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = sets.select("repo_id", F.explode(F.flatten(later)).alias("p")).groupBy("repo_id", "p.a", "p.b").agg(F.count("*").alias("co_changes"))
    kept = pairs.where((F.col("co_changes") >= MIN_SUPPORT) & ~P.is_noise(F.col("a")) & ~P.is_noise(F.col("b")))
    left = support.select("repo_id", F.col("path").alias("a"), F.col("support").alias("support_a"))
    right = support.select("repo_id", F.col("path").alias("b"), F.col("support").alias("support_b"))
    out = kept.join(left, ["repo_id", "a"]).join(right, ["repo_id", "b"])
    return out.select("repo_id", "a", "b", "co_changes", "support_a", "support_b", (F.col("co_changes") / F.least("support_a", "support_b")).alias("strength"))


def churn(commit_files: DataFrame) -> DataFrame:
    return commit_files.groupBy("repo_id", "path").agg(F.count("*").alias("churn"))


def file_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with the files and names of both ends."""
    end = symbols.select("repo_id", "id", "file_path", "qualified_name", "kind")
    src = end.select("repo_id", F.col("id").alias("src"), F.col("file_path").alias("src_file"), F.col("qualified_name").alias("src_name"), F.col("kind").alias("src_kind"))
    dst = end.select("repo_id", F.col("id").alias("dst"), F.col("file_path").alias("dst_file"), F.col("qualified_name").alias("dst_name"), F.col("kind").alias("dst_kind"))
    return edges.join(src, ["repo_id", "src"]).join(dst, ["repo_id", "dst"])


def file_degree(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Cross-file edges of any kind, counted at both ends."""
    crossing = file_edges(edges, symbols).where("src_file <> dst_file")
    return crossing.select("repo_id", F.explode(F.array("src_file", "dst_file")).alias("path")).groupBy("repo_id", "path").agg(F.count("*").alias("degree"))


def hotspots(edges: DataFrame, symbols: DataFrame, commit_files: DataFrame, core: str = "src/") -> DataFrame:
    """churn x (degree + 1) of core files, and that over the repository's largest."""
    both = file_degree(edges, symbols).join(churn(commit_files), ["repo_id", "path"], "full").where(F.col("path").startswith(core))
    degree, changes = F.coalesce("degree", F.lit(0)), F.coalesce("churn", F.lit(0))
    raw = both.select("repo_id", "path", degree.alias("degree"), changes.alias("churn"), (changes * (degree + 1)).alias("raw"))
    top = F.max("raw").over(Window.partitionBy("repo_id"))
    return raw.withColumn("score", F.col("raw") / F.when(top > 0, top).otherwise(1))


def folder_heat(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Folders by what other folders call in them: fan-in and fan-out in tenths of confidence, role."""
    where = symbols.select("repo_id", "id", P.dirname(F.col("file_path")).alias("dir"), "file_path")
    size = where.groupBy("repo_id", "dir").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("symbols"))
    ends = edges.join(where.select("repo_id", F.col("id").alias("src"), F.col("dir").alias("src_dir")), ["repo_id", "src"]).join(where.select("repo_id", F.col("id").alias("dst"), F.col("dir").alias("dst_dir")), ["repo_id", "dst"]).where("src_dir <> dst_dir")
    sides = ends.select("repo_id", F.explode(F.array(F.struct(F.col("dst_dir").alias("dir"), F.col("tenths").alias("i"), F.lit(0).alias("o")), F.struct(F.col("src_dir").alias("dir"), F.lit(0).alias("i"), F.col("tenths").alias("o")))).alias("s"))
    fans = sides.groupBy("repo_id", "s.dir").agg(F.sum("s.i").alias("in_tenths"), F.sum("s.o").alias("out_tenths"))
    rows = size.join(fans, ["repo_id", "dir"], "full").where(~F.col("dir").startswith("tests") & (F.col("dir") != P.ROOT))
    # tenths to the nearest integer, halves to even
    fan_in, fan_out = (F.bround(F.coalesce(c, F.lit(0)) / 10, 0).cast("long") for c in ("in_tenths", "out_tenths"))
    rows = rows.select("repo_id", "dir", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("symbols", F.lit(0)).alias("symbols"), fan_in.alias("fan_in"), fan_out.alias("fan_out"))
    ratio = F.when(F.col("fan_in") + F.col("fan_out") > 0, F.col("fan_in") / (F.col("fan_in") + F.col("fan_out"))).otherwise(F.lit(0.0))
    top = F.max("fan_in").over(Window.partitionBy("repo_id"))
    return rows.withColumn("role", folder_role(F.col("fan_in"), F.col("fan_out"), ratio)).withColumn("heat", F.col("fan_in") / F.when(top > 0, top).otherwise(1))


def folder_role(fan_in: Column, fan_out: Column, ratio: Column) -> Column:
    hot = (fan_in >= 8) & (ratio >= 0.6)
    base = (ratio >= 0.6) & (fan_in >= 3)
    return F.when(hot, "hot core").when(base, "foundational").when((fan_out >= 8) & (ratio <= 0.4), "orchestration").otherwise("leaf / utility")


def dead_code(symbols: DataFrame, edges: DataFrame, entrypoints: DataFrame | None = None) -> DataFrame:
    """Callables that no edge ends at and that nothing else explains."""
    found = symbols.where(F.col("kind").isin("function", "method")).join(edges.select("repo_id", F.col("dst").alias("id")), ["repo_id", "id"], "left_anti")
    if entrypoints is not None:
        found = found.join(entrypoints.select("repo_id", F.col("symbol_id").alias("id")), ["repo_id", "id"], "left_anti")
    name = F.col("name")
    dunder = name.startswith("__") & name.endswith("__")
    decorated = F.ltrim(F.coalesce("code", F.lit(""))).startswith("@")
    kept = found.where(~P.is_test_symbol(F.col("file_path"), name) & ~dunder & ~decorated)
    private = name.startswith("_")
    return kept.select("repo_id", "id", "qualified_name", "kind", F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.when(private, "private").otherwise("public").alias("visibility"))


# What top-level folders are called.
FOLDER_LABELS = {
    "src": "Core library code", "lib": "Core library code", "app": "Application code",
    "tests": "Tests", "test": "Tests", "docs": "Documentation", "doc": "Documentation",
    "examples": "Examples", "example": "Examples", "benchmarks": "Benchmarks & performance",
    "bench": "Benchmarks", "scripts": "Scripts", "tools": "Tooling", "ci": "CI",
}
LAYERS = ("sansio", "base", "core", "abc")


def top_folders(files: DataFrame) -> DataFrame:
    """Labelled first segments with their number of files."""
    labels = F.create_map(*[F.lit(x) for pair in FOLDER_LABELS.items() for x in pair])
    first = P.first_segment(F.col("path"))
    return files.where(F.col("path").contains("/")).groupBy("repo_id", first.alias("folder")).agg(F.count("*").alias("files")).withColumn("label", F.element_at(labels, F.lower("folder"))).where("label is not null")


def packages(files: DataFrame) -> DataFrame:
    """Each repository's package: the folder of depth one or two that holds most files."""
    parts = F.split("path", "/")
    package = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])
    return files.groupBy("repo_id", package.alias("package")).agg(F.count("*").alias("files"))


def submodules(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Parts of the primary package by their symbols, with their three largest files."""
    first = Window.partitionBy("repo_id").orderBy(F.desc("files"), "package")
    primary = packages(files).withColumn("n", F.row_number().over(first)).where("n = 1").select("repo_id", "package")
    inside = files.join(primary, "repo_id").where(F.expr("startswith(path, concat(package, '/'))"))
    rest = F.expr("substring(path, length(package) + 2)")
    part = F.when(rest.contains("/"), F.substring_index(rest, "/", 1)).otherwise("core")
    count = symbols.where("kind <> 'import'").groupBy("repo_id", F.col("file_path").alias("path")).agg(F.count("*").alias("symbols"))
    rows = inside.select("repo_id", "path", part.alias("submodule")).join(count, ["repo_id", "path"], "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("symbols")).alias("k"), "path")))
    out = rows.groupBy("repo_id", "submodule").agg(F.sum("symbols").alias("symbols"), F.count("*").alias("files"), F.slice(ordered, 1, 3)["path"].alias("evidence"))
    return out


def tree(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every file with its symbols but imports."""
    count = symbols.where("kind <> 'import'").groupBy("repo_id", F.col("file_path").alias("path")).agg(F.count("*").alias("symbols"))
    return files.join(count, ["repo_id", "path"], "left").select("repo_id", "path", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def symbol_index(symbols: DataFrame, edges: DataFrame, confident: int = 8) -> DataFrame:
    """Symbols with how many call them, and how many with confidence 0.8 or more."""
    callers = edges.groupBy("repo_id", F.col("dst").alias("id")).agg(F.count("*").alias("callers"), F.count_if(F.col("tenths") >= confident).alias("confident_callers"))
    return symbols.where("kind <> 'import'").join(callers, ["repo_id", "id"], "left").select("repo_id", "id", "name", "qualified_name", F.col("file_path").alias("path"), F.left("signature", F.lit(200)).alias("signature"), F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("confident_callers", F.lit(0)).alias("confident_callers"))


def definitions(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, name, ids): a name's symbols, the most called first."""
    return symbol_index(symbols, edges).groupBy("repo_id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("callers"), "id"))), lambda x: x["id"]).alias("ids"))


def core_models(symbols: DataFrame, fans: DataFrame, package: str, limit: int = 3, least: int = 20) -> DataFrame:
    """The package's classes that most depends on, from a fan-in of `least` tenths on."""
    rows = symbols.where((F.col("kind") == "class") & F.col("file_path").startswith(f"{package}/")).join(fans, ["repo_id", "id"]).where(F.col("fan_in") >= least)
    return rows.select("id", "qualified_name", "file_path", "fan_in").orderBy(F.desc("fan_in"), "id").limit(limit)


def visibility_totals(dead: DataFrame) -> DataFrame:
    """How many dead callables are private and public."""
    return dead.groupBy("repo_id").agg(F.count_if(F.col("visibility") == "private").alias("private"), F.count_if(F.col("visibility") == "public").alias("public"))


def latest_repo(repos: DataFrame) -> DataFrame:
    """The active repository: the one ingested last."""
    return repos.orderBy(F.desc("id")).limit(1)


def symbol_detail(edges: DataFrame, symbols: DataFrame, symbol: int) -> DataFrame:
    """Callers and callees of one symbol."""
    linked = file_edges(edges.where((F.col("src") == symbol) | (F.col("dst") == symbol)), symbols)
    incoming = linked.where(F.col("dst") == symbol).select(F.lit("caller").alias("side"), F.col("src").alias("id"), F.col("src_name").alias("qualified_name"), F.col("src_file").alias("path"), "edge_type", "tenths")
    outgoing = linked.where(F.col("src") == symbol).select(F.lit("callee").alias("side"), F.col("dst").alias("id"), F.col("dst_name").alias("qualified_name"), F.col("dst_file").alias("path"), "edge_type", "tenths")
    return incoming.unionByName(outgoing)


def fan_in_out(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tenths of confidence into a symbol from non-test code, and out of it to non-test code by calls."""
    plain = file_edges(edges, symbols)
    incoming = plain.where(~P.under_tests(F.col("src_file"))).groupBy("repo_id", F.col("dst").alias("id")).agg(F.sum("tenths").alias("fan_in"))
    outgoing = plain.where((F.col("edge_type") == "call") & ~P.under_tests(F.col("dst_file"))).groupBy("repo_id", F.col("src").alias("id")).agg(F.sum("tenths").alias("fan_out"))
    return incoming.join(outgoing, ["repo_id", "id"], "full").select("repo_id", "id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


# What marks an entrypoint in a callable's code, and the order in which kinds are shown.
ROUTE_PATH = r"""(?i)@\s*[\w.]+\.(?:route|get|post|put|delete|patch|websocket)\s*\(\s*["']([^"']*)["']"""
ROUTE_ANY = r"(?i)@\s*[\w.]+\.(?:route|get|post|put|delete|patch|websocket)\s*\("
ADD_URL = r"""\.add_url_rule\s*\(\s*["']([^"']*)["']"""
CLI = r"@\s*(?:click\.(?:command|group)|[\w.]+\.command)\b"
WORKER = r"@\s*(?:shared_task|celery\.task|[\w.]+\.task)\b"
MAIN_GUARD = r"""if\s+__name__\s*==\s*["']__main__["']"""
KIND_ORDER = ("route", "factory", "cli", "worker", "main", "module")
FACTORIES = ("create_app", "make_app")


def entrypoints(symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(repo_id, kind, label, path, line, symbol_id): callables by the first mark that fits, scripts."""
    from ..functions.text import line_of

    code, own = F.coalesce("code", F.lit("")), F.col("qualified_name")
    where = F.coalesce(F.nullif(F.regexp_extract(code, ROUTE_PATH, 1), F.lit("")), F.nullif(F.regexp_extract(code, ADD_URL, 1), F.lit("")), F.lit("/"))
    kind = F.when(code.rlike(ROUTE_PATH) | code.rlike(ADD_URL) | code.rlike(ROUTE_ANY), "route").when(code.rlike(CLI), "cli").when(code.rlike(WORKER), "worker").when(F.col("name").isin(*FACTORIES), "factory").when((F.col("name") == "main") & (F.col("kind") == "function"), "main")
    label = F.when(code.rlike(ROUTE_PATH) | code.rlike(ADD_URL), where).otherwise(own)
    callables = symbols.where(F.col("kind").isin("function", "method") & ~P.under_tests(F.col("file_path")))
    out = callables.select("repo_id", kind.alias("kind"), label.alias("label"), F.col("file_path").alias("path"), F.col("start_line").cast("long").alias("line"), F.col("id").cast("long").alias("symbol_id")).where("kind is not null")
    if files is not None:
        scripts = files.where(F.col("category").isin("code", "test", "config") & F.col("content").rlike(MAIN_GUARD) & ~P.under_tests(F.col("path")))
        out = out.unionByName(scripts.select("repo_id", F.lit("module").alias("kind"), P.basename(F.col("path")).alias("label"), "path", line_of(F.col("content"), MAIN_GUARD).cast("long").alias("line"), F.lit(None).cast("long").alias("symbol_id")))
    rank = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    return out.withColumn("kind_rank", rank)


def risk(fan_in: Column, tests: Column, entrypoint: Column) -> Column:
    """How risky a change is: unused is low; untested is high from three callers on; else by callers."""
    return F.when((fan_in == 0) & ~entrypoint, "low").when((tests == 0) & (fan_in >= 3), "high").when(tests == 0, "medium").when(fan_in >= 6, "medium").otherwise("low")


def impact(edges: DataFrame, symbols: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """For every start symbol: direct callers, all callers within depth, those in tests, the risk.

    starts: (id, entrypoint boolean). Depths are least distances over reversed call edges, without a
    cap on nodes; impact_callers has the capped walk of a single report.
    """
    from .graph import reach

    found = reach(callers_of(edges), starts.select("id"), depth)
    where = symbols.select(F.col("id").alias("node"), P.under_test_folders(F.col("file_path")).alias("tests"))
    sums = found.join(where, "node").groupBy("start").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("callers"), F.count_if("tests").alias("test_callers"))
    rows = starts.join(sums, starts["id"] == sums["start"], "left").select("id", "entrypoint", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("direct", "callers", "test_callers")])
    return rows.select("id", "direct", "callers", "test_callers", risk(F.col("direct"), F.col("test_callers"), F.col("entrypoint")).alias("risk"))


def callers_of(edges: DataFrame) -> DataFrame:
    """Call edges the other way round, as (src, dst)."""
    return edges.where("edge_type = 'call'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def impact_callers(edges: DataFrame, symbols: DataFrame, starts: DataFrame, depth: int = 3, max_nodes: int = 60) -> DataFrame:
    """The callers that a report lists: (start, id, qualified_name, path, depth, tests, place), at most max_nodes a start.

    place: direct callers by name, then the others by depth and name.
    """
    from .graph import capped_reach

    found = capped_reach(callers_of(edges), starts.select("id"), depth, max_nodes)
    named = symbols.select(F.col("id").alias("node"), "qualified_name", F.col("file_path").alias("path"), P.under_test_folders(F.col("file_path")).alias("tests"))
    place = F.row_number().over(Window.partitionBy("start").orderBy("depth", "qualified_name", "id"))
    return found.join(named, "node").select("start", F.col("node").alias("id"), "qualified_name", "path", "depth", "tests").withColumn("place", place)


# What a report says for each level of risk.
RISK_REASONS = {
    "unused": "Nothing in the repository calls this; it may still be used from outside.",
    "untested_wide": "Called from {n} with no test found on the way: a change is wide and unchecked.",
    "untested": "No test was found on the way: check a change by hand.",
    "tested_wide": "Called from {n}, with tests: look at the callers.",
    "tested": "Tests were found, and the callers are few.",
}


def risk_reason(fan_in: Column, tests: Column, entrypoint: Column) -> Column:
    """The sentence behind risk's level."""

    from ..functions.text import plural

    def say(key: str) -> Column:
        return F.replace(F.lit(RISK_REASONS[key]), F.lit("{n}"), plural(fan_in, "place"))

    return F.when((fan_in == 0) & ~entrypoint, say("unused")).when((tests == 0) & (fan_in >= 3), say("untested_wide")).when(tests == 0, say("untested")).when(fan_in >= 6, say("tested_wide")).otherwise(say("tested"))


def coupled_files(pairs: DataFrame, path: str, most: int = 500, limit: int = 8) -> DataFrame:
    """Of the strongest `most` pairs of a coupling table, those of one file: (path, co_changes, strength), strongest first."""
    order = [F.desc("strength"), F.desc("co_changes"), "a", "b"]
    own = pairs.orderBy(*order).limit(most).where((F.col("a") == path) | (F.col("b") == path)).orderBy(*order).limit(limit)
    return own.select(F.when(F.col("a") == path, F.col("b")).otherwise(F.col("a")).alias("path"), "co_changes", "strength")
