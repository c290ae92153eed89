"""Wiki pages about a repository: what to start from, what to show, diagrams, the snapshot."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from . import graph, mining

# Preference of entrypoints as a start, colours a diagram has, pages for clusters.
START_ORDER = ("factory", "route", "main", "cli", "worker", "module")
COLOURS = (
    ("#dbeafe", "#3b82f6"), ("#dcfce7", "#22c55e"), ("#fef9c3", "#eab308"), ("#fee2e2", "#ef4444"),
    ("#f3e8ff", "#a855f7"), ("#ffedd5", "#f97316"), ("#ccfbf1", "#14b8a6"), ("#e2e8f0", "#64748b"),
)
CLUSTERS = 5
LEAST_CLUSTER = 4
LEAST_FAN = 20  # tenths: a confidence of two


def start_symbol(name: str, package: str, symbols: DataFrame, fans: DataFrame, entrypoints: DataFrame) -> dict | None:
    """Where to begin reading: the class named like the repository, an entrypoint, or the busiest class."""
    inside = symbols.where(F.col("file_path").startswith(f"{package}/") | (F.col("file_path") == package))
    leaf = name.rstrip("/").rsplit("/", 1)[-1].lower()
    classes = inside.where("kind = 'class'").join(fans, ["repo_id", "id"], "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    row = classes.where(F.lower("name") == leaf).orderBy("id").first()
    if row is None:
        rank = F.array_position(F.array(*[F.lit(k) for k in START_ORDER]), F.col("kind"))
        own = entrypoints.where(F.col("path").startswith(f"{package}/") & F.col("symbol_id").isNotNull()).orderBy(rank, "path", "line").first()
        row = symbols.where(F.col("id") == own["symbol_id"]).first() if own else None
    if row is None:
        row = classes.orderBy(F.desc("fan_in"), "id").first()
    return row.asDict() if row else None


def core_models(package: str, symbols: DataFrame, fans: DataFrame, start: int | None, limit: int = 3) -> list[dict]:
    """The package's other classes that most depends on."""
    rows = symbols.where((F.col("kind") == "class") & F.col("file_path").startswith(f"{package}/")).join(fans, ["repo_id", "id"]).where(F.col("fan_in") >= LEAST_FAN)
    if start is not None:
        rows = rows.where(F.col("id") != start)
    return [r.asDict() for r in rows.select("id", "qualified_name", "file_path", "fan_in").orderBy(F.desc("fan_in"), "id").limit(limit).collect()]


def flow_root(start: dict, package: str, symbols: DataFrame, fans: DataFrame) -> int | None:
    """The callable that a walk through the code starts at."""
    busy = symbols.join(fans, ["repo_id", "id"]).where(F.col("kind").isin("function", "method") & (F.col("fan_out") >= LEAST_FAN))
    tries = [busy.where(F.col("id") == start["id"])] if start["kind"] != "class" else [busy.where(F.col("qualified_name").startswith(f"{start['name']}."))]
    for rows in [*tries, busy.where(F.col("file_path").startswith(f"{package}/"))]:
        row = rows.orderBy(F.desc("fan_out"), "id").first()
        if row:
            return row["id"]
    return None


def label(text: str) -> str:
    """Without what ends a diagram's label."""
    return re.sub(r"[`\n]", " ", text).replace('"', "'").replace("[", "(").replace("]", ")").strip()


def flowchart(nodes: list[dict], links: list[tuple[int, int]]) -> str:
    """Flowchart source: a box for each folder, links once, no loops, nodes without links left out."""
    pairs = sorted({(a, b) for a, b in links if a != b})
    used = {x for p in pairs for x in p}
    kept = [n for n in nodes if n["id"] in used]
    folders = sorted({n["file_path"].rpartition("/")[0] or P.ROOT for n in kept})
    lines = ["flowchart LR"]
    for i, folder in enumerate(folders):
        lines.append(f'  subgraph g{i}["{label(folder)}"]')
        lines += [f'    n{n["id"]}["{label(n["qualified_name"])}"]:::c{i % len(COLOURS)}' for n in kept if (n["file_path"].rpartition("/")[0] or P.ROOT) == folder]
        lines.append("  end")
    known = {n["id"] for n in kept}
    lines += [f"  n{a} --> n{b}" for a, b in pairs if a in known and b in known]
    lines += [f"  classDef c{i} fill:{fill},stroke:{stroke};" for i, (fill, stroke) in enumerate(COLOURS[: len(folders)])]
    return "\n".join(lines)


def sections(repo: str, package: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, entrypoints: DataFrame) -> list[dict]:
    """Pages as blocks: architecture, getting started, core engine, pipeline, and one for each large cluster."""
    fans = mining.fan_in_out(edges, symbols)
    out = []
    top = mining.top_folders(files).orderBy(F.desc("files"), "folder").collect()
    parts = mining.submodules(files, symbols).orderBy(F.desc("symbols"), "submodule").collect()
    layered = any(r["submodule"] in mining.LAYERS for r in parts)
    out.append({"key": "architecture", "title": "Architecture", "blocks": [{"type": "md", "text": f"{repo} is {'layered' if layered else 'modular'}."}, {"type": "list", "items": [f"{r['folder']}: {r['label']}" for r in top]}, {"type": "table", "head": ["part", "symbols", "files"], "rows": [[r["submodule"], r["symbols"], ", ".join(r["evidence"])] for r in parts]}]})
    readme = files.where(F.lower("path").contains("readme")).orderBy(F.length("path"), "path").first()
    entries = entrypoints.orderBy("kind_rank", "path", "line").limit(10).collect()
    out.append({"key": "getting-started", "title": "Getting started", "blocks": ([{"type": "md", "text": readme["path"]}] if readme else []) + [{"type": "list", "items": [f"{e['kind']}: {e['label']}" for e in entries]}]})
    start = start_symbol(repo, package, symbols, fans, entrypoints)
    if start:
        models = core_models(package, symbols, fans, start["id"])
        out.append({"key": "core", "title": start["qualified_name"], "blocks": [{"type": "code", "text": start["code"] or ""}, {"type": "chips", "items": [m["qualified_name"] for m in models]}]})
        root = flow_root(start, package, symbols, fans)
        if root is not None:
            nodes, links = graph.call_flow(edges, root)
            known = [r.asDict() for r in symbols.where(F.col("id").isin([n for n, _ in nodes])).select("id", "qualified_name", "file_path").collect()]
            out.append({"key": "pipeline", "title": "Pipeline", "blocks": [{"type": "diagram", "text": flowchart(known, [(a, b) for a, b, _ in links])}]})
    members = graph.communities(edges, symbols)
    for c in graph.describe_communities(members, edges, symbols).where((F.col("place") <= CLUSTERS) & (F.col("size") >= LEAST_CLUSTER)).orderBy("place").collect():
        own = members.where(F.col("community") == c["community"]).select("id")
        inside = edges.where("edge_type = 'call'").join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").limit(60).collect()
        if inside:
            ids = {x for e in inside for x in (e["src"], e["dst"])}
            known = [r.asDict() for r in symbols.where(F.col("id").isin(sorted(ids))).select("id", "qualified_name", "file_path").collect()]
            out.append({"key": f"cluster-{c['place']}", "title": c["label"], "blocks": [{"type": "diagram", "text": flowchart(known, [(e["src"], e["dst"]) for e in inside])}]})
    return out


def page_order(keys: list[str], chosen: list[str] | None = None) -> list[str]:
    """The chosen order where it names known pages, the rest behind it in the default order."""
    first = [k for k in dict.fromkeys(chosen or []) if k in keys]
    return first + [k for k in keys if k not in first]


def table_of_contents(pages: list[dict]) -> list[dict]:
    return [{"key": p["key"], "title": p["title"], "headings": [b["text"] for b in p["blocks"] if b["type"] == "h2"]} for p in pages]


def snapshot(repo: dict, files: DataFrame, symbols: DataFrame, edges: DataFrame, commits: DataFrame, commit_files: DataFrame, entrypoints: DataFrame) -> dict:
    """All signals of a repository in one bundle; every list is cut to what a page shows."""
    def rows(df: DataFrame, n: int) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.limit(n).collect()]

    members = graph.communities(edges, symbols)
    links = graph.file_graph(edges, symbols)
    return {
        "repo": repo,
        "counts": {"files": files.count(), "symbols": symbols.count(), "edges": edges.count(), "commits": commits.count()},
        "architecture": rows(mining.submodules(files, symbols).orderBy(F.desc("symbols"), "submodule"), 50),
        "entrypoints": rows(entrypoints.orderBy("kind_rank", "path", "line"), 100),
        "dead_code": rows(mining.dead_code(symbols, edges, entrypoints).orderBy(F.col("visibility").desc(), "path", "line"), 200),
        "coupling": rows(mining.coupling(commits, commit_files).orderBy(F.desc("strength"), F.desc("co_changes"), "a", "b"), 12),
        "communities": rows(graph.describe_communities(members, edges, symbols).orderBy("place"), 12),
        "folders": rows(mining.folder_heat(edges, symbols).orderBy(F.desc("fan_in"), F.desc("symbols"), "dir"), 12),
        "graph": {"nodes": rows(graph.file_graph_nodes(links).orderBy(F.desc("degree"), "path"), 150), "links": rows(links.orderBy(F.desc("weight"), "source", "target"), 600)},
    }
