"""Codemaps: small ordered views of the call graph around a question or a file, and traces of them.

Everything here is at most a few dozen nodes; tables are filtered to them before anything is
collected.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .findings import parse_reply

# How many nodes each view may have.
MAX_NODES = 22
FILE_NODES = 30
CANDIDATES = 10
EXTENSION = 10
TRACE_STEPS = 14
MAX_FIELDS, MAX_FIELD_CHARS = 8, 300


def touching(edges: DataFrame, ids: list[int]) -> DataFrame:
    """Edges with an end among the ids."""
    return edges.where(F.col("src").isin(ids) | F.col("dst").isin(ids))


def neighbours(edges: DataFrame, ids: list[int], room: int) -> list[int]:
    """The outsiders with most edges to the ids, at most `room`."""
    out = touching(edges, ids).select(F.explode(F.array("src", "dst")).alias("id")).where(~F.col("id").isin(ids))
    rows = out.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(max(room, 0)).collect()
    return [r["id"] for r in rows]


def inner_edges(edges: DataFrame, ids: list[int]) -> list[tuple[int, int]]:
    """Distinct pairs among the ids, without loops."""
    rows = edges.where(F.col("src").isin(ids) & F.col("dst").isin(ids) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct().orderBy("src", "dst").collect()
    return [(r["src"], r["dst"]) for r in rows]


def steps_from(root: int, pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Breadth-first depth from the root, along the edges."""
    depth, frontier = {root: 0}, [root]
    while frontier:
        new = []
        for a, b in pairs:
            if a in frontier and b not in depth:
                depth[b] = depth[a] + 1
                new.append(b)
        frontier = new
    return depth


def _nodes(symbols: DataFrame, ids: list[int]) -> list[dict]:
    role = T.role(F.col("qualified_name"), F.col("file_path"), F.col("kind"))
    rows = symbols.where(F.col("id").isin(ids)).select("id", "qualified_name", "file_path", "kind", "start_line", role.alias("role"))
    return [r.asDict() for r in rows.collect()]


def codemap(edges: DataFrame, symbols: DataFrame, candidates: list[int], max_nodes: int = MAX_NODES) -> dict:
    """Nodes in steps and edges around ranked candidates. The first candidate is the root."""
    ids = list(dict.fromkeys(candidates))[:CANDIDATES]
    if not ids:
        return {"nodes": [], "edges": []}
    ids += neighbours(edges, ids, max_nodes - len(ids))
    pairs = inner_edges(edges, ids)
    depth = steps_from(ids[0], pairs)
    nodes = [{**n, "step": depth.get(n["id"], 0) + 1} for n in _nodes(symbols, ids)]
    return {"nodes": sorted(nodes, key=lambda n: (n["step"], n["qualified_name"])), "edges": pairs}


def file_codemap(edges: DataFrame, symbols: DataFrame, path: str, max_nodes: int = FILE_NODES) -> dict:
    """A file's symbols, all of them, and neighbours up to max_nodes, from its busiest symbol on."""
    own = [r["id"] for r in symbols.where((F.col("file_path") == path) & (F.col("kind") != "import")).select("id").orderBy("id").collect()]
    if not own:
        return {"nodes": [], "edges": []}
    ids = own + neighbours(edges, own, max_nodes - len(own))
    pairs = inner_edges(edges, ids)
    calling = [a for a, _ in pairs if a in set(own)]
    # without a symbol of its own that calls anything, all are in one group
    depth = steps_from(min(set(calling), key=lambda i: (-calling.count(i), i)), pairs) if calling else {}
    last = max(depth.values(), default=-1) + 1
    nodes = [{**n, "step": depth.get(n["id"], last) + 1, "own": n["id"] in own} for n in _nodes(symbols, ids)]
    return {"nodes": sorted(nodes, key=lambda n: (n["step"], n["start_line"], n["id"])), "edges": pairs}


def extend(edges: DataFrame, symbols: DataFrame, shown: list[int], candidates: list[int], limit: int = EXTENSION, question: str = "", call: Callable[[str], str] | None = None) -> dict:
    """Candidates that are not shown yet, neighbours of both up to the limit, their edges, a model's note."""
    new = [c for c in dict.fromkeys(candidates) if c not in set(shown)][:limit]
    if not new:
        return {"nodes": [], "edges": [], "note": ""}
    new += neighbours(edges, shown + new, limit - len(new))
    nodes = _nodes(symbols, new)
    note = call(f"{question}\n" + "\n".join(n["qualified_name"] for n in nodes)).strip() if call and nodes else ""
    return {"nodes": nodes, "edges": [p for p in inner_edges(edges, shown + new) if p[0] in new or p[1] in new], "note": note}


def expand(edges: DataFrame, symbols: DataFrame, node: int, step: int, limit: int = 6) -> list[dict]:
    """Up to `limit` callers a step before a node and as many callees a step after."""
    out = []
    for side, own, other, at in (("caller", "dst", "src", step - 1), ("callee", "src", "dst", step + 1)):
        rows = edges.where((F.col(own) == node) & (F.col(other) != node)).groupBy(other).agg(F.max("tenths").alias("t")).orderBy(F.desc("t"), other).limit(limit).collect()
        out += [{**n, "side": side, "step": at} for n in _nodes(symbols, [r[other] for r in rows])]
    return out


def explain_edge(symbols: DataFrame, src: int, dst: int, edge_type: str, call: Callable[[str], str] | None = None) -> str:
    """What an edge means; a plain sentence without a model."""
    named = {n["id"]: n for n in _nodes(symbols, [src, dst])}
    if src not in named or dst not in named:
        return "This edge's symbols are not known."
    a, b = named[src], named[dst]
    plain = f"{a['qualified_name']} ({a['file_path']}) {'inherits from' if edge_type == 'inherit' else 'calls'} {b['qualified_name']} ({b['file_path']})."
    return (call(plain) if call else None) or plain


def concept_cards(nodes: list[dict], call: Callable[[str], str] | None, icons: tuple[str, ...] = ("box", "gear", "link")) -> list[dict]:
    """One card a node from a model's reply; none unless there is exactly one for each."""
    if call is None or not nodes:
        return []
    cards = parse_reply(call(", ".join(n["qualified_name"] for n in nodes))).get("cards")
    if not isinstance(cards, list) or len(cards) != len(nodes) or not all(isinstance(c, dict) for c in cards):
        return []
    return [{"title": str(c.get("title") or n["qualified_name"]), "icon": c.get("icon") if c.get("icon") in icons else icons[0]} for c, n in zip(cards, nodes, strict=True)]


def signature_parts(signature: str | None) -> tuple[list[str], str | None]:
    """Parameter names (without self, cls and what is no name) and the return type of a signature."""
    text = signature or ""
    a, b = text.find("("), text.rfind(")")
    raw = text[a + 1 : b].split(",") if 0 <= a < b else []
    names = [re.split(r"[:=]", p)[0].strip().lstrip("*") for p in raw]
    result = text.rsplit("->", 1)[1].strip().rstrip(":") if "->" in text else None
    return [n for n in names if n.isidentifier() and n not in ("self", "cls")], result or None


def mechanical_trace(symbols: DataFrame, ids: list[int]) -> dict:
    """A step for each of the first TRACE_STEPS symbols, in the order given."""
    asked = list(dict.fromkeys(ids))
    taken = asked[:TRACE_STEPS]
    rows = {r["id"]: r for r in symbols.where(F.col("id").isin(taken)).select("id", "qualified_name", "signature", "file_path").collect()}
    steps = []
    for i in (x for x in taken if x in rows):
        names, result = signature_parts(rows[i]["signature"])
        steps.append({"id": i, "name": rows[i]["qualified_name"], "inputs": {n: f"<{n}>" for n in names[:MAX_FIELDS]}, "output": result or "None", "path": rows[i]["file_path"]})
    return {"scenario": "", "steps": steps, "truncated": len(asked) > len(steps), "mechanical": True}


def clamp_fields(fields: dict) -> dict:
    """At most MAX_FIELDS entries, values as text of at most MAX_FIELD_CHARS characters."""
    return {str(k): str(v)[:MAX_FIELD_CHARS] for k, v in list(fields.items())[:MAX_FIELDS]}


class TraceCache:
    """Traces by (sha, ids, question); the oldest of 64 go."""

    def __init__(self, size: int = 64):
        self.size, self.kept = size, {}

    def get(self, key: tuple, make: Callable[[], dict]) -> dict:
        if key not in self.kept:
            if len(self.kept) >= self.size:
                self.kept.pop(next(iter(self.kept)))
            self.kept[key] = make()
        return self.kept[key]


def simulate(symbols: DataFrame, ids: list[int], question: str, call: Callable[[str], str] | None = None) -> dict:
    """A model's trace of the symbols, salvaged if it was cut off; the mechanical one without."""
    plain = mechanical_trace(symbols, ids)
    if call is None:
        return plain
    reply = call(f"{question}\n" + "\n".join(s["name"] for s in plain["steps"]))
    found = parse_reply(reply) or T.salvage_json(reply) or {}
    steps = found.get("steps")
    if not isinstance(steps, list) or not steps:
        return plain
    known = {s["name"]: s for s in plain["steps"]}
    out = [{**known.get(s.get("name"), {}), "name": s.get("name"), "inputs": clamp_fields(s.get("inputs") or {}) if isinstance(s.get("inputs"), dict) else {}, "output": str(s.get("output"))[:MAX_FIELD_CHARS]} for s in steps[:TRACE_STEPS] if isinstance(s, dict)]
    return {"scenario": str(found.get("scenario") or ""), "steps": out, "truncated": plain["truncated"], "mechanical": False}
