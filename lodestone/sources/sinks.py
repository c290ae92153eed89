"""Where results go: tables by repository, caches, pages, tickets, event streams."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import xml_escape
from .snapshots import SnapshotTable

SUMMARY_CHARS = 255


def replace_rows(df: DataFrame, path: str) -> None:
    """Replace the rows of the repositories in df; the others' files stay as they are."""
    SnapshotTable(df.sparkSession, path).replace(df, [])


def delete_repository(spark: SparkSession, path: str, repo_id: int) -> None:
    """Remove one repository's rows from a table that replace_rows wrote; the others are not touched."""
    SnapshotTable(spark, path).update(lambda rows: rows.limit(0), [repo_id], "delete")


def replace_symbols(symbols: DataFrame, repo_id: int, symbols_path: str, edges_path: str) -> None:
    """Replace a repository's symbols; its edges, which name the old ones, go first."""
    delete_repository(symbols.sparkSession, edges_path, repo_id)
    SnapshotTable(symbols.sparkSession, symbols_path).replace(symbols, [repo_id])


def append_rows(df: DataFrame, path: str) -> None:
    SnapshotTable(df.sparkSession, path).append(df)


def delete_rows(spark: SparkSession, path: str, condition: str) -> None:
    """Remove the rows that satisfy the condition; readers see the table before it or after it."""
    SnapshotTable(spark, path).delete(condition)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that these functions wrote."""
    return SnapshotTable(spark, path).read()


def cached(cache: DataFrame | None, repo_id: int, sha: str) -> str | None:
    """A page kept for this state of the repository."""
    row = cache.where((F.col("repo_id") == repo_id) & (F.col("head_sha") == sha)).select("body").first() if cache is not None else None
    return row["body"] if row else None


def cached_pages(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pages kept for wanted(repo_id, head_sha); of several the one stored last (kept_at)."""
    return cache.join(wanted.distinct(), ["repo_id", "head_sha"]).groupBy("repo_id", "head_sha").agg(F.max_by("body", "kept_at").alias("body"))


def graph_html(title: str, nodes: DataFrame, links: DataFrame) -> str:
    """A page of its own that holds a (bounded) graph as JSON and lists it."""
    data = {"nodes": [json.loads(x) for x in nodes.toJSON().collect()], "links": [json.loads(x) for x in links.toJSON().collect()]}
    body = json.dumps(data).replace("<", "\\u003c")
    name = title.replace("&", "&amp;").replace("<", "&lt;")
    return f'<!DOCTYPE html><meta charset="utf-8"><title>{name}</title><h1>{name}</h1><p>{len(data["nodes"])} nodes, {len(data["links"])} links</p><script type="application/json" id="graph">{body}</script>'


def _text(s: object) -> str:
    return str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def page_xhtml(blocks: Iterable[dict]) -> str:
    """Wiki blocks (h2, md, list, table, chips, code, diagram) as XHTML."""
    out = []
    for b in blocks:
        kind = b["type"]
        if kind == "h2":
            out.append(f"<h2>{_text(b['text'])}</h2>")
        elif kind == "md":
            out += [f"<p>{_text(p)}</p>" for p in str(b["text"]).split("\n\n") if p.strip()]
        elif kind in ("list", "chips"):
            out.append("<ul>" + "".join(f"<li>{_text(i)}</li>" for i in b["items"]) + "</ul>")
        elif kind == "table":
            head = "".join(f"<th>{_text(c)}</th>" for c in b["head"])
            rows = "".join("<tr>" + "".join(f"<td>{_text(c)}</td>" for c in r) + "</tr>" for r in b["rows"])
            out.append(f"<table><tbody><tr>{head}</tr>{rows}</tbody></table>")
        elif kind in ("code", "diagram"):
            safe = str(b["text"]).replace("]]>", "]]]]><![CDATA[>")
            out.append(f"<pre><![CDATA[{safe}]]></pre>")
    return "".join(out)


def ticket_payloads(findings: DataFrame, project: str) -> DataFrame:
    """(id, payload): each finding as the JSON body of a ticket, its summary cut to what trackers take."""
    place = F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"))
    summary = F.left(F.concat(F.lit("["), "severity", F.lit("] "), "title"), F.lit(SUMMARY_CHARS))
    fields = F.struct(F.struct(F.lit(project).alias("key")).alias("project"), summary.alias("summary"), F.concat_ws("\n\n", "title", place).alias("description"), F.array(F.col("category")).alias("labels"))
    return findings.select("id", F.to_json(F.struct(fields.alias("fields"))).alias("payload"))


def telemetry(events: DataFrame) -> DataFrame:
    """Calls, total and mean duration by name."""
    return events.groupBy("name").agg(F.count("*").alias("calls"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"))


def event_lines(items: DataFrame) -> DataFrame:
    """(line): rows as server-sent events."""
    return items.select(F.concat(F.lit("data: "), F.to_json(F.struct(*items.columns)), F.lit("\n\n")).alias("line"))


def server_events(items: Iterable[dict]) -> Iterator[str]:
    """Items as server-sent events, one at a time."""
    for item in items:
        yield f"data: {json.dumps(item)}\n\n"


__all__ = ["append_rows", "cached", "cached_pages", "delete_repository", "delete_rows", "event_lines", "graph_html", "page_xhtml", "read_rows", "replace_rows", "replace_symbols", "server_events", "telemetry", "ticket_payloads", "xml_escape"]
