"""Findings about files: which files to scan, checking what a scan says, their life afterwards."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .ordering import numbered

# What a finding may be, and how long its texts.
CATEGORIES = ("logic", "security", "style")
SEVERITIES = ("high", "medium", "low")
MAX_FILES = 50
MAX_FILE_CHARS = 8000
MAX_TITLE, MAX_DESCRIPTION, MAX_FIX = 300, 4000, 2000
SNIPPET_LINES = 46
FOUND = "repo_id long, file_path string, category string, severity string, title string, description string, suggested_fix string, start_line long, end_line long"


def select_files(files: DataFrame, churn: DataFrame, limit: int | None = MAX_FILES) -> DataFrame:
    """Code files that are no tests, by churn, lines and path; the first `limit` (None: all)."""
    code = files.where((F.col("category") == "code") & ~P.is_test_file(F.col("path")))
    rows = code.join(churn, ["repo_id", "path"], "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    order = (F.desc("churn"), F.desc("loc"), "path")
    if limit is None:
        return numbered(rows, ("repo_id",), *order)
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def coerce_finding(raw: object, n_lines: int) -> dict | None:
    """A finding as the tables hold it, or None if it cannot be one."""
    if not isinstance(raw, dict):
        return None

    def text(key: str) -> str:
        return str(raw.get(key) or "").strip()

    start, end = raw.get("start_line"), raw.get("end_line")
    category, title, description = text("category").lower(), text("title"), text("description")
    sound = type(start) is int and start >= 1
    if category not in CATEGORIES or not title or not description or not sound:
        return None
    severity = text("severity").lower()
    last = max(1, n_lines)
    start = min(start, last)
    end = min(end, last) if type(end) is int and end >= start else start
    return {
        "category": category,
        "severity": severity if severity in SEVERITIES else "medium",
        "title": title[:MAX_TITLE],
        "description": description[:MAX_DESCRIPTION],
        "suggested_fix": text("suggested_fix")[:MAX_FIX] or None,
        "start_line": start,
        "end_line": end,
    }


def parse_reply(reply: str) -> dict:
    """The JSON object in a model's reply, fenced or surrounded by prose; {} without one."""
    body = reply.strip()
    if body.count("```") >= 2:
        body = body.split("```")[1].removeprefix("json")
    first, last = body.find("{"), body.rfind("}")
    try:
        found = json.loads(body[first : last + 1]) if 0 <= first < last else {}
    except ValueError:
        found = {}
    return found if isinstance(found, dict) else {}


def found_in(reply: str, n_lines: int) -> list[dict]:
    """The findings in a model's reply about a file of so many lines."""
    found = parse_reply(reply).get("findings")
    return [c for c in (coerce_finding(f, n_lines) for f in (found if isinstance(found, list) else [])) if c]


def prompts(chosen: DataFrame) -> DataFrame:
    """What a model is asked about each file: (repo_id, path, prompt, n_lines, cut)."""
    content = F.coalesce("content", F.lit(""))
    prompt = F.concat(F.col("path"), F.lit("\n"), F.left(content, F.lit(MAX_FILE_CHARS)))
    return chosen.select("repo_id", "path", prompt.alias("prompt"), F.size(F.split(content, "\n")).alias("n_lines"), (F.length(content) > MAX_FILE_CHARS).alias("cut"))


def found(answered: DataFrame) -> DataFrame:
    """The findings in answers(repo_id, path, answer, n_lines), one a row; a null answer has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in FOUND.split(", ")]
        for part in parts:
            rows = [{"repo_id": r.repo_id, "file_path": r.path, **f} for r in part.itertuples() for f in found_in(r.answer, r.n_lines)]
            yield pd.DataFrame(rows, columns=names)

    return answered.where("answer is not null").select("repo_id", "path", "answer", "n_lines").mapInPandas(run, FOUND)


def coerce_columns(raw: DataFrame) -> DataFrame:
    """coerce_finding for a table of strings(id, category, severity, title, start_line, end_line, n_lines)."""
    category, severity = F.lower(F.trim("category")), F.lower(F.trim("severity"))
    start = F.expr("try_cast(start_line as long)")
    out = raw.where(category.isin(*CATEGORIES) & (F.length(F.trim("title")) > 0) & (start >= 1))
    begin = F.least(start, F.greatest("n_lines", F.lit(1)))
    end = F.expr("try_cast(end_line as long)")
    stop = F.when(end >= begin, F.least(end, F.greatest("n_lines", F.lit(1)))).otherwise(begin)
    return out.select("id", category.alias("category"), F.when(severity.isin(*SEVERITIES), severity).otherwise("medium").alias("severity"), F.left(F.trim("title"), F.lit(MAX_TITLE)).alias("title"), begin.alias("start_line"), stop.alias("end_line"))


def cap_notes(selected: int, total: int, truncated: int, model: bool) -> list[str]:
    """What a scan did not look at, in words."""
    notes = []
    if selected < total:
        notes.append(f"{selected} of {total} code files were scanned, those with most changes first.")
    if truncated:
        notes.append(f"{truncated} files were longer than {MAX_FILE_CHARS} characters and cut there.")
    if not model:
        notes.append("No language model is configured, so nothing was found.")
    return notes


def replace_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a new scan leaves: ticketed findings stay, all others are replaced."""
    return old.where("status = 'ticketed'").unionByName(new)


def set_status(findings: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Findings with these ids get the status; ticketed ones keep theirs."""
    marked = findings.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return marked.withColumn("status", F.when(F.col("__hit") & (F.col("status") != "ticketed"), status).otherwise(F.col("status"))).select(*findings.columns)


def listed(findings: DataFrame) -> DataFrame:
    """Findings with their place: by status, severity (both as text), path, line, id."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return numbered(findings, ("repo_id",), "status", "severity", "file_path", "start_line", "id").withColumn("severity_rank", rank)


def facets(findings: DataFrame, category: str | None = None, severity: str | None = None) -> DataFrame:
    """Findings of a category and a severity, where they are given, with whether they are open (new)."""
    out = findings if category is None else findings.where(F.col("category") == category)
    out = out if severity is None else out.where(F.col("severity") == severity)
    return out.withColumn("open", F.col("status") == "new")


def with_files(findings: DataFrame, files: DataFrame, most: int = SNIPPET_LINES) -> DataFrame:
    """Findings with their file's language and their lines of it, at most `most` and a marker."""
    known = files.select("repo_id", F.col("path").alias("file_path"), F.split("content", "\n").alias("lines"))
    rows = findings.join(known, ["repo_id", "file_path"], "left").withColumn("lang", P.language(F.col("file_path")))
    first = F.greatest(F.col("start_line"), F.lit(1)).cast("int")
    n = F.greatest(F.least(F.greatest(F.col("end_line").cast("int"), first), F.size("lines")) - first + 1, F.lit(0))
    text = F.array_join(F.slice("lines", first, F.least(n, F.lit(most))), "\n")
    cut = F.when(n > most, F.concat(text, F.lit("\n…"))).otherwise(text)
    return rows.withColumn("snippet", F.coalesce(cut, F.lit(""))).drop("lines")


def refusal(findings: DataFrame, finding_id: int) -> int | None:
    """Why a finding can't be dismissed: 404 if there is none, 409 if it is ticketed; None if it can."""
    row = findings.where(F.col("id") == finding_id).select("status").first()
    return 404 if row is None else 409 if row["status"] == "ticketed" else None


def ticketed(findings: DataFrame, tickets: DataFrame) -> DataFrame:
    """Findings that tickets(id, jira_url) were made for are ticketed and know where; others stay."""
    made = F.col("__url").isNotNull()
    rows = findings.join(tickets.select("id", F.col("jira_url").alias("__url")), "id", "left")
    old = F.col("jira_url") if "jira_url" in findings.columns else F.lit(None).cast("string")
    return rows.withColumn("status", F.when(made, "ticketed").otherwise(F.col("status"))).withColumn("jira_url", F.coalesce("__url", old)).drop("__url")


def snippet(content: str | None, start: int, end: int, most: int = SNIPPET_LINES) -> str:
    """Lines start..end, at most `most` of them and a marker."""
    lines = (content or "").split("\n")
    first = max(1, start)
    if first > len(lines):
        return ""
    picked = lines[first - 1 : max(first, end)]
    return "\n".join(picked[:most] + (["…"] if len(picked) > most else []))
