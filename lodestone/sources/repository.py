"""Repositories as tables: files of a working tree, history from git, issues from JSON pages."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..lineage import cut
from ..schemas import FILES
from .masking import mask_token, with_token
from .readers import HistorySource, git, issue_source

# Directories that are never walked, and the size beyond which content is not kept.
SKIP_FOLDERS = (
    ".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".ruff_cache",
    ".pytest_cache", "node_modules", ".venv", "venv", "dist", "build",
    ".tox", ".idea", ".vscode", "site-packages", ".eggs",
)
MAX_CONTENT_BYTES = 1_000_000


def clone_or_open(url: str, folder: str, token: str | None = None) -> str:
    """The local path of a repository, cloned if it is not there. The token is not kept in its settings."""
    name = re.sub(r"\.git$", "", url.rstrip("/")).rsplit("/", 1)[-1]
    path = os.path.join(folder, name)
    if os.path.isdir(os.path.join(path, ".git")):
        return path
    done = subprocess.run(["git", "clone", with_token(url, token), path], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(mask_token(done.stderr.strip(), token))
    if token:
        git(path, "remote", "set-url", "origin", url)
    return path


def head_info(path: str) -> tuple[str | None, str]:
    """(branch, sha) of HEAD; the branch is None when it is detached."""
    branch = git(path, "rev-parse", "--abbrev-ref", "HEAD").strip()
    return (None if branch == "HEAD" else branch), git(path, "rev-parse", "HEAD").strip()


def decode(raw: bytes) -> str | None:
    """UTF-8 text with plain line ends, or None."""
    try:
        return raw.decode().replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return None


def list_files(root: str) -> list[str]:
    """Relative paths of the tree's files, without the skipped folders."""
    out = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n not in SKIP_FOLDERS)
        out += [os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/") for f in files if not os.path.islink(os.path.join(folder, f))]
    return sorted(out)


def is_walked(path: Column) -> Column:
    """Whether no folder of a path is one of those that are never walked."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SKIP_FOLDERS]))


def file_facts(raw: DataFrame) -> DataFrame:
    """What is known of each file's bytes: size_bytes, content_sha, content, loc, beside raw's other columns.

    Content that is no UTF-8, or longer than MAX_CONTENT_BYTES, is null, and its loc 0.
    """
    text = F.when((F.octet_length("raw") <= MAX_CONTENT_BYTES) & F.is_valid_utf8(F.col("raw")), F.col("raw").cast("string"))
    out = raw.withColumn("size_bytes", F.octet_length("raw")).withColumn("content_sha", F.sha1("raw")).withColumn("content", T.plain_newlines(text))
    return out.withColumn("loc", T.line_count(F.col("content"))).drop("raw")


def read_files(spark: SparkSession, root: str, repo_id: int = 1) -> DataFrame:
    """The files table of a working tree that all executors can reach.

    Spark's own listing hides names that begin with a dot or underscore, so paths are listed here.
    """
    paths = list_files(root)
    rows = spark.createDataFrame([(i + 1, p) for i, p in enumerate(paths)], "id int, path string")
    rows = rows.repartition(max(1, min(spark.sparkContext.defaultParallelism, len(paths) // 64 + 1)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, path in zip(part["id"], part["path"], strict=True):
                with open(os.path.join(root, path), "rb") as f:
                    raw = f.read()
                text = decode(raw) if 0 < len(raw) <= MAX_CONTENT_BYTES else None
                out.append((i, path, len(raw), text.count("\n") + 1 if text else 0, hashlib.sha1(raw).hexdigest() if raw else None, text))
            yield pd.DataFrame(out, columns=["id", "path", "size_bytes", "loc", "content_sha", "content"])

    read = rows.mapInPandas(run, "id int, path string, size_bytes int, loc int, content_sha string, content string")
    p = F.col("path")
    full = read.withColumns({"repo_id": F.lit(repo_id), "language": P.language(p), "category": P.category(p)})
    return full.select(*FILES.fieldNames())


def read_history(spark: SparkSession, root: str, repo_id: int = 1, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of the first-parent differences, newest first, at most `limit` commits.

    Tasks list and read a range of commits each, from a repository that all executors can reach, as read_files does.
    """
    spark.dataSource.register(HistorySource)
    asked = spark.read.format(HistorySource.name()).option("path", root).option("repo_id", repo_id)
    whole = cut((asked if limit is None else asked.option("limit", limit)).load())
    return history_tables(whole)


def history_tables(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of rows of the history's data source, batch or stream."""
    commits = whole.drop("changes").withColumns({x: F.to_timestamp(x) for x in ("authored_at", "committed_at")}).withColumn("n_parents", F.size("parents"))
    each = whole.select("repo_id", F.col("id").alias("commit"), "sha", F.posexplode("changes").alias("i", "c"))
    # a commit's changes are numbered behind each other
    number = (F.col("commit").cast("long") * (1 << 24) + F.col("i")).alias("id")
    return commits, each.select("repo_id", number, "sha", "c.path", "c.change_type", "c.insertions", "c.deletions")


def parse_numstat(log: DataFrame) -> DataFrame:
    """(sha, path, insertions, deletions) of log(sha, numstat); binary files' dashes count as 0."""
    lines = log.select("sha", F.explode(F.split("numstat", "\n")).alias("line")).where("line <> ''")
    part = F.split("line", "\t", 3)
    return lines.select("sha", part[2].alias("path"), F.coalesce(part[0].try_cast("int"), F.lit(0)).alias("insertions"), F.coalesce(part[1].try_cast("int"), F.lit(0)).alias("deletions"))


def read_issues(spark: SparkSession, get: Callable[[int], list[str]], limit: int = 500, page_size: int = 100) -> DataFrame:
    """raw(json) of issues from a paged source, the newest first; get(page) returns one page's items, in a task."""
    source = issue_source(get, f"issue_pages_{uuid.uuid4().hex}")
    spark.dataSource.register(source)
    return cut(spark.read.format(source.name()).option("limit", limit).option("page_size", page_size).load().select("json"))


_ISSUE = "number int, title string, body string, state string, user struct<login: string>, labels array<struct<name: string>>, comments int, created_at string, updated_at string, closed_at string, html_url string, pull_request struct<url: string>"


def parse_issues(raw: DataFrame, repo_id: int = 1) -> DataFrame:
    """The issues table from raw(json): one JSON object a row."""
    i = raw.select(F.from_json("json", _ISSUE).alias("i"), F.get_json_object("json", "$.pull_request").isNotNull().alias("pr"))
    return i.select(
        F.lit(repo_id).alias("repo_id"),
        F.col("i.number").alias("number"),
        F.col("pr").alias("is_pull_request"),
        F.coalesce("i.title", F.lit("")).alias("title"),
        F.col("i.body").alias("body"),
        F.col("i.state").alias("state"),
        F.col("i.user.login").alias("author"),
        F.transform("i.labels", lambda x: x["name"]).alias("labels"),
        F.coalesce("i.comments", F.lit(0)).alias("comments_count"),
        *[F.to_timestamp(f"i.{c}").alias(c) for c in ("created_at", "updated_at", "closed_at")],
        F.col("i.html_url").alias("url"),
    )
