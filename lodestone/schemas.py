"""Entity tables as Spark types. Every table but repos starts with the repository it belongs to."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _table(columns: str) -> T.StructType:
    """Columns as `name type`; parsed here, since Spark's parser needs a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split(" ") for c in columns.split(", "))])


REPOS = _table("id int, url string, name string, default_branch string, head_sha string, ingested_at timestamp")
FILES = _table("repo_id int, id int, path string, language string, category string, size_bytes int, loc int, content_sha string, content string")
COMMITS = _table("repo_id int, id int, sha string, author_name string, author_email string, authored_at timestamp, committer_name string, committed_at timestamp, message string, insertions int, deletions int, files_changed int, parents array<string>")
COMMIT_FILES = _table("repo_id int, id int, commit_sha string, path string, change_type string, insertions int, deletions int")
ISSUES = _table("repo_id int, id int, number int, is_pull_request boolean, title string, body string, state string, author string, labels array<string>, comments_count int, created_at timestamp, updated_at timestamp, closed_at timestamp, url string")
SYMBOLS = _table("repo_id int, id int, file_path string, language string, kind string, name string, qualified_name string, start_line int, end_line int, signature string, docstring string, code string")
SYMBOL_EDGES = _table("repo_id int, id int, src_symbol_id int, dst_symbol_id int, dst_name string, edge_type string, confidence double")
FINDINGS = _table("repo_id int, id int, file_path string, start_line int, end_line int, symbol_id int, category string, severity string, title string, description string, suggested_fix string, status string, ticket_url string, head_sha string, created_at timestamp")
EVIDENCE = _table("repo_id int, stream string, ref_id string, citation string, title string, text string, date timestamp")
