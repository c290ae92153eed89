"""Symbols and references of Python sources, with the standard library's parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_SYMBOLS = "repo_id int, file_path string, language string, kind string, name string, qualified_name string, start_line int, end_line int, signature string, docstring string, code string"
_REFERENCES = "repo_id int, src long, kind string, receiver string, name string"


def _docstring(node: ast.AST) -> str | None:
    first = node.body[0] if getattr(node, "body", None) else None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        return first.value.value.strip()
    return None


def extract_symbols(source: str) -> list[dict]:
    """Functions, methods, classes and imports; a source that does not parse has none.

    Spans begin at decorators. Bodies of functions are not searched; classes and blocks are.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines, out = source.split("\n"), []

    def text(a: int, b: int) -> str:
        return "\n".join(lines[a - 1 : b])

    def visit(nodes: list[ast.stmt], owner: str) -> None:
        for node in nodes:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                a = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                is_class = isinstance(node, ast.ClassDef)
                name = f"{owner}.{node.name}" if owner else node.name
                head = text(node.lineno, max(node.lineno, node.body[0].lineno - 1)).strip()
                doc = node.body[0].lineno == node.lineno
                signature = (head.split(":\n")[0] if not doc else head).rstrip().rstrip(":").strip()
                out.append({"kind": "class" if is_class else "method" if owner else "function", "name": node.name, "qualified_name": name, "start_line": a, "end_line": node.end_lineno, "signature": signature, "docstring": _docstring(node), "code": text(a, node.end_lineno)})
                if is_class:
                    visit(node.body, name)
            elif isinstance(node, ast.Import | ast.ImportFrom):
                out.append({"kind": "import", "name": text(node.lineno, node.lineno).strip()[:200], "qualified_name": "", "start_line": node.lineno, "end_line": node.end_lineno, "signature": None, "docstring": None, "code": text(node.lineno, node.end_lineno)})
            else:
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(node, part, []) or [], owner)
                for handler in getattr(node, "handlers", []):
                    visit(handler.body, owner)

    visit(tree.body, "")
    return out


def extract_references(code: str) -> list[tuple[str, str | None, str]]:
    """(kind, receiver, name) of calls and bases: plain, self, receiver or base, each once."""
    import textwrap

    try:
        tree = ast.parse(textwrap.dedent(code))
    except (SyntaxError, ValueError):
        return []
    found: dict[tuple[str, str | None, str], None] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                ref = ("plain", None, f.id)
            elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                ref = ("self", None, f.attr) if f.value.id == "self" else ("receiver", f.value.id, f.attr)
            elif isinstance(f, ast.Attribute):
                ref = ("plain", None, f.attr)
            else:
                continue
            if not ref[2].startswith("__"):
                found[ref] = None
    top = tree.body[0] if tree.body else None
    if isinstance(top, ast.ClassDef):
        for base in top.bases:
            name = base.id if isinstance(base, ast.Name) else base.attr if isinstance(base, ast.Attribute) else None
            if name:
                found["base", None, name] = None
    return list(found)


def symbols(files: DataFrame) -> DataFrame:
    """The symbols (without ids) of files(repo_id, path, language, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for repo, path, content in zip(part["repo_id"], part["path"], part["content"], strict=True):
                rows += [{"repo_id": repo, "file_path": path, "language": "python", **s} for s in extract_symbols(content)]
            if rows:
                yield pd.DataFrame(rows)[[c.split()[0] for c in _SYMBOLS.split(", ")]]

    python = files.where("language = 'python' and content is not null").select("repo_id", "path", "content")
    return python.mapInPandas(run, _SYMBOLS)


def references(symbols_table: DataFrame) -> DataFrame:
    """The references of symbols(repo_id, id, kind, code); imports have none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(repo, i, *ref) for repo, i, code in zip(part["repo_id"], part["id"], part["code"], strict=True) for ref in extract_references(code)]
            if rows:
                yield pd.DataFrame(rows, columns=["repo_id", "src", "kind", "receiver", "name"])

    own = symbols_table.where("kind <> 'import' and code is not null").select("repo_id", "id", "code")
    return own.mapInPandas(run, _REFERENCES)
