"""A refreshed repository against ingesting its changed tree from nothing."""

import subprocess

import pytest

from lodestone.engine import Repository
from lodestone.operators import refresh
from lodestone.sources import python_code

TREE = {
    "src/__init__.py": "",
    "src/base.py": "class Root:\n    def run(self):\n        return shared()\n\n\nclass Middle(Root):\n    pass\n",
    "src/leaf.py": "from src.base import Middle\n\n\nclass Leaf(Middle):\n    def go(self):\n        self.run()\n        return Other.make()\n",
    "src/other.py": "class Other:\n    def make(self):\n        return lonely()\n\n\ndef shared():\n    return 1\n",
    "src/far.py": "def far():\n    return missing() + near()\n\n\ndef near():\n    return far()\n",
    "src/gone.py": "def lonely():\n    return near()\n",
    "README.md": "# Read\n",
}
#: One change of a tree after the other: contents by path, None for a removal.
CHANGES = [
    # the base of a base gets a method that a class three files away asks for by self, and one loses it
    {"src/base.py": "class Top:\n    def run(self):\n        return 2\n\n\nclass Root(Top):\n    pass\n\n\nclass Middle(Root):\n    pass\n"},
    # a second definition of a name, a name that was missing, a file less, lines that move
    {"src/new.py": "def shared():\n    return near()\n\n\ndef missing():\n    return 0\n", "src/gone.py": None, "src/other.py": "\n\n" + TREE["src/other.py"]},
    # a class that was a receiver is one no longer; nothing but text elsewhere
    {"src/other.py": "def make():\n    return 3\n", "README.md": "# Read me\n"},
    {},
]


def git(path, *args):
    subprocess.run(["git", "-C", str(path), "-c", "user.name=A", "-c", "user.email=a@b", *args], check=True, capture_output=True)


def put(root, files):
    for path, text in files.items():
        at = root / path
        if text is None:
            at.unlink()
        else:
            at.parent.mkdir(exist_ok=True)
            at.write_text(text)
    git(root, "add", "-A")
    git(root, "commit", "--allow-empty", "-m", "change")


def tables(repo):
    symbols = sorted(tuple(r) for r in repo.symbols.select("repo_id", "id", "file_path", "kind", "qualified_name", "start_line", "code").collect())
    edges = sorted(tuple(r) for r in repo.edges.select("repo_id", "src", "dst", "edge_type", "name", "tenths", "confidence").collect())
    references = sorted(map(str, (tuple(r) for r in repo.references.select("repo_id", "src", "kind", "receiver", "name").collect())))
    return symbols, edges, references


def test_refreshed_equals_ingested_and_parses_changed_files_alone(spark, tmp_path, monkeypatch):
    git(tmp_path, "init", "-b", "main")
    put(tmp_path, TREE)
    repo = Repository.ingest(spark, str(tmp_path), url="https://h/o/r")
    first = tables(repo)[1]
    parse, parsed = python_code.symbols, []

    def watched(files):
        parsed.append({r["path"] for r in files.select("path").collect()})
        return parse(files)

    seen = [first]
    for i, change in enumerate(CHANGES):
        put(tmp_path, change)
        monkeypatch.setattr(python_code, "symbols", watched)
        repo = repo.refreshed(str(tmp_path), repo_id=i + 2)
        monkeypatch.setattr(python_code, "symbols", parse)
        assert parsed.pop() == {path for path, text in change.items() if text is not None}
        want = Repository.ingest(spark, str(tmp_path), repo_id=i + 2)
        assert tables(repo) == tables(want)
        assert repo.info["head_sha"] == want.info["head_sha"] and repo.info["url"] == "https://h/o/r"
        assert {r["repo_id"] for r in repo.commits.collect()} == {i + 2} and repo.commits.count() == i + 2
        seen.append([e[1:] for e in tables(repo)[1]])
    assert seen[1] != seen[2] != seen[3] and seen[3] == seen[4]


@pytest.mark.parametrize("old, new, want", [([("a", "1")], [("a", "1")], set()), ([("a", None)], [("a", None)], set()), ([("a", None)], [("a", "1")], {("a", "changed")}), ([], [("a", "1")], {("a", "added")}), ([("a", "1")], [], {("a", "removed")})])
def test_delta(spark, old, new, want):
    old, new = (spark.createDataFrame([(1, *r) for r in rows], "repo_id int, path string, content_sha string") for rows in (old, new))
    assert {(r["path"], r["change"]) for r in refresh.delta(old, new).collect()} == want
