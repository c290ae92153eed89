import json
import subprocess

import pytest

from lodestone.engine import Repository
from lodestone.sources import python_code, repository, sinks

CODE = '''"""Module."""
import os


class Base:
    def m(self):
        return helper()


class Sub(Base):
    @property
    def go(self):
        """Goes."""
        return self.m()


def helper():
    return os.getcwd()
'''


def git(path, *args):
    subprocess.run(["git", "-C", str(path), "-c", "user.name=A", "-c", "user.email=a@b", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def work(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git(root, "init", "-b", "main")
    (root / "src").mkdir()
    (root / "src/__init__.py").write_text("")
    (root / "src/app.py").write_text(CODE)
    (root / "README.md").write_text("Hello.\r\n\r\nAbout the helper.\r\n")
    (root / "node_modules").mkdir()
    (root / "node_modules/x.js").write_text("x")
    (root / "bin.dat").write_bytes(b"\xff\xfe")
    git(root, "add", ".")
    git(root, "commit", "-m", "First commit of all")
    (root / "src/app.py").write_text(CODE + "\n\nif __name__ == '__main__':\n    helper()\n")
    git(root, "commit", "-am", "Run as a script\n\nBody.")
    return root


def test_symbols_and_references():
    found = {s["qualified_name"] or s["name"]: s for s in python_code.extract_symbols(CODE)}
    assert set(found) == {"import os", "Base", "Base.m", "Sub", "Sub.go", "helper"}
    assert found["Sub.go"]["kind"] == "method" and found["Sub.go"]["docstring"] == "Goes." and found["Sub.go"]["start_line"] == 11
    assert found["Sub.go"]["signature"] == "def go(self)"
    assert python_code.extract_symbols("def (") == []
    assert python_code.extract_references(found["Sub"]["code"]) == [("self", None, "m"), ("base", None, "Base")]
    assert ("receiver", "os", "getcwd") in python_code.extract_references(found["helper"]["code"])


def test_files_and_history(spark, work):
    files = {r["path"]: r for r in repository.read_files(spark, str(work)).collect()}
    assert set(files) == {"src/__init__.py", "src/app.py", "README.md", "bin.dat"}
    assert files["README.md"]["content"] == "Hello.\n\nAbout the helper.\n"
    assert files["bin.dat"]["content"] is None and files["src/__init__.py"]["content_sha"] is None
    assert files["src/app.py"]["language"] == "python" and files["src/app.py"]["category"] == "code"
    commits, changes = repository.read_history(spark, str(work))
    rows = commits.orderBy("id").collect()
    assert [r["message"].split("\n")[0] for r in rows] == ["Run as a script", "First commit of all"]
    assert rows[0]["files_changed"] == 1 and rows[0]["insertions"] == 4
    assert {(r["path"], r["change_type"]) for r in changes.where(f"sha = '{rows[0]['sha']}'").collect()} == {("src/app.py", "M")}
    assert repository.read_history(spark, str(work), limit=1)[0].count() == 1
    assert repository.head_info(str(work))[0] == "main"


def test_tokens():
    assert repository.with_token("https://h/o/r", "t") == "https://x-access-token:t@h/o/r"
    assert repository.with_token("git@h:o/r", "t") == "git@h:o/r"
    assert "t0k" not in repository.mask_token("clone https://x:t0k@h failed t0k", "t0k")


def test_issues(spark):
    pages = [[json.dumps({"number": i, "title": "T", "state": "open", "user": {"login": "u"}, "labels": [{"name": "l"}], "created_at": "2024-01-02T03:04:05Z", **({"pull_request": {"url": "x"}} if i % 2 else {})}) for i in range(p * 100, p * 100 + n)] for p, n in ((0, 100), (1, 30))]
    raw = repository.read_issues(spark, lambda p: pages[p - 1], limit=120)
    assert raw.count() == 120
    rows = repository.parse_issues(raw).orderBy("number").limit(2).collect()
    assert [r["is_pull_request"] for r in rows] == [False, True]
    assert rows[0]["labels"] == ["l"] and rows[0]["author"] == "u" and rows[0]["created_at"].year == 2024


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_rows(spark.createDataFrame([(1, "a"), (2, "b")], "repo_id int, x string"), path)
    sinks.replace_rows(spark.createDataFrame([(1, "c")], "repo_id int, x string"), path)
    assert sorted(r["x"] for r in sinks.read_rows(spark, path).collect()) == ["b", "c"]
    sinks.delete_rows(spark, path, "x = 'b'")
    assert [r["x"] for r in sinks.read_rows(spark, path).collect()] == ["c"]
    page = sinks.page_xhtml([{"type": "h2", "text": "a<b"}, {"type": "code", "text": "x]]>y"}, {"type": "table", "head": ["h"], "rows": [[1]]}, {"type": "list", "items": ["i"]}])
    assert "a&lt;b" in page and "]]]]><![CDATA[>" in page
    ticket = sinks.ticket_payloads(spark.createDataFrame([(1, "f.py", 3, "high", "T" * 400, "logic")], "id int, file_path string, start_line int, severity string, title string, category string"), "P").first()
    assert len(json.loads(ticket["payload"])["fields"]["summary"]) == 255
    assert list(sinks.server_events([{"a": 1}])) == ['data: {"a": 1}\n\n']
    assert sinks.telemetry(spark.createDataFrame([("x", 1.0), ("x", 3.0)], "name string, seconds double")).first()["mean"] == 2.0


def test_engine(spark, work):
    repo = Repository.ingest(spark, str(work), url="https://h/o/r")
    assert repo.status()["counts"]["commits"] == 2
    names = {r["qualified_name"]: r["id"] for r in repo.symbols.collect()}
    links = {(r["src"], r["dst"]): r["tenths"] for r in repo.edges.collect()}
    assert links[names["Base.m"], names["helper"]] == 10 and links[names["Sub.go"], names["Base.m"]] == 9
    assert links[names["Sub"], names["Base"]] == 10
    assert {(r["kind"], r["path"]) for r in repo.entrypoints().collect()} == {("module", "src/app.py")}
    hits = repo.search("helper")
    assert hits[0]["title"] == "helper" and any(h["stream"] == "doc" for h in hits)
    assert repo.ask("helper")["offline"]
    assert repo.investigate("helper")["step"] == "answer"
    assert len(repo.impact(names["helper"])["direct_callers"]) >= 1
    assert ("helper", 1) in {(n["qualified_name"], n["step"]) for n in repo.codemap("helper")["nodes"]}
    assert repo.file("src/app.py")["symbols"][0]["qualified_name"] == "Base"
    assert repo.file("nothing") is None
    assert {"architecture", "getting-started"} <= {p["key"] for p in repo.wiki()}
    assert set(repo.snapshot()) == {"repo", "counts", "architecture", "entrypoints", "dead_code", "coupling", "communities", "folders", "graph"}
    assert "graph" in repo.graph_page()
    assert repo.scan()[1] == ["No language model is configured, so nothing was found."]
    assert repo.overview()["reading_path"] == []
    assert repo.definitions().count() >= 5
