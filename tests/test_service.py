"""Repositories, jobs, findings, conversations and pages as a service keeps them; providers."""

import json
import subprocess

import pytest

from lodestone import providers
from lodestone.operators import retrieval
from lodestone.service import Refused, Service

FILES = {
    "src/app.py": "import os\n\n\nclass App:\n    def run(self):\n        return self.go()\n\n    def go(self):\n        return helper(1)\n\n\ndef helper(x):\n    return x\n",
    "src/util.py": "from app import helper\n\n\ndef twice(x):\n    return helper(helper(x))\n",
    "tests/test_app.py": "from app import helper\n\n\ndef test_helper():\n    assert helper(1) == 1\n",
    "README.md": "An app.\n\nIt runs.\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    for args in (["init", "-q", "-b", "main"], ["add", "."], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "first commit of all"]):
        subprocess.run(["git", "-C", str(root), *args], check=True)
    return str(root)


def reply(prompt):
    return json.dumps({"findings": [{"title": "T", "description": "D", "category": "logic", "severity": "high", "start_line": 2, "end_line": 3}]})


@pytest.fixture(scope="module")
def service(spark, tree):
    made = Service(spark, "unused", open_=lambda url, token: tree, tracker=lambda payload: "https://t/1", model=reply)
    job = made.add("https://host.example/o/app/tree/main")
    assert made.job(job["job_id"])["status"] == "done", made.job(job["job_id"])
    return made


def refused(f, *args):
    with pytest.raises(Refused) as e:
        f(*args)
    return e.value.status


def test_repositories_and_jobs(spark, service):
    assert service.active().info["url"] == "https://host.example/o/app"
    assert [r["id"] for r in service.repos()] == [1] and service.repos()[0]["counts"]["files"] == 4
    assert refused(service.add, "git@host:o/r") == 422 and refused(service.add, "notaurl") == 422
    assert refused(service.job, "nope") == 404 and refused(Service(spark, "x").active) == 404
    assert all(len(r["id"]) == 12 for r in service.tables["jobs"].read().collect())


def test_a_running_job_is_returned_and_errors_are_masked(spark):
    waiting = []

    def fail(url, token):
        raise RuntimeError(f"could not read https://{token}@host")

    service = Service(spark, "unused", open_=fail, run=waiting.append)
    first = service.add("https://h.example/o/r", "s3cr3t")
    assert service.add("https://h.example/o/r/blob/main/x")["job_id"] == first["job_id"] and len(waiting) == 1
    waiting[0]()
    job = service.job(first["job_id"])
    assert job["status"] == "error" and "s3cr3t" not in job["error"]
    assert service.add("https://h.example/o/r")["job_id"] != first["job_id"]


def test_refresh_replaces_the_repository(service):
    before = service.active().info["id"]
    assert service.job(service.refresh()["job_id"])["status"] == "done"
    assert [r["id"] for r in service.repos()] == [before + 1]


def test_findings_have_a_life(service):
    assert service.job(service.scan()["job_id"])["result"]["found"] == 2
    rows = service.weaknesses()["weaknesses"]
    assert [r["file_path"] for r in rows] == ["src/app.py", "src/util.py"]
    assert rows[0]["lang"] == "python" and rows[0]["snippet"] == "\n"
    first, second = (r["id"] for r in rows)
    assert service.dismiss(first) == {"id": first, "status": "dismissed"}
    assert refused(service.dismiss, 999) == 404 and refused(service.tickets, []) == 422
    assert service.job(service.tickets([second], "K")["job_id"])["result"] == {"created": 1, "skipped": 0}
    assert refused(service.dismiss, second) == 409
    service.scan()
    states = sorted(r["status"] for r in service.weaknesses()["weaknesses"])
    assert states == ["new", "new", "ticketed"]
    service.tracker = None
    assert refused(service.tickets, [first]) == 400


def test_conversations(service):
    one = service.save_conversation("investigate", " why? ", {"answer": 1})
    two = service.save_conversation("investigate", "how?", {"answer": 2})
    service.save_conversation("codemap", "where?", {})
    assert [c["id"] for c in service.conversations("investigate")] == [two, one]
    assert service.conversation(one)["question"] == "why?" and service.conversation(one)["result"] == {"answer": 1}
    assert service.delete_conversation(one) == {"deleted": one}
    assert refused(service.conversation, one) == 404 and refused(service.delete_conversation, one) == 404
    assert refused(service.save_conversation, "other", "q", {}) == 422


def test_pages_are_made_or_changed(service):
    pages, files = {"Old": ["1", "x"]}, []
    find = lambda title: pages[title][0] if title in pages else None

    def create(title, body):
        pages[title] = [str(len(pages) + 1), body]
        return pages[title][0]

    def update(number, body):
        next(p for p in pages.values() if p[0] == number)[1] = body

    job = service.publish({"Old": {"body": "new"}, "New": {"body": "b", "attachments": {"a.svg": b"x"}}}, find, create, update, lambda *a: files.append(a))
    assert service.job(job["job_id"])["result"] == {"created": ["New"], "updated": ["Old"]}
    assert pages["Old"][1] == "new" and files == [("2", "a.svg", b"x")]


def test_health(service):
    def broken():
        raise RuntimeError("no")

    assert service.health()["status"] == "ok"
    assert service.health({"index": broken})["checks"]["index"] == {"status": "error", "detail": "no"}


def test_operations_of_the_active_repository(service):
    repo = service.active()
    ids = {r["qualified_name"]: r["id"] for r in repo.symbols.where("kind <> 'import'").collect()}
    report = repo.impact(ids["helper"])
    # a class's code holds its methods' calls
    assert [c["qualified_name"] for c in report["direct_callers"]] == ["App", "App.go", "test_helper", "twice"]
    assert [(c["qualified_name"], c["depth"]) for c in report["transitive_callers"]] == [("App.run", 2)]
    assert [c["qualified_name"] for c in report["test_callers"]] == ["test_helper"]
    assert report["risk"]["level"] == "low" and report["fan_in"] == 4 and report["coupled_files"] == []
    assert repo.impact(10_000) == {"error": "Symbol not found"}
    assert {f["folder"] for f in repo.architecture()["folders"]} == {"src", "tests"}
    assert {r["folder"] for r in repo.files_by_folder("APP").collect()} == {"src", "tests"}
    assert {r["name"]: list(r["ids"]) for r in repo.definitions().collect()}["helper"] == [ids["helper"]]
    assert repo.ego(ids["twice"]).count() >= 1
    hits = repo.search("helper twice")
    assert hits and {"stream", "citation", "title", "body", "score"} <= set(hits[0])


def test_search_by_words_and_vectors(spark, service):
    """Many questions at once; with an embedder the vectors' lists are fused too, and indexes are made once."""
    repo = service.active()
    asked = spark.createDataFrame([(1, "helper twice"), (2, "first commit"), (3, "nothing_like_this")], "query_id int, text string")
    words = repo.search_table(asked).collect()
    assert {r["query_id"] for r in words} == {1, 2}
    one = [(h["citation"], round(h["score"], 9)) for h in repo.search("helper twice")]
    assert len(one) == sum(r["query_id"] == 1 for r in words)
    assert {r["id"] for r in repo.search_table(asked, ["code"], kind="class").where("source = 'code'").collect()} <= {str(r["id"]) for r in repo.symbols.where("kind = 'class'").collect()}
    repo.embedder = retrieval.HashingEmbedder(32)
    try:
        both = repo.search_table(asked, k=50)
        assert {r["query_id"] for r in both.collect()} == {1, 2, 3}
        ids = {(r["query_id"], r["source"], r["id"]) for r in both.collect()}
        assert {(r["query_id"], r["source"], r["id"]) for r in words} <= ids
        made = repo.vectors("code").log.versions()
        repo.search("helper")
        assert repo.vectors("code").log.versions() == made == [1] and repo.index("code").log.versions() == [1]
    finally:
        repo.embedder = None


def test_providers_resolve_in_order_and_try_again():
    calls, waits = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    name, call = providers.resolve({"ollama": flaky, "anthropic": None, "alibaba": flaky})
    assert name == "alibaba" and providers.resolve({"ollama": flaky}, "anthropic")[0] == "ollama" and providers.resolve({}) is None
    assert providers.retrying(call, sleep=waits.append)("p") == "ok" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        providers.retrying(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)()


def test_embedders_ask_in_batches():
    sizes = []

    def embed(texts):
        sizes.append(len(texts))
        return [[0.0, 1.0]] * len(texts)

    made = providers.BatchingEmbedder(embed, 2, providers.BATCHES["alibaba"])
    assert len(made.embed(["x"] * 23)) == 23 and sizes == [10, 10, 3]
    with pytest.raises(ValueError):
        providers.BatchingEmbedder(lambda t: [[1.0]], 2, 5, sleep=lambda s: None).embed(["a"])


def test_calls_are_rows(spark):
    log = providers.Calls()
    assert log.table(spark).count() == 0
    assert log.watched("m", lambda p: p * 2)("ab") == "abab"
    (row,) = log.table(spark).collect()
    assert (row["name"], row["sent"], row["received"]) == ("m", 2, 4) and row["seconds"] >= 0


def test_a_later_service_knows_what_an_earlier_one_did(spark, tree, tmp_path):
    """Repositories, jobs, findings and conversations outlive the process; a killed write changes nothing."""
    state, waiting = f"file://{tmp_path}/state", []

    def start(**options):
        return Service(spark, "unused", state=state, open_=lambda url, token: tree, tracker=lambda payload: "https://t/1", **options)

    one = start(models={"ollama": reply})
    assert one.job(one.add("https://host.example/o/app")["job_id"])["result"] == {"repo_id": 1}
    one.scan()
    first = one.weaknesses()["weaknesses"][0]["id"]
    one.dismiss(first)
    talk = one.investigate("what does helper do")["conversation_id"]
    assert [r["name"] for r in one.telemetry().collect()] == ["ollama"]
    one.run = waiting.append
    hanging = one.scan()["job_id"]
    symbols = one.active().symbols.count()

    two = start()
    assert [(r["id"], r["url"], r["counts"]["files"]) for r in two.repos()] == [(1, "https://host.example/o/app", 4)]
    assert two.active().symbols.count() == symbols and two.active().impact(1)["symbol"]["id"] == 1
    assert {r["id"]: r["status"] for r in two.weaknesses()["weaknesses"]}[first] == "dismissed"
    assert two.conversation(talk)["question"] == "what does helper do" and two.conversation(talk)["result"]["evidence"]
    assert two.job(hanging)["status"] == "error" and "ended" in two.job(hanging)["error"]

    table, before = two.tables["findings"], two.weaknesses()
    commit, table.log.commit = table.log.commit, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt)
    with pytest.raises(KeyboardInterrupt):
        two.dismiss(before["weaknesses"][-1]["id"])
    assert start().weaknesses() == before
    table.log.commit = commit
    two.dismiss(before["weaknesses"][-1]["id"])
    assert {r["status"] for r in start().weaknesses()["weaknesses"]} == {"dismissed"}
    assert two.job(two.refresh()["job_id"])["status"] == "done"
    assert [r["id"] for r in start().repos()] == [2] and start().weaknesses()["weaknesses"] == []
