"""The model stage: each question once, errors asked again, lost work asked again alone."""

import os
import uuid

import pytest

from lodestone.engine import Repository
from lodestone.operators import findings
from lodestone.operators.model_stage import ModelStage


class Model:
    """Answers with the question's length; keeps a file for each call. The first calls of some questions fail."""

    def __init__(self, folder, failures=0):
        self.folder, self.failures = str(folder), failures

    def calls(self):
        return sorted(open(f"{self.folder}/{n}").read() for n in os.listdir(self.folder) if n.startswith("call-"))

    def __call__(self, prompt):
        with open(f"{self.folder}/call-{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        if prompt.endswith("7") and self.calls().count(prompt) <= self.failures:
            raise TimeoutError("busy")
        return str(len(prompt))


def table(spark, prompts):
    return spark.createDataFrame(list(enumerate(prompts)), "id int, prompt string")


def test_a_flaky_model_answers_each_question_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    model = Model(tmp_path / "calls", failures=1)
    asked = [f"file {i}" for i in range(200)]
    stage = ModelStage(spark, f"file://{tmp_path}/kept", "m", model, batch=16, wave=70, pause=0.01)
    rows = stage.ask(table(spark, [*asked, *asked[:50], None, ""])).orderBy("id").collect()
    assert [r["answer"] for r in rows] == [*[str(len(x)) for x in asked], *[str(len(x)) for x in asked[:50]], None, "0"]
    # those that failed once were asked twice, all others once
    assert model.calls() == sorted([*asked, *[x for x in asked if x.endswith("7")], ""])
    assert stage.ask(table(spark, asked)).where("answer is null").count() == 0
    assert len(model.calls()) == 221 and stage.calls().count() == 201


def test_errors_are_kept_and_asked_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    model = Model(tmp_path / "calls", failures=2)
    stage = ModelStage(spark, f"file://{tmp_path}/kept", "m", model, attempts=2, pause=0.01)
    first = {r["prompt"]: r for r in stage.ask(table(spark, ["a", "b7"])).collect()}
    assert first["a"]["answer"] == "1" and first["b7"]["answer"] is None and first["b7"]["error"] == "TimeoutError: busy"
    again = {r["prompt"]: r for r in stage.ask(table(spark, ["a", "b7"])).collect()}
    assert again["b7"]["answer"] == "2" and again["b7"]["error"] is None
    assert model.calls() == ["a", "b7", "b7", "b7"]
    # another model's answers are its own
    other = ModelStage(spark, f"file://{tmp_path}/kept", "n", model)
    assert other.ask(table(spark, ["a"])).first()["answer"] == "1" and model.calls().count("a") == 2
    assert stage.ask(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        ModelStage(spark, str(tmp_path), "m", model, per_second=0)


def test_a_scan_asks_only_for_the_rest(spark, tmp_path):
    (tmp_path / "calls").mkdir()

    def reply(prompt):
        path = prompt.split("\n")[0]
        mark = f"{tmp_path}/calls/{path}"
        again = os.path.exists(mark)
        open(mark, "a").write("x")
        if path == "b.py" and not again:
            raise TimeoutError("busy")
        return '{"findings": [{"category": "logic", "title": "T", "description": "D", "start_line": 9, "end_line": 9}, {"category": "none"}]}'

    files = spark.createDataFrame([(1, p, "code", 2, "x\ny") for p in ("a.py", "b.py")] + [(1, "c.py", "code", 0, None)], "repo_id int, path string, category string, loc int, content string")
    changes = spark.createDataFrame([], "repo_id int, sha string, path string, insertions int, deletions int")
    repo = Repository(spark, {"id": 1}, files, None, changes, None, None, None, model=reply)
    with pytest.raises(RuntimeError, match="1 of 3 files got no answer: TimeoutError"):
        repo.scan()
    rows, notes = repo.scan()
    assert [(r["file_path"], r["start_line"]) for r in rows.orderBy("file_path").collect()] == [("a.py", 2), ("b.py", 2), ("c.py", 1)]
    assert notes == [] and [len(open(f"{tmp_path}/calls/{p}").read()) for p in ("a.py", "b.py", "c.py")] == [1, 2, 1]
    assert findings.found_in("no json", 3) == []


def test_many_questions_are_asked_in_a_bounded_number_of_waves(spark, tmp_path, monkeypatch):
    from lodestone.operators import model_stage

    (tmp_path / "calls").mkdir()
    monkeypatch.setattr(model_stage, "MOST_WAVES", 3)
    model = Model(tmp_path / "calls")
    asked = [f"file {i}" for i in range(60)]
    stage = ModelStage(spark, f"file://{tmp_path}/kept", "m", model, batch=16, wave=4)
    rows = stage.ask(table(spark, asked)).orderBy("id").collect()
    assert [r["answer"] for r in rows] == [str(len(x)) for x in asked] and model.calls() == sorted(asked)
    # a file a wave, not one a task
    assert len([n for n in os.listdir(tmp_path / "kept/answers") if n.endswith(".parquet")]) <= 3
