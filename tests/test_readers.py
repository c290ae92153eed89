"""The data sources of history and issues against git itself and against the pages."""

import subprocess

import pytest

from lodestone.sources import repository
from lodestone.sources.readers import HistorySource, issue_source


def git(root, *args):
    return subprocess.run(["git", "-C", str(root), "-c", "user.name=A", "-c", "user.email=a@b", *args], check=True, capture_output=True, text=True).stdout


def commit(root, name, text):
    (root / name).write_text(text)
    git(root, "add", ".")
    git(root, "commit", "-m", f"change {name}")


@pytest.fixture
def work(tmp_path):
    git(tmp_path, "init", "-b", "main")
    for i in range(7):
        commit(tmp_path, f"f{i % 3}.txt", "line\n" * (i + 1))
    return tmp_path


def test_history_in_ranges(spark, work):
    spark.dataSource.register(HistorySource)
    read = spark.read.format("git_history").option("path", str(work)).option("rows", 2).load()
    assert read.rdd.getNumPartitions() == 4
    assert [r["sha"] for r in read.orderBy("id").collect()] == git(work, "rev-list", "HEAD").split()
    first = read.orderBy("id").first()
    assert first["id"] == 1 and first["files_changed"] == 1 and first["changes"][0]["path"] == "f0.txt"
    limited = spark.read.format("git_history").option("path", str(work)).option("rows", 2).option("limit", 3).load()
    assert sorted(r["id"] for r in limited.collect()) == [1, 2, 3]
    assert spark.read.format("git_history").option("path", str(work)).option("limit", 0).load().count() == 0


def test_an_empty_repository_has_no_history(spark, tmp_path):
    git(tmp_path, "init", "-b", "main")
    commits, changes = repository.read_history(spark, str(tmp_path))
    assert commits.count() == 0 and changes.count() == 0


def test_stream_reads_what_is_new(spark, work, tmp_path_factory):
    spark.dataSource.register(HistorySource)
    state, name = str(tmp_path_factory.mktemp("offsets")), str(tmp_path_factory.mktemp("sink") / "rows")

    def run():
        stream = spark.readStream.format("git_history").option("path", str(work)).option("rows", 3).load()
        stream.select("sha").writeStream.format("parquet").option("path", name).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["sha"] for r in spark.read.parquet(name).collect())

    assert run() == sorted(git(work, "rev-list", "HEAD").split())
    commit(work, "new.txt", "x\n")
    assert run() == sorted(git(work, "rev-list", "HEAD").split())
    assert run() == sorted(git(work, "rev-list", "HEAD").split())


def test_issue_pages(spark):
    def get(page):
        return [f"{page}:{i}" for i in range(10)] if page < 13 else ["last"] if page == 13 else []

    spark.dataSource.register(issue_source(get, "pages_of_ten"))
    read = spark.read.format("pages_of_ten").option("page_size", 10)
    assert read.option("limit", 400).load().count() == 121
    assert [r["json"] for r in read.option("limit", 25).load().orderBy("page", "place").collect()][-1] == "3:4"
    assert read.option("limit", 0).load().count() == 0
