"""Snapshot tables: changes, conflicts, and writers that die on their way."""

import pytest
from pyspark.sql import functions as F

from lodestone.sources.snapshots import Conflict, SnapshotTable


@pytest.fixture
def made(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    table.replace(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 9, "n")], "repo_id int, id long, name string"))
    return table


def rows(table, **options):
    return sorted((tuple(r) for r in table.read(**options).collect()), key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, "repo_id int, id long, name string")


def test_changes_and_versions(spark, made):
    made.replace(frame(spark, [(2, 5, "x")]), [2])
    assert rows(made) == [(1, 1, "a"), (1, 2, "b"), (2, 5, "x"), (None, 9, "n")]
    made.append(frame(spark, [(3, 1, "y")]))
    made.merge(frame(spark, [(1, 2, "B"), (1, 3, "z"), (None, 9, "N")]), ["repo_id", "id"])
    assert rows(made) == [(1, 1, "a"), (1, 2, "B"), (1, 3, "z"), (2, 5, "x"), (3, 1, "y"), (None, 9, "N")]
    made.delete("id = 1 or name is null", [1])
    assert rows(made, values=[1]) == [(1, 2, "B"), (1, 3, "z")] and (3, 1, "y") in rows(made)
    assert rows(made, version=1) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 9, "n")]
    assert [h["kind"] for h in made.history()] == ["replace", "replace", "append", "merge", "delete"]
    made.replace(frame(spark, []), [1, 2, 3])
    assert rows(made) == [(None, 9, "N")]


def test_one_value_is_read_from_its_own_files(spark, made):
    assert all("__of=v1" in f for f in made.read(values=[1]).inputFiles())
    before = set(made.read(values=[2]).inputFiles())
    made.update(lambda r: r.withColumn("name", F.upper("name")), [1])
    assert set(made.read(values=[2]).inputFiles()) == before and rows(made, values=[1])[0] == (1, 1, "A")


def test_values_with_odd_names(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/odd", by="name")
    names = ["a/b", "a b", "=", "é%", "null", "", None]
    table.replace(frame(spark, [(1, i, n) for i, n in enumerate(names)]))
    for i, n in enumerate(names):
        assert (1, i, n) in rows(table, values=[n])


def test_a_writer_that_dies_leaves_the_old_snapshot(spark, made, monkeypatch):
    before = rows(made)
    monkeypatch.setattr(made.log, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    for change in (lambda: made.delete("id > 0"), lambda: made.replace(frame(spark, [])), lambda: made.append(frame(spark, [(7, 7, "x")]))):
        with pytest.raises(KeyboardInterrupt):
            change()
    other = SnapshotTable(spark, made.path)
    assert rows(other) == before and other.log.versions() == [1]
    assert other.vacuum() == 3 and rows(other) == before


def test_a_failing_job_changes_nothing(spark, made):
    before = rows(made)
    with pytest.raises(Exception, match="no good"):
        made.update(lambda r: r.withColumn("name", F.raise_error(F.lit("no good")).cast("string")))
    assert rows(made) == before


def test_writers_that_meet(spark, made):
    """The second writer's change is worked out again on the first one's result; nothing is lost."""
    other, asked = SnapshotTable(spark, made.path), []

    def change(current):
        if not asked:
            other.append(frame(spark, [(1, 50, "first")]))
        asked.append(1)
        return current.withColumn("name", F.concat("name", F.lit("!")))

    made.update(change, [1])
    assert len(asked) == 2
    assert rows(made, values=[1]) == [(1, 1, "a!"), (1, 2, "b!"), (1, 50, "first!")]
    with pytest.raises(Conflict):
        made.log.commit(1, {})


def test_appends_are_put_together(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/many")
    for i in range(18):
        table.append(frame(spark, [(1, i, "x")]))
    assert len(rows(table)) == 18 and len(table.log.state()[1]["data"]) < 16
    with pytest.raises(ValueError, match="columns"):
        table.append(spark.createDataFrame([(1, "a")], "repo_id int, other string"))
    table.vacuum(keep=2)
    assert len(rows(table)) == 18 and len(table.log.versions()) == 2
    with pytest.raises(KeyError):
        table.read(version=1)
