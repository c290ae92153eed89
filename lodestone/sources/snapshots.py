"""Tables whose state is a log of snapshots: readers see the last one committed, whole, or none of it.

A snapshot is a small JSON file in `log/`, numbered from 1, that names the data folders it consists of.
Writers put their rows into a new folder first and then commit by renaming a file to the next number,
which fails if another writer was there first: then the change is worked out again on what that writer
left. A writer that dies before its rename leaves folders that no snapshot names; `vacuum` removes them.
Data of one value of the column `by` are kept apart, so a change to one repository rewrites that alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPTS = 10
#: Data folders of one value that may stand side by side before an append puts them together.
FOLDERS = 16


class Conflict(Exception):
    """Another writer has committed the same version."""


class Log:
    """Numbered states below a folder; a number is given once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        at = self._at(f"{self.path}/log")
        names = [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """The last state, or that of a version; (0, {}) before the first."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return 0, {}
        if version not in known:
            raise KeyError(f"there is no version {version} of {self.path}")
        stream = self.fs.open(self._at(f"{self.path}/log/{version:012d}.json"))
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, state: dict) -> int:
        """Make state that of the version after this one; Conflict if there is one."""
        draft, final = (self._at(f"{self.path}/log/{name}") for name in (f"{uuid.uuid4().hex}.draft", f"{version + 1:012d}.json"))
        out = self.fs.create(draft, True)
        try:
            out.write(json.dumps(state).encode())
        finally:
            out.close()
        gateway, hadoop = self.spark._sc._gateway, self.spark._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(final.makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(draft, final, gateway.new_array(hadoop.Options.Rename, 0))  # never over a file that is there
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{self.path} has a version {version + 1} already") from None
            raise
        return version + 1

    def folders(self, below: str) -> list[str]:
        at = self._at(f"{self.path}/{below}")
        return [f.getPath().getName() for f in self.fs.listStatus(at) if f.isDirectory()] if self.fs.exists(at) else []

    def remove(self, path: str) -> None:
        self.fs.delete(self._at(path), True)


def _key(value: object) -> str:
    """What a value of `by` is called in a snapshot."""
    return "null" if value is None else f"v{value}"


class SnapshotTable:
    """A table below `path`; `by` names the column whose values are kept apart, if any."""

    def __init__(self, spark: SparkSession, path: str, by: str | None = "repo_id"):
        self.spark, self.by, self.log = spark, by, Log(spark, path)
        self.path = self.log.path

    def exists(self) -> bool:
        return bool(self.log.versions())

    def read(self, version: int | None = None, values: list | None = None) -> DataFrame:
        """The rows of the last snapshot, or of a version; of `values` of the column `by` alone."""
        _, state = self.log.state(version)
        if not state:
            raise KeyError(f"{self.path} has no snapshot")
        return self._rows(state, values)

    def _rows(self, state: dict, values: list | None = None) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        wanted = None if values is None else set(map(_key, values))
        paths = [f"{self.path}/{d['folder']}" for d in state["data"] if wanted is None or d["of"] in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame) -> list[dict]:
        """Rows in folders of their own, one for each value of `by`; no snapshot names them yet."""
        name = f"data/{uuid.uuid4().hex}"
        if self.by is None:
            df.write.parquet(f"{self.path}/{name}")
            return [{"folder": name, "of": None}]
        of = F.coalesce(F.concat(F.lit("v"), F.col(self.by).cast("string")), F.lit("null"))
        df.withColumn("__of", of).write.partitionBy("__of").parquet(f"{self.path}/{name}")
        parts = [p for p in self.log.folders(name) if p.startswith("__of=")]
        return [{"folder": f"{name}/{p}", "of": unquote(p[5:])} for p in parts]

    def _commit(self, version: int, state: dict, data: list[dict], schema: T.StructType, kind: str) -> int:
        return self.log.commit(version, {"schema": schema.jsonValue(), "data": data, "kind": kind, "rows_of": state.get("rows_of", self.by)})

    def _again(self, once: Callable[[], int]) -> int:
        for _ in range(ATTEMPTS):
            try:
                return once()
            except Conflict as e:
                last = e
        raise last

    def replace(self, df: DataFrame, values: list | None = None) -> int:
        """Put df in the place of all rows, or of those of these values of `by` (df may hold others too)."""
        new = self._write(df)

        def once() -> int:
            version, state = self.log.state()
            gone = {d["of"] for d in new} | set(map(_key, values or []))
            kept = [] if values is None else [d for d in state.get("data", []) if d["of"] not in gone]
            return self._commit(version, state, kept + new, self._schema(state if kept else {}, df), "replace")

        return self._again(once)

    def append(self, df: DataFrame) -> int:
        new = self._write(df)

        def once() -> int:
            version, state = self.log.state()
            data, schema = state.get("data", []) + new, self._schema(state, df)
            crowded = {d["of"] for d in new if sum(x["of"] == d["of"] for x in data) > FOLDERS}
            if crowded:
                old = [d for d in data if d["of"] in crowded]
                together = self._rows({"schema": schema.jsonValue(), "data": old})
                data = [d for d in data if d["of"] not in crowded] + self._write(together.coalesce(1))
            return self._commit(version, state, data, schema, "append")

        return self._again(once)

    @staticmethod
    def _schema(state: dict, df: DataFrame) -> T.StructType:
        """df's, which must have the columns that the table has."""
        def kinds(s: T.StructType) -> set:
            return {(f.name, f.dataType.simpleString()) for f in s.fields}

        if state and kinds(T.StructType.fromJson(state["schema"])) != kinds(df.schema):
            raise ValueError(f"the rows have columns {sorted(kinds(df.schema))}, the table others")
        return T.StructType.fromJson(state["schema"]) if state else df.schema

    def update(self, change: Callable[[DataFrame], DataFrame], values: list | None = None, kind: str = "update") -> int:
        """Replace the rows (of these values of `by`) by what `change` makes of them.

        If another writer comes first, `change` is asked again with the rows as that writer left them.
        """

        def once() -> int:
            version, state = self.log.state()
            if not state:
                raise KeyError(f"{self.path} has no snapshot")
            wanted = None if values is None else set(map(_key, values))
            made = change(self._rows(state, values))
            new = self._write(made)
            kept = [d for d in state["data"] if wanted is not None and d["of"] not in wanted]
            return self._commit(version, state, kept + new, self._schema(state, made), kind)

        return self._again(once)

    def merge(self, df: DataFrame, keys: list[str], values: list | None = None) -> int:
        """Rows of df in the place of those with equal keys, and all others as they are."""
        if not self.exists():
            return self.replace(df)
        same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]

        def change(old: DataFrame) -> DataFrame:
            condition = same[0]
            for s in same[1:]:
                condition = condition & s
            rest = old.alias("old").join(df.select(*keys).distinct().alias("new"), condition, "left_anti")
            return rest.unionByName(df)

        return self.update(change, values, "merge")

    def delete(self, condition: str, values: list | None = None) -> int:
        return self.update(lambda rows: rows.where(f"not coalesce({condition}, false)"), values, "delete")

    def history(self) -> list[dict]:
        return [{"version": v, "kind": self.log.state(v)[1]["kind"]} for v in self.log.versions()]

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last snapshots, and remove folders that none names; how many went.

        Only while nobody else writes: a folder that is being written is named by no snapshot yet.
        """
        versions = self.log.versions()
        for v in versions[: max(0, len(versions) - keep)]:
            self.log.remove(f"{self.path}/log/{v:012d}.json")
        named = {d["folder"].split("/")[1] for v in versions[-keep:] for d in self.log.state(v)[1]["data"]}
        gone = [f for f in self.log.folders("data") if f not in named]
        for f in gone:
            self.log.remove(f"{self.path}/data/{f}")
        return len(gone)


__all__ = ["Conflict", "Log", "SnapshotTable"]
