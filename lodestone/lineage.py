"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder that spark.checkpoint.dir names.

    A session without that setting gets a temporary folder if it runs on this machine alone (a local
    test); on a cluster, which would not see it, that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Rounds:
    """Where an operator of many rounds keeps its tables: each is written once and read again.

    A checkpoint remembers the constraints and the size estimate of its plan, which double with each round
    that renames or joins; a written table has neither, and what it reads is its own files.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, new_folder(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")
