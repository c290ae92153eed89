"""Questions to a model as a stage of a job: tasks ask, each distinct question once, and answers are kept."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, new_folder
from ..providers import ATTEMPTS, retrying
from ..sources.snapshots import Log

ANSWER = "key string, model string, answer string, error string, seconds double, sent long, received long"
#: Questions that one task asks, which is what a lost task asks again.
BATCH = 64
#: Questions whose answers are written at once, which is what a lost driver loses.
WAVE = 4096
#: Waves of one call: with more than WAVE times as many questions waves are larger, not more.
MOST_WAVES = 64
#: Answers in one file.
FILE = 4096


class ModelStage:
    """Answers of one model, kept below a folder that driver and executors share.

    A question is known by the hash of the model's name and its whole text, so equal questions are asked
    once, in this run or in any before. Questions go out in waves, each wave in tasks of about `batch`
    questions; when a wave is done its answers are appended to the table. A call that fails is tried again
    after pauses that double; when it fails to the end its error is kept instead of an answer, other
    questions go on, and the next run asks it again. `per_second` is what all tasks together may ask.

    `call` is sent to the tasks, so it must be picklable. A null question has a null answer and is not asked;
    an empty one is asked like any other.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, call: Callable[[str], str], *, batch: int = BATCH, wave: int = WAVE, per_second: float | None = None, attempts: int = ATTEMPTS, pause: float = 1.0):
        if batch < 1 or wave < 1 or (per_second is not None and per_second <= 0):
            raise ValueError("batch, wave and per_second must be positive")
        self.spark, self.path, self.name, self.call = spark, f"{path.rstrip('/')}/answers", name, call
        self.batch, self.wave, self.per_second, self.attempts, self.pause = batch, wave, per_second, attempts, pause
        self.log = Log(spark, self.path)

    def _key(self):
        return F.sha2(F.concat(F.lit(f"{self.name}\n"), F.col("prompt")), 256)

    def kept(self) -> DataFrame:
        """The answers so far, one a key; an answer counts before an error."""
        if not self.log.fs.exists(self.log._at(self.path)):
            return self.spark.createDataFrame([], ANSWER)
        rows = self.spark.read.schema(ANSWER).parquet(self.path)
        names = [c for c in rows.columns if c != "key"]
        best = F.min_by(F.struct(*names), F.struct(F.col("error").isNotNull(), F.col("seconds")))
        return rows.groupBy("key").agg(best.alias("__row")).select("key", "__row.*")

    def _asking(self, tasks: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        name, call, attempts, pause = self.name, self.call, self.attempts, self.pause
        at_once = min(tasks, self.spark.sparkContext.defaultParallelism)
        gap = at_once / self.per_second if self.per_second else 0.0

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            free = 0.0

            def paced(prompt: str) -> str:
                nonlocal free
                time.sleep(max(0.0, free - time.monotonic()))
                free = time.monotonic() + gap
                return call(prompt)

            patient = retrying(paced, attempts, pause)
            for part in parts:
                rows = []
                for key, prompt in zip(part["key"], part["prompt"], strict=True):
                    began, answer, error = time.monotonic(), None, None
                    try:
                        answer = patient(prompt)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                    rows.append((key, name, answer, error, time.monotonic() - began, len(prompt), len(answer or "")))
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ANSWER.split(", ")])

        return run

    def ask(self, prompts: DataFrame) -> DataFrame:
        """prompts(prompt, ...) with `answer` and `error`; what has no answer yet is asked now."""
        asked = prompts.where("prompt is not null").select(self._key().alias("key"), "prompt").groupBy("key").agg(F.any_value("prompt").alias("prompt"))
        # what is asked must not change while answers are being added
        open_ = cut(asked.join(self.kept().where("error is null").select("key"), "key", "left_anti"))
        n = open_.count()
        waves = min(-(-n // self.wave), MOST_WAVES)
        if waves > 1:
            # a wave reads its own questions alone
            questions = f"{new_folder(self.spark, 'questions')}/open"
            open_.withColumn("wave", F.pmod(F.xxhash64("key"), F.lit(waves))).repartition(waves, "wave").write.partitionBy("wave").parquet(questions)
        for i in range(waves):
            own = open_ if waves == 1 else self.spark.read.schema("key string, prompt string, wave long").parquet(questions).where(F.col("wave") == i).drop("wave")
            tasks = max(1, -(-n // (waves * self.batch)))
            files = max(1, -(-n // (waves * FILE)))
            own.repartition(tasks, "key").mapInPandas(self._asking(tasks), ANSWER).repartition(files).write.mode("append").parquet(self.path)
        answers = self.kept().select(F.col("key").alias("__key"), "answer", "error")
        return prompts.withColumn("__key", self._key()).join(answers, "__key", "left").drop("__key")

    def calls(self) -> DataFrame:
        """(name, seconds, sent, received) of the answers so far, as providers.Calls keeps them."""
        return self.kept().where("error is null").select(F.col("model").alias("name"), "seconds", "sent", "received")
