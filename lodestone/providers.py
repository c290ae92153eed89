"""Which language model and embedder answer: the first that is there, tried again when it fails, and logged."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Call = Callable[[str], str]

# The order in which models are looked for, how often a call is tried, texts in a batch.
MODEL_ORDER = ("gemini", "anthropic", "openrouter", "alibaba", "ollama")
ATTEMPTS = 8
BATCHES = {"local": 64, "gemini": 32, "alibaba": 10}


def resolve(available: dict[str, Call | None], preferred: str | None = None) -> tuple[str, Call] | None:
    """(name, call) of the preferred model if it is there, else of the first in order; None without any."""
    for name in (preferred, *MODEL_ORDER):
        if name and available.get(name):
            return name, available[name]
    return None


def retrying(call: Callable, attempts: int = ATTEMPTS, pause: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried again after pauses that double, up to `attempts` times; the last error is raised."""

    def run(*args, **options):
        for i in range(attempts):
            try:
                return call(*args, **options)
            except Exception:
                if i == attempts - 1:
                    raise
                sleep(min(most, pause * 2**i))

    return run


class BatchingEmbedder:
    """An embedder that asks a source for vectors in batches of its size, each tried again when it fails."""

    def __init__(self, embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int, **options):
        self.dim, self.batch, self._embed = dim, batch, retrying(embed, **options)

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for a in range(0, len(texts), self.batch):
            part = self._embed(texts[a : a + self.batch])
            if len(part) != len(texts[a : a + self.batch]) or any(len(v) != self.dim for v in part):
                raise ValueError("the source returned other vectors than were asked for")
            out += part
        return out


class Calls:
    """Calls of models as rows: what each took, and how many characters went either way."""

    SCHEMA = "name string, seconds double, sent long, received long"

    def __init__(self) -> None:
        self.rows: list[tuple[str, float, int, int]] = []
        #: Tables of the calls that tasks made, by the folder they are kept in.
        self.kept: dict[str, Callable[[], DataFrame]] = {}

    def watched(self, name: str, call: Call) -> Call:
        """call, with a row for each answer; tasks, whose rows would stay with them, take its `bare`."""

        def run(prompt: str) -> str:
            began = time.monotonic()
            answer = call(prompt)
            self.rows.append((name, time.monotonic() - began, len(prompt), len(answer)))
            return answer

        run.bare, run.model, run.calls = call, name, self
        return run

    def table(self, spark: SparkSession) -> DataFrame:
        out = spark.createDataFrame(self.rows, self.SCHEMA)
        for kept in self.kept.values():
            out = out.unionByName(kept())
        return out
