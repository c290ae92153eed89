"""What the operators of this subpackage share: the shared folder, files in it, words."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them, as a Java pattern: runs of anything but ASCII white space.
WORD_JAVA = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch sent to a Python worker.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where the session names none and runs on this machine alone (a local test) is a temporary
    folder made and set; on a cluster, which would not see it, that is an error.
    Every operator comes here, so this is also where Arrow batches are bounded by their bytes: with
    long texts, a batch of 10,000 rows may be larger than a worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders made since the last clean_up, by whoever called for them.
_made: list[str] = []


def new_dir(spark: SparkSession, name: str) -> str:
    """A new folder of that name below the shared one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    make_dir(path)
    _made.append(path)
    return path


@contextlib.contextmanager
def working_folders() -> Iterator[Callable[[], None]]:
    """Within, folders are remembered; the function given removes those made so far.

    Results that are not written yet may still read them: call it when they are.
    """
    before = len(_made)

    def remove() -> None:
        while len(_made) > before:
            fs, path = locate(_made.pop())
            if fs.get_file_info(path).type != pafs.FileType.NotFound:
                fs.delete_dir(path)

    yield remove


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = locate(uri)
    fs.create_dir(path, recursive=True)


def write_file(uri: str, data: bytes) -> None:
    """Write a file whole: under another name first, then renamed."""
    fs, path = locate(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)


class Ranges:
    """Range reads of files in the shared folder; keeps the last files open."""

    def __init__(self, keep: int = 32):
        self.keep, self.open = keep, {}

    def read(self, uri: str, offset: int, length: int) -> bytes:
        f = self.open.pop(uri, None)
        if f is None:
            if len(self.open) >= self.keep:
                self.open.pop(next(iter(self.open))).close()
            fs, path = locate(uri)
            f = fs.open_input_file(path)
        self.open[uri] = f
        return f.read_at(length, offset)

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open = {}


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder, with options of its writer, and read them again."""
    spark = df.sparkSession
    path = new_dir(spark, name) + "/table"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, column: str, name: str) -> DataFrame:
    """docs, written to the shared folder, with a number of its own for every row."""
    return materialise(docs.withColumn(column, F.monotonically_increasing_id()), name)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that a slice's strings hold about `limit` bytes (or one row)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def release_memory() -> None:
    """Give freed memory back: a Python worker stays when its task is over."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """The function of a mapInArrow, giving its memory back at the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole
