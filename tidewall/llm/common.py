"""What the operators of this subpackage share: table reads, the shared folder, bounded word caches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to Python at once where they hold texts: a batch lies twice outside the heap, once more in the worker.
FEW_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Only a local session may do without that setting (tests): a temporary folder then stands in its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("TIDEWALL_SHARED_DIR")
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidewall-")
        os.environ["TIDEWALL_SHARED_DIR"] = root
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of a query that ends in here are deleted with it: what it wrote or collected is all that is read again."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


@contextlib.contextmanager
def batches_of(spark: SparkSession, most_bytes: int):
    """Queries that run in here send rows to Python in batches of most_bytes or a row more."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def stored(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """df written to the shared folder and read back: a cut in the lineage that outlives executors.

    Its Python steps get rows in batches of batch_bytes, or as the session has it.
    """
    path = shared_dir(df.sparkSession, label)
    with freed_shuffles(df.sparkSession), batches_of(df.sparkSession, batch_bytes) if batch_bytes else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table made by stored, once nothing will read it again, where it is a file system's."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path := local_path(folder):
            shutil.rmtree(path, ignore_errors=True)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a plain path; None where another store holds it."""
    parts = urlparse(uri)
    return (parts.path or uri) if parts.scheme in ("", "file") else None


#: Functions whose one result a Python worker keeps from task to task.
KEPT: list = []


def kept_by_worker(function: Callable) -> Callable:
    """The function with its last result kept for the next tasks of its stage, until another operator needs the room."""
    cached = functools.lru_cache(maxsize=1)(function)
    KEPT.append(cached)
    return cached


def release_memory(keep: Callable | None = None) -> None:
    """Drops what a Python worker, which Spark reuses from stage to stage, keeps for other operators than `keep`, and
    gives what is free back to the system."""
    for cached in KEPT:
        if cached is not keep:
            cached.cache_clear()
    gc.collect()
    trim_memory()


def trim_memory() -> None:
    """Gives what is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no such call outside glibc
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: int, most_bytes: int, most_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have most_bytes bytes or a little more; one row at least, most_rows at most."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = min(at + most_rows, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes)) + 1)
            yield batch.slice(at, to - at)
            at = to


def crc32_text(col: Column) -> Column:
    """crc32 of an integer's decimal text; null stays null."""
    return F.crc32(col.cast("string").cast("binary"))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


class WordCache(dict):
    """word -> value, made on first sight; emptied at `limit` entries so that memory stays bounded."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        value = self.make(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value
