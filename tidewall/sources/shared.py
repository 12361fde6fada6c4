"""The folder that driver and executors share, and tables stored there to cut a plan."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir. Only a local session may do without that setting (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidewall-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task makes of its share of a small table, at most on average.
ROWS_A_TASK = 1 << 18


def tasks_for(df: DataFrame, each: int = 1, most: int = ROWS_A_TASK) -> int:
    """Tasks over which to deal df, of whose rows each is about to become `each`, for none to make more than about
    `most`: a small table would lie in one task, whatever is made of it. Counts df, which is a job."""
    return max(1, -(-df.count() * each // most))


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table made by `stored`, once nothing will read it again, where it is a file system's."""
    for folder in {urlparse(f.rsplit("/", 1)[0]) for f in df.inputFiles()}:
        if folder.scheme in ("", "file"):
            shutil.rmtree(folder.path, ignore_errors=True)
