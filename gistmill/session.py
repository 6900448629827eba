"""The shared folder and what is stored in it."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only where the session names none, as in a test, is one made; that is
    refused unless Spark runs in this one process.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="gistmill-")


_made: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_folders(spark: SparkSession) -> None:
    """Delete what this process has stored in the shared folder. Tables that
    were built on it can't be read any more."""
    while _made:
        _delete(spark, _made.pop())


def used_up(*tables: DataFrame) -> None:
    """Delete tables that ``written`` has stored and nothing will read again."""
    for df in tables:
        folder = getattr(df, "_stored_in", None)
        if folder in _made:
            _made.remove(folder)
            _delete(df.sparkSession, folder)


def written(df: DataFrame, label: str = "stage", **options: str) -> DataFrame:
    """Cut lineage: write to the shared folder, with Parquet's ``options``, and
    read back."""
    path = new_folder(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    stored = df.sparkSession.read.parquet(path)
    stored._stored_in = path
    return stored


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files of tables that nothing refers to go when the driver collects
    its garbage; what it has of such a table is small, so it may be long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int = 1 << 23) -> Iterator[None]:
    """Jobs that run inside pass ``most`` bytes or a row at a time to Python
    workers: the default bounds rows, of which long texts need few."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)
