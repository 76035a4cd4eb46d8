"""Helpers shared by the corpus operators: tables, shared scratch storage and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that an operator holds as Python objects at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is set to a temporary folder only where nothing set it and the session is local, as in tests.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(found)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, below one of this application's that goes when the driver ends."""
    root = f"{shared_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_forget, spark.sparkContext._jvm, root)
    return f"{root}/{what}-{uuid.uuid4().hex}"


_ROOTS: set[str] = set()


def _forget(jvm, root: str) -> None:
    from py4j.protocol import Py4JError

    try:
        at = jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except (OSError, Py4JError):  # the JVM has ended before
        pass


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs now rather than when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_end_with_queries(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run within it go as each query ends; a collection of garbage right after a query may miss its own."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that long texts never stand in memory as Python objects by the thousand."""
    give_back()  # of the task before
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


def give_back() -> None:
    """Returns free memory of this process to the system: a worker is kept from task to task, and what it held at most would be too."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library's


class Remembered(dict):
    """``make``'s results by key, in bounded memory: of two generations the older goes when the newer is full."""

    def __init__(self, make: Callable, entries: int, longest_key: int = 64):
        super().__init__()
        self.make, self.entries, self.longest_key, self.older = make, entries, longest_key, {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest_key:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found
