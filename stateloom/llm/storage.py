"""Tables and scratch storage shared by the training-data operators.

Intermediate tables cut lineage: they are Parquet below the folder named by
``spark.checkpoint.dir``, which every executor and the driver can reach, so a
lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that a Python task reads at a time.
BATCH_BYTES = 8 << 20
#: Whether Spark deletes a query's shuffle files as it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a local folder if all tasks run in this process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-stateloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """A folder of intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back; the shuffle files that it took go."""
        conf = self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(self.path(name))
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        """Delete the folder with all that is left in it."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_owner: list[str] = [""]
_held: dict = {}


def hold(key, make):
    """What ``make`` returns, kept in this Python process until a task of another operator runs in it."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def _trim() -> None:
    """Give freed memory back to the system: reused workers would keep it beside the next task's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it trims by itself or not at all


def _owned(function, owner: str):
    def run(batches):
        # workers serve one operator after another; what they hold of the one before goes
        if _owner[0] != owner:
            _owner[0] = owner
            _held.clear()
            _trim()
        yield from function(batches)
        _trim()

    return run


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes, however long the texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if conf.get(key).removesuffix("b") in ("-1", str(64 << 20)):
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(_owned(function, function.__module__), schema)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
