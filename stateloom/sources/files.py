"""Folders and small files through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a local one if all tasks run in this process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-stateloom-")
    return found.rstrip("/")


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Have the folder, made now if it isn't there, deleted when the driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and return the table read back; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(self.at(name)))

    def make_root(self) -> None:
        self.fs.mkdirs(self._path(self.root))

    def names(self, folder: str | None = None) -> list[tuple[str, bool, int]]:
        """(name, is a folder, bytes) of what the root, or a folder in it, holds; fails if that isn't there."""
        return [(s.getPath().getName(), s.isDirectory(), s.getLen()) for s in self.fs.listStatus(self._path(self.at(folder) if folder else self.root))]

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(self.at(name))).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(self.at(name)), True)

    def rename(self, old: str, new: str, replace: bool = False) -> None:
        """Rename in one step of the file system; what has the new name already is an error, or replaced if asked."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if replace else kind.NONE
        try:
            self.context.rename(self._path(self.at(old)), self._path(self.at(new)), options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise FileExistsError(self.at(new)) from e
            raise OSError(f"{self.at(old)} wasn't renamed to {new}") from e

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """Write to another name first and replace by rename, so that a reader sees the old bytes or the new ones."""
        temporary = f".{name}.{uuid.uuid4().hex}.tmp"
        try:
            stream = self.fs.create(self._path(self.at(temporary)), False)
            try:
                stream.write(bytearray(data))
                stream.hsync()
            finally:
                stream.close()
            self.rename(temporary, name, replace=True)
        except BaseException:
            self.delete(temporary)
            raise
