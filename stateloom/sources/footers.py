"""What Parquet footers tell of a sorted round: rows, key bounds and bytes of each row group, and keys compared file by file.

Footers are read in tasks, one file at a time, without reading a key.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import Files

_GROUP = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("part", "row_group", "rows", "first", "last", "key_bytes", "file_bytes"))])
_FOOTERS = "file string, part long, row_group long, rows long, first long, last long, key_bytes long, file_bytes long"


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path that a task can open itself; an error if there is none for the scheme."""
    if "://" not in uri and not uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def part_of(name: str) -> int:
    found = re.match(r"part-([0-9]+)", name)
    return int(found[1]) if found else -1


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, part, bytes) of the data files of a folder in order."""
    names = [(name, size) for name, folder, size in Files(spark, path).names() if not folder and name.endswith(".parquet")]
    return sorted(((posixpath.join(path, name), part_of(name), size) for name, size in names), key=lambda f: (f[1], f[0]))


def _dealt(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A row for each file, dealt over the cluster."""
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))


def footers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row group of a folder of files with one BIGINT column; groups without rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, part, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = opened(file)
                with fs.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                for k in range(meta.num_row_groups):
                    group = meta.row_group(k)
                    column = group.column(0)
                    if group.num_rows:
                        s = column.statistics
                        if s is None or not s.has_min_max:
                            raise ValueError(f"{file}: row group {k} has no bounds")
                        out.append((file, part, k, group.num_rows, s.min, s.max, column.total_compressed_size, size))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_GROUP)], schema=_GROUP)

    return _dealt(spark, _listed(spark, path), "file string, part long, bytes long").mapInArrow(run, _FOOTERS)


def disorder(groups: DataFrame) -> DataFrame:
    """One row: row groups of ``footers`` that begin at or below the end of the one before."""
    before = F.lag("last").over(Window.orderBy("part", "file", "row_group"))  # a row for each row group
    return groups.select((F.col("first") <= before).alias("wrong")).agg(F.coalesce(F.sum(F.col("wrong").cast("long")), F.lit(0)).alias("faults"))


def summary(groups: DataFrame, most: int) -> DataFrame:
    """(key, weight): at most ``most`` keys, ascending, each the first of neighbouring row groups and weighing their rows."""
    n = groups.count()
    place = F.row_number().over(Window.orderBy("part", "file", "row_group")) - 1
    together = groups.withColumn("place", F.floor(place / F.lit(max(1, -(-n // most)))))
    return together.groupBy("place").agg(F.min("first").alias("key"), F.sum("rows").alias("weight")).orderBy("key").select("key", "weight")


def sizes(groups: DataFrame) -> DataFrame:
    """One row: rows, files, bytes of keys, of everything else (headers, footers), and all bytes for a row."""
    files = groups.groupBy("file").agg(F.sum("rows").alias("rows"), F.sum("key_bytes").alias("keys"), F.first("file_bytes").alias("bytes"))
    found = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("keys"), F.lit(0)).alias("key_bytes"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return found.select("rows", "files", "key_bytes", (F.col("bytes") - F.col("key_bytes")).alias("other_bytes"), F.when(F.col("rows") > 0, F.col("bytes") / F.col("rows")).alias("bytes_per_row"))


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def key_differences(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(key, side) of keys that one of two folders of ascending files holds and the other doesn't; no key is shuffled.

    The left files' first keys cut the line into ranges.  A task takes a range:
    its left file, and of the right files those row groups whose bounds meet
    it, one after another.
    """
    bounds = [f.groupBy("part", "file").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("part", "file").collect() for f in (footers(spark, left), footers(spark, right))]
    mine, other = ([(r["file"], r["first"], r["last"]) for r in side] for side in bounds)  # a row for each file
    mine = mine or [(None, _LEAST, _MOST)]
    tasks = []
    for k, (file, first, _) in enumerate(mine):
        low = first if k else _LEAST
        high = mine[k + 1][1] - 1 if k + 1 < len(mine) else _MOST
        tasks.append((file, low, high, [f for f, a, b in other if a <= high and b >= low]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, low, high, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.concatenate([np.empty(0, np.int64), *(k for k in _groups(file, _LEAST, _MOST))]) if file else np.empty(0, np.int64)
                seen = np.zeros(len(keys), bool)
                for name in others:
                    for found in _groups(name, low, high):
                        at = np.searchsorted(keys, found)
                        held = at < len(keys)
                        held[held] = keys[at[held]] == found[held]
                        seen[at[held]] = True
                        yield _sided(found[~held], "right")
                yield _sided(keys[~seen], "left")

    return _dealt(spark, tasks, "file string, low long, high long, others array<string>").mapInArrow(run, "key long, side string")


def _groups(file: str, low: int, high: int) -> Iterator[np.ndarray]:
    """Keys from low to high of the row groups of a file that may hold any, group by group."""
    fs, at = opened(file)
    with fs.open_input_file(at) as f:
        source = pq.ParquetFile(f)
        for k in range(source.metadata.num_row_groups):
            s = source.metadata.row_group(k).column(0).statistics
            if source.metadata.row_group(k).num_rows and s.min <= high and s.max >= low:
                keys = source.read_row_group(k).column(0).to_numpy()
                yield keys[(keys >= low) & (keys <= high)]


def _sided(keys: np.ndarray, side: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([side] * len(keys), pa.string())], names=["key", "side"])
