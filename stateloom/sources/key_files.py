"""Files of big-endian 64-bit keys, ascending without repetitions, as a Spark data source with reader and writer.

    register(spark)
    spark.read.format("key-files").option("bits", 33).load(folder)        # key BIGINT
    write_key_files(keys, folder, ranges=8)

Reading splits large files; each split is checked with the key before it.
Each task that writes makes a file under another name; the driver gives the
files their names, in order of their keys, once all are there.  A folder that
holds keys already is never written to, and what a failed write leaves is
removed.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .footers import opened

FORMAT = "key-files"
SUFFIX = ".longs"
#: Keys of a split, and of a batch.
SPLIT = 8 << 20
BATCH = 1 << 16


@dataclass
class Stretch(InputPartition):
    path: str
    first: int
    keys: int


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    first: int
    last: int
    keys: int


def _files(path: str) -> list[pa.fs.FileInfo]:
    """A key file itself, or those of a folder by name."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.File:
        return [info]
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted((f for f in fs.get_file_info(pa.fs.FileSelector(at)) if f.type == pa.fs.FileType.File and f.base_name.endswith(SUFFIX)), key=lambda f: f.base_name)


class KeyReader(DataSourceReader):
    def __init__(self, path: str, bits: int | None, pegs: int | None):
        self.path, self.bits, self.pegs = path, bits, pegs

    def partitions(self) -> list[Stretch]:
        out = []
        for f in _files(self.path):
            if f.size % 8:
                raise ValueError(f"{f.path}: {f.size} bytes aren't whole keys")
            out += [Stretch(f.path, k, min(SPLIT, f.size // 8 - k)) for k in range(0, f.size // 8, SPLIT)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return  # a folder without keys
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.path) as f:
            before = None
            if partition.first:
                before = int(np.frombuffer(f.read_at(8, 8 * (partition.first - 1)), ">i8")[0])
            for start in range(partition.first, partition.first + partition.keys, BATCH):
                n = min(BATCH, partition.first + partition.keys - start)
                keys = np.frombuffer(f.read_at(8 * n, 8 * start), ">i8").astype(np.int64)
                self._check(partition.path, keys, before)
                before = int(keys[-1])
                yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    def _check(self, path: str, keys: np.ndarray, before: int | None) -> None:
        if (np.diff(keys) <= 0).any() or before is not None and keys[0] <= before:
            raise ValueError(f"{path}: keys don't increase")
        if self.bits is not None and (keys[0] < 0 or int(keys[-1]) >> self.bits):
            raise ValueError(f"{path}: a key has more than {self.bits} bits")
        if self.pegs is not None and (np.bitwise_count(keys.view(np.uint64)) != self.pegs).any():
            raise ValueError(f"{path}: a key doesn't have {self.pegs} bits set")


class KeyWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.pending = path, posixpath.join(path, f"_pending-{uuid.uuid4().hex}")
        fs, at = opened(path)
        if fs.get_file_info(at).type != pa.fs.FileType.NotFound and _files(path):
            raise FileExistsError(f"{path} holds keys")
        fs.create_dir(opened(self.pending)[1])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = opened(self.pending)
        name, count, first, last = posixpath.join(folder, uuid.uuid4().hex), 0, 0, 0
        with fs.open_output_stream(name) as f:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if batch.column(0).null_count:
                    raise ValueError("a key is null")
                keys = batch.column(0).to_numpy()
                if (np.diff(keys) <= 0).any() or count and keys[0] <= last:
                    raise ValueError("keys of a task don't increase")
                first = first if count else int(keys[0])
                count, last = count + len(keys), int(keys[-1])
                f.write(keys.astype(">i8").tobytes())
        return Written(name, first, last, count)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = opened(self.path)
        made = sorted((m for m in messages if m is not None and m.keys), key=lambda m: m.first)
        for a, b in zip(made, made[1:], strict=False):
            if b.first <= a.last:
                self.abort(messages)
                raise ValueError("files of keys overlap; deal the keys in ranges")
        for k, m in enumerate(made):
            target = posixpath.join(folder, f"part-{k:05d}{SUFFIX}")
            if fs.get_file_info(target).type != pa.fs.FileType.NotFound:
                raise FileExistsError(target)
            fs.move(m.path, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing stays but finished files; tasks that ran twice leave theirs here too."""
        fs, folder = opened(self.pending)
        if fs.get_file_info(folder).type != pa.fs.FileType.NotFound:
            fs.delete_dir(folder)


class KeyFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key long"

    def _number(self, option: str) -> int | None:
        found = self.options.get(option)
        return None if found is None else int(found)

    def reader(self, schema) -> KeyReader:
        return KeyReader(self.options["path"], self._number("bits"), self._number("pegs"))

    def writer(self, schema, overwrite: bool) -> KeyWriter:
        if overwrite:
            raise ValueError("key files are never overwritten")
        if [f.dataType.simpleString() for f in schema.fields] != ["bigint"]:
            raise ValueError("key files have one BIGINT column")
        return KeyWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KeyFiles)


def write_key_files(keys: DataFrame, path: str, ranges: int, key: str = "key") -> None:
    """Write distinct keys in ``ranges`` ascending files."""
    register(keys.sparkSession)
    dealt = keys.select(key).repartitionByRange(ranges, key).sortWithinPartitions(key)
    dealt.write.format(FORMAT).mode("append").save(path)


def read_key_files(spark: SparkSession, path: str, bits: int | None = None, pegs: int | None = None) -> DataFrame:
    """(key): bits, pegs: the width that keys must keep to and the number of bits that each must have set."""
    register(spark)
    options = {name: value for name, value in (("bits", bits), ("pegs", pegs)) if value is not None}
    return spark.read.format(FORMAT).options(**options).load(path)
