"""Rounds on disk: a Parquet folder for each, and a manifest with count and key sample beside it."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..boards import BOARDS
from ..functions.ranks import Ranks, with_state
from .checksum import crc32c
from .files import Files
from .footers import footers, part_of

_ROUND = re.compile(r"[1-9][0-9]*")
LARGEST_ROUND = 2**31 - 1
SAMPLE = 4096
LARGEST_MANIFEST = 1 << 20
#: Rows of a row group, at least; smaller ones would be mostly headers.
LEAST_GROUP = 1024


class ManifestError(ValueError):
    """A manifest that is there but can't be right."""


@dataclass(frozen=True)
class Manifest:
    """What is known of a finished round without reading it; the weights of the sampled keys sum to the count.

    stride: every so many keys were sampled in order, each standing for as many
    (the last for what is left); 0 where each key's weight is its own.
    population, parity: of all states, where their ranks in this class are what
    the files hold; else None.
    """

    bits: int
    count: int
    keys: list[int] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)
    stride: int = 0
    population: int | None = None
    parity: int | None = None

    def check(self) -> Manifest:
        if not 1 <= self.bits <= 63 or self.count < 0:
            raise ManifestError(f"{self.bits} bits, {self.count} states")
        if len(self.keys) != len(self.weights) or len(self.keys) > SAMPLE:
            raise ManifestError(f"{len(self.keys)} sampled keys and {len(self.weights)} weights")
        if any(b <= a for a, b in zip(self.keys, self.keys[1:], strict=False)):
            raise ManifestError("sampled keys don't increase")
        if any(k < 0 or k >> self.bits for k in self.keys):
            raise ManifestError("a sampled key has bits above the board")
        if any(w <= 0 for w in self.weights) or sum(self.weights) != self.count:
            raise ManifestError("weights aren't positive or don't sum to the count")
        if self.stride:
            if self.stride < 0 or self.stride & (self.stride - 1):
                raise ManifestError(f"a stride of {self.stride}")
            if len(self.keys) != -(-self.count // self.stride) or any(w != self.stride for w in self.weights[:-1]):
                raise ManifestError(f"{len(self.keys)} keys of {self.count} aren't every {self.stride}th")
        if (self.population is None) != (self.parity is None):
            raise ManifestError("population and parity belong together")
        if self.population is not None and (not 0 <= self.population <= self.bits or not 0 <= self.parity < 16 or any(k.bit_count() != self.population for k in self.keys)):
            raise ManifestError(f"no class: population {self.population}, parity {self.parity}")
        return self

    def dump(self) -> bytes:
        body = json.dumps(asdict(self.check()), sort_keys=True)
        return json.dumps({"version": 3, "crc32c": crc32c(body.encode()), "body": body}).encode()

    @staticmethod
    def load(data: bytes, bits: int) -> Manifest:
        if len(data) > LARGEST_MANIFEST:
            raise ManifestError(f"{len(data)} bytes")
        try:
            outer = json.loads(data)
            body = outer["body"]
            # version 2 had no strides and another checksum
            known = zlib.crc32(body.encode()) == outer["crc"] if outer["version"] == 2 else outer["version"] == 3 and crc32c(body.encode()) == outer["crc32c"]
            if not known:
                raise ManifestError("version or checksum differ")
            found = Manifest(**json.loads(body))
        except (ValueError, KeyError, TypeError) as e:
            raise e if isinstance(e, ManifestError) else ManifestError(str(e)) from e
        if found.bits != bits:
            raise ManifestError(f"made for {found.bits} bits, not {bits}")
        return found.check()


def numbered(files: DataFrame) -> DataFrame:
    """(state, ordinal) of a folder of files that RoundStore.write made: places in key order, from the files' order and row counts alone."""
    rows = files.select("state", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    # a row for each file
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(_part("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("file").alias("f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(offsets), F.col("file") == F.col("f")).select("state", (F.col("place") + F.col("before")).alias("ordinal"))


def _part(file: str):
    return F.regexp_extract(file, r"part-([0-9]+)", 1).cast("long")


def _placed(files: DataFrame) -> DataFrame:
    """(state, file, place): a row takes a digest of its file's name along; the name would be many times longer than the state."""
    return files.select("state", F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))


def order_faults(files: DataFrame) -> tuple[int, int]:
    """(rows, neighbours that don't increase) of a round's files, read in order without moving a state.

    Each stretch of a file that a task reads gives its ends and its faults; the
    stretches, about one for each task, are then compared in order.
    """

    def run(batches):
        held = None  # file, first place, first state, last state, rows, faults
        for batch in batches:
            states, names, places = (c.to_numpy() for c in batch.columns)
            for start, stop in _runs(names, places):
                faults = int((np.diff(states[start:stop]) <= 0).sum())
                if held and held[0] == names[start] and held[1] + held[4] == places[start]:
                    faults += int(states[start] <= held[3])
                    held = (*held[:3], int(states[stop - 1]), held[4] + stop - start, held[5] + faults)
                    continue
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(_STRETCH.names, held, strict=True))], _STRETCH)
                held = int(names[start]), int(places[start]), int(states[start]), int(states[stop - 1]), stop - start, faults
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(_STRETCH.names, held, strict=True))], _STRETCH)

    named = files.sparkSession.createDataFrame([(path.rsplit("/", 1)[-1],) for path in files.inputFiles()], "name string")
    stretches = _placed(files).mapInArrow(run, "file long, place long, first long, last long, n long, faults long")
    stretches = stretches.join(F.broadcast(named.withColumn("file", F.xxhash64("name"))), "file", "left")
    last = F.lag("last").over(Window.orderBy(_part("name"), "name", "place"))
    found = stretches.withColumn("before", last).agg(F.sum("n"), F.sum(F.col("faults") + F.coalesce((F.col("first") <= F.col("before")).cast("long"), F.lit(0)))).first()
    return found[0] or 0, found[1] or 0


_STRETCH = pa.schema([(c, pa.int64()) for c in ("file", "place", "first", "last", "n", "faults")])


def _runs(names: np.ndarray, places: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of neighbouring rows of one file."""
    cuts = [0, *(np.flatnonzero((np.diff(names) != 0) | (np.diff(places) != 1)) + 1).tolist(), len(names)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _bits_of(data: bytes) -> int:
    """The width that a manifest says it is for; load() checks the rest."""
    try:
        return int(json.loads(json.loads(data)["body"])["bits"])
    except (ValueError, KeyError, TypeError) as e:
        raise ManifestError(str(e)) from e


class RoundStore:
    """A folder of rounds: N holds a finished one, N.in-progress one that is being written, N.manifest what is known of it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def completed(self) -> list[int]:
        """Numbers of the finished rounds, ascending; other files and folders are ignored."""
        found = [int(name) for name, folder, _ in self.files.names() if folder and _ROUND.fullmatch(name)]
        return sorted(n for n in found if n <= LARGEST_ROUND)

    def latest(self) -> int | None:
        return max(self.completed(), default=None)

    def stored(self, number: int) -> DataFrame:
        """The folder's one column as it is: states, or ranks under the same name."""
        return self._opened(self.files.at(str(number)))

    def _opened(self, path: str) -> DataFrame:
        return self.spark.read.schema("state long").parquet(path)

    def read(self, number: int, bits: int | None = None) -> DataFrame:
        """(state) in no order; bits: what the manifest must be for, if there is one."""
        found = self.manifest(number, bits)
        return self.stored(number) if found is None else self.decoded(self.stored(number), found)

    def decoded(self, stored: DataFrame, manifest: Manifest) -> DataFrame:
        if manifest.population is None:
            return stored
        ranked = stored.select(F.lit(manifest.population).cast("long").alias("population"), F.lit(manifest.parity).cast("long").alias("parity"), F.col("state").alias("rank"))
        return with_state(ranked, self._ranks(manifest.bits)).select("state")

    def _ranks(self, bits: int) -> Ranks:
        sizes = {b.size: b for b in BOARDS.values()}
        if bits not in sizes:
            raise ManifestError(f"no board has {bits} holes")
        return Ranks.of(sizes[bits])

    def stream(self, number: int, bits: int | None = None) -> Iterator[int]:
        """All states, ascending, file by file; the driver holds a partition of a file at a time."""
        manifest = self.manifest(number, bits)
        names = sorted((name for name, folder, _ in self.files.names(str(number)) if name.endswith(".parquet")), key=lambda n: (part_of(n), n))
        for name in names:
            df = self._opened(f"{self.files.at(str(number))}/{name}")
            for row in (self.decoded(df, manifest) if manifest else df).toLocalIterator():
                yield row["state"]

    def manifest(self, number: int, bits: int | None = None) -> Manifest | None:
        """None if it is missing, in which case it may be rebuilt; a malformed one is an error."""
        name = f"{number}.manifest"
        if not self.files.exists(name):
            return None
        data = self.files.read(name)
        return Manifest.load(data, bits if bits is not None else _bits_of(data))

    def write(self, number: int, states: DataFrame, partitions: int) -> DataFrame:
        """Write distinct states in ascending ranges to the round's folder in progress; the table read back."""
        ordered = states.select("state").repartitionByRange(partitions, "state").sortWithinPartitions("state")
        return self.write_ranges(number, ordered)

    def write_ranges(self, number: int, ordered: DataFrame, group: int = LEAST_GROUP, ranks: bool = False) -> DataFrame:
        """The same of states, or ranks, whose partitions are ascending ranges already; ``group``: rows of a row group."""
        name = f"{number}.in-progress"
        self.files.delete(name)
        writer = ordered.write.option("compression", "zstd").option("parquet.block.row.count.limit", max(LEAST_GROUP, group)).option("parquet.enable.dictionary", "false")
        # neighbouring ranks are near each other and stored as differences; those of states have too many bits for that to help
        writer.option("parquet.writer.version", "PARQUET_2_0" if ranks else "PARQUET_1_0").parquet(self.files.at(name))
        return self._opened(self.files.at(name))

    def summary(self, number: int, finished: bool = True) -> tuple[list[int], list[int]]:
        """At most SAMPLE stored numbers, ascending, and what each stands for, from the files' footers."""
        found = footers(self.spark, self.files.at(str(number) if finished else f"{number}.in-progress"))
        # row groups grow with a round: there are about as many as samples, and one more for each file
        groups = sorted((r["part"], r["file"], r["row_group"], r["first"], r["rows"]) for r in found.select("part", "file", "row_group", "first", "rows").collect())
        together = max(1, -(-len(groups) // SAMPLE))
        starts = range(0, len(groups), together)
        return [groups[k][3] for k in starts], [sum(g[4] for g in groups[k : k + together]) for k in starts]

    def publish(self, number: int, manifest: Manifest) -> None:
        """The manifest first, then the folder's rename, which makes the round visible."""
        self.files.write(f"{number}.manifest", manifest.dump())
        self.files.rename(f"{number}.in-progress", str(number))

    def bytes(self, number: int) -> int:
        return self.files.size(str(number))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, files, bytes) of what a folder holds, below it too."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return found.groupBy(suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
