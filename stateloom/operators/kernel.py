"""Expansion of states: every legal jump of every state, reduced to canonical children.

``children`` is the definition as a join with the board's jumps; ``expand`` is
the same in Arrow batches and is what rounds use.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..boards import Board
from ..functions import bitboard


def holes_table(spark: SparkSession, board: Board) -> DataFrame:
    return spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(board.holes)], "bit int, row int, col int")


def jumps_table(spark: SparkSession, board: Board) -> DataFrame:
    """A row for each jump: its masks, and the changed mask under each symmetry."""
    rows = [(i, o, d, c, *(board.transform(c, t) for t in range(8))) for i, (o, d, c) in enumerate(board.jumps)]
    return spark.createDataFrame(rows, "jump int, occupied long, target long, changed long, " + ", ".join(f"m{t} long" for t in range(8)))


def successors(states: DataFrame, board: Board) -> DataFrame:
    """(state, jump, child) of every legal jump, with repetitions.  The jumps, at most 124 rows, are broadcast."""
    jumps = F.broadcast(jumps_table(states.sparkSession, board).select("jump", "occupied", "target", "changed"))
    joined = states.select("state").join(jumps, bitboard.is_legal(F.col("state"), F.col("occupied"), F.col("target")))
    return joined.select("state", "jump", F.col("state").bitwiseXOR(F.col("changed")).alias("child"))


def children(states: DataFrame, board: Board) -> DataFrame:
    """(state, child) with canonical children: the parent's images are made once, each child's by one XOR."""
    images = states.select("state", *(c.alias(f"t{t}") for t, c in enumerate(bitboard.transforms(F.col("state"), board))))
    jumps = F.broadcast(jumps_table(states.sparkSession, board).drop("changed", "jump"))
    joined = images.join(jumps, bitboard.is_legal(F.col("state"), F.col("occupied"), F.col("target")))
    return joined.select("state", F.least(*(F.col(f"t{t}").bitwiseXOR(F.col(f"m{t}")) for t in range(8))).alias("child"))


def check_board(board: Board) -> None:
    """Jumps must be two neighbours on the board and a third hole, and the symmetries must map holes and jumps to each other."""
    jumps = {(occupied, target) for occupied, target, _ in board.jumps}
    for occupied, target, changed in board.jumps:
        if occupied.bit_count() != 2 or target.bit_count() != 1 or occupied & target or (occupied | target) & ~board.full:
            raise ValueError(f"no jump: {occupied:#x} to {target:#x}")
        if changed != occupied | target:
            raise ValueError(f"a jump of {occupied:#x} to {target:#x} can't change {changed:#x}")
    for t in range(8):
        if sorted(board.transform(1 << k, t) for k in range(board.size)) != [1 << k for k in range(board.size)]:
            raise ValueError(f"symmetry {t} isn't a permutation of the holes")
        if {(board.transform(o, t), board.transform(e, t)) for o, e in jumps} != jumps:
            raise ValueError(f"symmetry {t} doesn't keep the jumps")


#: The cells that children are cut into, by the highest bits of their mixed states: 8192.
CELL_BITS = 13
#: States that a merge gives at once, at least but for the last.
GIVEN = 1 << 16


class Kernel:
    """Tables for numpy: images of each byte of a state under each symmetry, and the jumps' masks."""

    def __init__(self, board: Board):
        if board.size > 63:
            raise ValueError("a state has at most 63 holes")
        check_board(board)
        self.full = np.int64(board.full)
        n_bytes = -(-board.size // 8)
        self.tables = np.zeros((8, n_bytes, 256), np.int64)
        values = np.arange(256)
        for t in range(8):
            for source, target in enumerate(board.permutations[t]):
                self.tables[t, source // 8] |= (values >> source % 8 & 1) << target
        self.jumps = np.array(board.jumps, np.int64)
        self.changed = np.array([[board.transform(c, t) for t in range(8)] for _, _, c in board.jumps], np.int64)

    def images(self, states: np.ndarray) -> np.ndarray:
        out = np.zeros((8, len(states)), np.int64)
        for k in range(self.tables.shape[1]):
            part = (states >> (8 * k)) & 255
            for t in range(8):
                out[t] |= self.tables[t, k, part]
        return out

    def expand(self, states: np.ndarray, owners: bool = False):
        """Canonical children of all states, with repetitions; with owners also the place of each one's parent."""
        if len(states) and (states & ~self.full).any():
            raise ValueError("a state has pegs outside of the board")
        images = self.images(states)
        out, parents = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for (occupied, target, _), changed in zip(self.jumps, self.changed, strict=True):
            legal = np.flatnonzero((states & (occupied | target)) == occupied)
            if len(legal):
                out.append((images[:, legal] ^ changed[:, None]).min(0))
                parents.append(legal)
        return (np.concatenate(out), np.concatenate(parents)) if owners else np.concatenate(out)


@lru_cache
def kernel_of(board: Board) -> Kernel:
    """The board's kernel, made once in a process."""
    return Kernel(board)


def grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[np.ndarray]:
    """First columns of batches, ``rows`` values or a little less at a time; Arrow's batches are smaller than what is worth expanding at once."""
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.column(0).slice(start, rows).to_numpy(zero_copy_only=False)
            if held and n + len(part) > rows:
                yield np.concatenate(held)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if held:
        yield np.concatenate(held)


def expand(states: DataFrame, board: Board, rows: int = 65536) -> DataFrame:
    """(state, moves): canonical children, once for every ``rows`` states of a task, and how many jumps of these lead there."""
    kernel = kernel_of(board)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parents in grouped(batches, rows):
            unique, counts = np.unique(kernel.expand(parents), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(counts.astype(np.int64))], names=["state", "moves"])

    return states.select("state").mapInArrow(run, "state long, moves long")


class Mixing:
    """A bijection of a board's states that spreads them evenly over their width, and its inverse."""

    #: An odd number, so that products with it modulo a power of two can be undone.
    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        # folding the upper half, or less, into the lower undoes itself
        self.fold, self.low = np.uint64(-(-bits // 2)), np.uint64(max(0, bits - CELL_BITS))
        self.factor, self.inverse = np.uint64(self.FACTOR), np.uint64(pow(self.FACTOR, -1, 1 << 64))

    def mix(self, states: np.ndarray) -> np.ndarray:
        x = states.astype(np.uint64)
        x = (x ^ x >> self.fold) * self.factor & self.mask
        return (x ^ x >> self.fold) * self.factor & self.mask

    def unmix(self, mixed: np.ndarray) -> np.ndarray:
        x = mixed * self.inverse & self.mask
        x = (x ^ x >> self.fold) * self.inverse & self.mask
        return (x ^ x >> self.fold).astype(np.int64)

    def cells(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> self.low).astype(np.int32)


def packed(mixed: np.ndarray, mixing: Mixing) -> pa.RecordBatch:
    """(cell, width, steps): ascending mixed states, a row for each cell; a state is its distance from the one before it, the first from the cell's start, in as many bytes as the longest needs."""
    cells = mixing.cells(mixed)
    starts = np.flatnonzero(np.diff(cells, prepend=-1))
    steps = np.diff(mixed, prepend=np.uint64(0))
    steps[starts] = mixed[starts] - (cells[starts].astype(np.uint64) << mixing.low)
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    data = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    offsets = pa.py_buffer((np.append(starts, len(mixed)) * width).astype(np.int32))
    rows = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(cells[starts]), pa.array(np.full(len(starts), width, np.int32)), rows], names=["cell", "width", "steps"])


def unpacked(cell: int, blocks: dict[int, list[bytes]], mixing: Mixing) -> np.ndarray:
    """Mixed states of a cell's blocks, listed by width, in no order."""
    out = []
    for width, parts in blocks.items():
        ends = np.cumsum([len(p) // width for p in parts])
        raw = np.zeros((ends[-1], 8), np.uint8)
        raw[:, :width] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
        run = np.cumsum(raw.view("<u8").ravel(), dtype=np.uint64)
        before = np.concatenate((np.zeros(1, np.uint64), run[ends[:-1] - 1]))
        out.append(run - np.repeat(before, np.diff(ends, prepend=0)))
    return np.concatenate(out) + (np.uint64(cell) << mixing.low)


def _merged(states: DataFrame, make, bits: int, rows: int) -> DataFrame:
    """(state, moves): what ``make`` makes of ``rows`` states at a time, each once, and how often it was made; null states make nothing.

    What a group makes is sorted and shuffled as a block for each cell, a few
    bytes a state, with repetitions; a cell's blocks are then merged at once.
    A cell holds about one in 8192 of all states, so there is no hash table,
    and no task holds more than a group, a cell and the rows that Spark sorts.
    """
    mixing = Mixing(bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, rows):
            mixed = mixing.mix(make(group))
            mixed.sort()
            if len(mixed):
                yield packed(mixed, mixing)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for cell, blocks in _by_cell(batches):
            held.append(np.unique(unpacked(cell, blocks, mixing), return_counts=True))
            n += len(held[-1][0])
            if n >= GIVEN:
                yield given(held)
                held, n = [], 0
        if held:
            yield given(held)

    def given(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        unique, counts = (np.concatenate(part) for part in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(mixing.unmix(unique)), pa.array(counts.astype(np.int64))], names=["state", "moves"])

    blocks = states.select("state").where(F.col("state").isNotNull()).mapInArrow(cut, "cell int, width int, steps binary")
    return blocks.repartition("cell").sortWithinPartitions("cell").mapInArrow(merge, "state long, moves long")


def distinct(states: DataFrame, bits: int, rows: int = 1 << 18) -> DataFrame:
    """(state): each state of so many bits once."""
    return _merged(states, lambda group: group, bits, rows).select("state")


def step(states: DataFrame, board: Board, rows: int = 1 << 18) -> DataFrame:
    """(state, moves): the next round, each state once, with the number of jumps that lead to it."""
    return _merged(states, kernel_of(board).expand, board.size, rows)


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Each cell of rows that come in order of their cells, and its blocks by width."""
    held: dict[int, list[bytes]] = {}
    last = None
    for batch in batches:
        for cell, width, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if cell != last and held:
                yield last, held
                held = {}
            last = cell
            held.setdefault(width, []).append(steps)
    if held:
        yield last, held
