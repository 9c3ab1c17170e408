"""Routing of children to ranges that are forecast from a sample of their parents, and the merge inside a range."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..boards import Board
from . import keys as key_ops
from .kernel import children, grouped, kernel_of

#: States of a block at most, and states that a merge gathers before it gives what is complete.
BLOCK = 4096
MERGED = 1 << 20


@dataclass(frozen=True)
class Forecast:
    """Boundaries of ranges, ascending (a boundary belongs to the range above it), and how many moves are expected."""

    bounds: np.ndarray
    moves: float


def weighted_cuts(keys: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Of distinct ascending keys those at which the weight before them has passed another even share; at most ``most``."""
    wanted = min(most, max(0, len(keys) - 1))
    before = np.cumsum(weights) - weights
    shares = weights.sum() * np.arange(1, wanted + 1) / (wanted + 1)
    passed = np.searchsorted(shares, before, side="right")
    return keys[passed > np.concatenate(([0], passed[:-1]))] if wanted else keys[:0]


def forecast(board: Board, keys: Sequence[int], weights: Sequence[int], ranges) -> Forecast:
    """Ranges for the children of a round by a sample of its states (at most a few thousand), each standing for its weight.

    ranges: how many there should be for a number of moves.
    """
    parents = np.array(keys, np.int64)
    made, owner = kernel_of(board).expand(parents, owners=True)
    found, inverse = np.unique(made, return_inverse=True)
    mass = np.bincount(inverse, np.array(weights, float)[owner], len(found)) if len(found) else np.empty(0)
    moves = float(mass.sum())
    return Forecast(weighted_cuts(found, mass, ranges(moves) - 1), moves)


def forecast_bounds(sample: DataFrame, board: Board, most: int = key_ops.BOUNDS) -> DataFrame:
    """(bound): the same of a table (state, weight): each child has its parents' weights together."""
    moved = children(sample, board).join(sample, "state").select(F.col("child").alias("key"), "weight")
    return key_ops.weighted_bounds(moved, most=most)


def expand_routed(states: DataFrame, board: Board, bounds: np.ndarray, rows: int) -> DataFrame:
    """(range, first, states, n, moves): canonical children, once for every ``rows`` states of a task, in blocks.

    A block holds ascending states of one range, big enough that the shuffle
    moves few rows and small enough that a merge holds few states; n is their
    number, moves how many jumps lead to them.
    """
    kernel = kernel_of(board)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parents in grouped(batches, rows):
            unique, counts = np.unique(kernel.expand(parents), return_counts=True)
            if not len(unique):
                continue
            # ascending, so the boundaries are looked for among the states
            starts = np.unique(np.concatenate(([0], np.searchsorted(unique, bounds, side="left"), np.arange(0, len(unique), BLOCK))))
            starts = starts[starts < len(unique)]
            sizes = np.diff(starts, append=len(unique))
            data = pa.py_buffer(unique.tobytes())
            blocks = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.append(starts, len(unique)) * 8).astype(np.int32).tobytes()), data])
            place = np.searchsorted(bounds, unique[starts], side="right").astype(np.int32)
            columns = [pa.array(place), pa.array(unique[starts]), blocks, pa.array(sizes), pa.array(np.add.reduceat(counts, starts))]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "first", "states", "n", "moves"])

    return states.select("state").mapInArrow(run, "range int, first long, states binary, n long, moves long")


def in_ranges(routed: DataFrame, ranges: int) -> DataFrame:
    """(state): each state once, ascending in each of the partitions, one for each range.

    The only shuffle of states.  In a range blocks come in order of their first
    states; what lies below the next block's first state can't come again, so
    a merge holds the blocks that overlap and little more.
    """
    dealt = routed.repartitionById(ranges, "range").sortWithinPartitions("first").select("first", "states")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for first, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if n >= MERGED:
                    merged = np.unique(np.concatenate(held))
                    cut = int(np.searchsorted(merged, first, side="left"))
                    yield pa.RecordBatch.from_arrays([pa.array(merged[:cut])], names=["state"])
                    held, n = [merged[cut:]], len(merged) - cut
                held.append(np.frombuffer(block.as_buffer(), np.int64))
                n += len(held[-1])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["state"])

    return dealt.mapInArrow(run, "state long")
