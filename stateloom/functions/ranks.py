"""Dense ranks of states inside their class: those with the same number of pegs and the same parities.

The states of a class, ascending, are numbered from 0.  With tables of how
many words of the lowest bits have a given population and given parities, a
state's rank is the sum, over its set bits from the highest on, of the words
that have that bit clear and keep what is still to be placed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from ..boards import Board

_BYTE = 8


class Ranks:
    """Ranks of words of ``bits`` bits by population and the parities of ``masks``."""

    def __init__(self, bits: int, masks: Sequence[int] = ()):
        if not 1 <= bits <= 63 or len(masks) > 8:
            raise ValueError(f"{bits} bits and {len(masks)} masks")
        self.bits, self.masks = bits, tuple(m & ((1 << bits) - 1) for m in masks)
        self.classes = 1 << len(self.masks)

    @staticmethod
    def of(board: Board, parities: bool = True) -> Ranks:
        return Ranks(board.size, board.parity_masks if parities else ())

    def _column(self, bit: int) -> int:
        """What the bit changes in the parities."""
        return sum((m >> bit & 1) << k for k, m in enumerate(self.masks))

    @cached_property
    def counts(self) -> np.ndarray:
        """[i, p, s]: words of the i lowest bits with population p and parities s."""
        out = np.zeros((self.bits + 1, self.bits + 1, self.classes), np.int64)
        out[0, 0, 0] = 1
        for i in range(self.bits):
            out[i + 1] = out[i]
            out[i + 1, 1:] += out[i, :-1][:, np.arange(self.classes) ^ self._column(i)]
        return out

    @cached_property
    def _bytes(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each byte of a word: [p, s, v] words below it with p and s still to place there and in lower bytes; parities of v."""
        made = []
        for low in range(0, self.bits, _BYTE):
            width = min(_BYTE, self.bits - low)
            values = np.arange(1 << width)
            parities = np.zeros(len(values), np.int64)
            for k in range(width):
                parities ^= (values >> k & 1) * self._column(low + k)
            taken = np.bitwise_count(values).astype(np.int64)
            p, s = np.arange(self.bits + 1)[:, None, None], np.arange(self.classes)[None, :, None]
            left = p - taken
            there = np.where(left >= 0, self.counts[low][np.maximum(left, 0), s ^ parities], 0)
            below = np.zeros(there.shape, np.int64)
            np.cumsum(there[:, :, :-1], axis=2, out=below[:, :, 1:])
            made.append((below, parities))
        return made

    def parities(self, states: np.ndarray) -> np.ndarray:
        out = np.zeros(len(states), np.int64)
        for k, mask in enumerate(self.masks):
            out |= (np.bitwise_count(states & np.int64(mask)).astype(np.int64) & 1) << k
        return out

    def rank(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Population, parities and rank of each state."""
        if len(states) and (states < 0).any() or (states >> self.bits).any():
            raise ValueError(f"a state has more than {self.bits} bits")
        population, parity = np.bitwise_count(states).astype(np.int64), self.parities(states)
        p, s, rank = population.copy(), parity.copy(), np.zeros(len(states), np.int64)
        for k in range(len(self._bytes) - 1, -1, -1):
            below, parities = self._bytes[k]
            v = states >> (_BYTE * k) & ((1 << _BYTE) - 1)
            rank += below.take((p * self.classes + s) * below.shape[2] + v)
            p -= np.bitwise_count(v)
            s ^= parities[v]
        return population, parity, rank

    def unrank(self, population: np.ndarray, parity: np.ndarray, rank: np.ndarray) -> np.ndarray:
        if len(rank) and ((rank < 0) | (rank >= self.sizes(population, parity))).any():
            raise ValueError("a rank is beyond its class")
        p, s, rank = (c.astype(np.int64) for c in (population, parity, rank))
        states = np.zeros(len(rank), np.int64)
        for k in range(len(self._bytes) - 1, -1, -1):
            below, parities = self._bytes[k]
            row = (p * self.classes + s) * below.shape[2]
            at = row.copy()
            for step in (1 << j for j in range(below.shape[2].bit_length() - 2, -1, -1)):
                at += (below.take(at + step) <= rank) * step
            rank -= below.take(at)
            v = at - row
            states |= v << (_BYTE * k)
            p = p - np.bitwise_count(v)
            s = s ^ parities[v]
        return states

    def sizes(self, population: np.ndarray, parity: np.ndarray) -> np.ndarray:
        inside = (population >= 0) & (population <= self.bits) & (parity >= 0) & (parity < self.classes)
        return np.where(inside, self.counts[self.bits][np.where(inside, population, 0), np.where(inside, parity, 0)], 0)


def _added(df: DataFrame, names: Sequence[str], make) -> DataFrame:
    """``df`` with BIGINT columns that ``make`` gives for each Arrow batch."""

    def run(batches):
        for batch in batches:
            columns = [pa.array(c) for c in make(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(n, LongType()) for n in names)]))


def with_rank(states: DataFrame, ranks: Ranks, state: str = "state") -> DataFrame:
    """``states`` with population, parity and rank of a BIGINT column without nulls."""
    return _added(states, ["population", "parity", "rank"], lambda b: ranks.rank(b.column(state).to_numpy(zero_copy_only=False)))


def with_state(ranked: DataFrame, ranks: Ranks, name: str = "state") -> DataFrame:
    """``ranked`` (population, parity, rank and others) with the state of each."""

    def make(batch):
        return [ranks.unrank(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("population", "parity", "rank")))]

    return _added(ranked, [name], make)


def class_sizes(ranks: Ranks) -> list[tuple[int, int, int]]:
    """(population, parity, states) of all classes that aren't empty."""
    return [(p, s, int(n)) for p, row in enumerate(ranks.counts[ranks.bits]) for s, n in enumerate(row) if n]

