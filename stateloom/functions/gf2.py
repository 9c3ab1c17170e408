"""Parities of states as a vector space over two elements: what no jump changes, and what symmetries make of it.

A board's parity masks span a space of 16 sets of holes.  The symmetries map
that space to itself, so the parities of a state's image follow from the
parities of the state alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..boards import Board


@dataclass(frozen=True)
class Basis:
    """Vectors (whole numbers) with distinct highest bits, and which of the given ones sum to each."""

    vectors: tuple[int, ...]
    made_of: tuple[int, ...]

    @staticmethod
    def of(given: Sequence[int]) -> Basis:
        """Gaussian elimination; given vectors that others sum to leave nothing."""
        found: list[tuple[int, int]] = []
        for k, vector in enumerate(given):
            rest, parts = _reduced(vector, found)
            if rest:
                found = sorted([*found, (rest, parts ^ 1 << k)], reverse=True)
        return Basis(tuple(v for v, _ in found), tuple(p for _, p in found))

    @property
    def rank(self) -> int:
        return len(self.vectors)

    def coordinates(self, vector: int) -> int | None:
        """Bits of the given vectors that sum to this one; None if none do."""
        rest, parts = _reduced(vector, list(zip(self.vectors, self.made_of, strict=True)))
        return None if rest else parts


def _reduced(vector: int, basis: list[tuple[int, int]]) -> tuple[int, int]:
    parts = 0
    for v, p in basis:  # by falling highest bit
        if vector ^ v < vector:
            vector, parts = vector ^ v, parts ^ p
    return vector, parts


def span(given: Sequence[int]) -> dict[int, int]:
    """Each sum of given vectors, with the bits of those that make it; the first such where several do."""
    out: dict[int, int] = {}
    for bits in range(1 << len(given)):
        vector = 0
        for k, v in enumerate(given):
            if bits >> k & 1:
                vector ^= v
        out.setdefault(vector, bits)
    return out


def parity_space(spark: SparkSession, board: Board) -> DataFrame:
    """(combination, mask): the 16 sums of the board's parity masks."""
    return spark.createDataFrame([(bits, mask) for mask, bits in span(board.parity_masks).items()], "combination long, mask long")


def images_outside(board: Board) -> set[int]:
    """Images of the space under the symmetries that aren't in it; there are none."""
    space = span(board.parity_masks)
    return {board.transform(mask, t) for mask in space for t in range(8)} - set(space)


def class_map(board: Board, t: int) -> list[int]:
    """The parities of the image under symmetry t, for each of the 16 that a state can have.

    A parity of the image is that of the state over the mask's preimage, which
    is a sum of masks; so it is the sum of the state's parities over these.
    """
    basis = Basis.of(board.parity_masks)
    back = next(u for u in range(8) if all(board.permutations[u][target] == source for source, target in enumerate(board.permutations[t])))
    parts = [basis.coordinates(board.transform(mask, back)) for mask in board.parity_masks]
    if None in parts:
        raise ValueError(f"symmetry {t} leads out of the parity space of {board.name}")
    return [sum(((s & p).bit_count() & 1) << k for k, p in enumerate(parts)) for s in range(1 << len(parts))]


def image_class(syndrome: Column, board: Board, t: int) -> Column:
    """The parities of a state's image under symmetry t, from those of the state."""
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in class_map(board, t))), (syndrome + 1).cast("int"))
