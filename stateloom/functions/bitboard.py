"""Column expressions on states (BIGINT bit sets) of a board; all run in generated code."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..boards import Board


def _or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def transform(state: Column, board: Board, t: int) -> Column:
    """The state under symmetry ``t``: bits that move equally far move together."""
    moved: dict[int, int] = defaultdict(int)
    for source, target in enumerate(board.permutations[t]):
        moved[target - source] |= 1 << source
    parts = []
    for distance, mask in sorted(moved.items()):
        kept = state.bitwiseAND(F.lit(mask))
        parts.append(F.shiftleft(kept, distance) if distance > 0 else F.shiftright(kept, -distance) if distance < 0 else kept)
    return _or(parts)


def transforms(state: Column, board: Board) -> list[Column]:
    return [state, *(transform(state, board, t) for t in range(1, 8))]


def canonical(state: Column, board: Board) -> Column:
    return F.least(*transforms(state, board))


def population(state: Column) -> Column:
    return F.bit_count(state).cast("long")


def syndrome(state: Column, board: Board) -> Column:
    """Four parities that no jump changes, as one number."""
    return _or([F.shiftleft(F.bit_count(state.bitwiseAND(F.lit(m))).cast("long").bitwiseAND(F.lit(1)), i) for i, m in enumerate(board.parity_masks)])


def is_legal(state: Column, occupied: Column, target: Column) -> Column:
    return (state.bitwiseAND(occupied) == occupied) & (state.bitwiseAND(target) == 0)


def is_valid(state: Column, board: Board) -> Column:
    """Whether no bit above the board's holes is set."""
    return F.shiftrightunsigned(state, board.size) == 0


def encode(occupied: Column) -> Column:
    """State of an ARRAY<BOOLEAN> with one element for each hole."""
    return F.aggregate(F.transform(occupied, lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def decode(state: Column, board: Board) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(board.size - 1)), lambda i: F.getbit(state, i) == 1)


def prefix(state: Column, bits: int, kept: int = 25) -> Column:
    """The highest ``kept`` of ``bits`` bits."""
    return F.shiftrightunsigned(state, max(0, bits - kept))


def shard(key: Column, bounds: list[int]) -> Column:
    """Number of ascending boundaries that don't exceed the key, by binary search: about log2 of their number comparisons."""
    if any(b <= a for a, b in zip(bounds, bounds[1:], strict=False)):
        raise ValueError("boundaries don't increase")

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key >= F.lit(bounds[middle]).cast("long"), within(middle + 1, high)).otherwise(within(low, middle))

    return within(0, len(bounds))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _times(v: Column, factor: int) -> Column:
    """Product modulo 2 ** 64; every partial result stays below 2 ** 51, as ANSI arithmetic doesn't wrap."""
    half, quarter = F.lit(0xFFFFFFFF), F.lit(0xFFFF)
    f = [factor >> 16 * k & 0xFFFF for k in range(4)]
    low, high = v.bitwiseAND(half), F.shiftrightunsigned(v, 32)
    p0, p1 = low * f[0], low * f[1]
    lower = p0.bitwiseAND(half) + F.shiftleft(p1.bitwiseAND(quarter), 16)
    upper = F.shiftright(p0, 32) + F.shiftright(p1, 16) + F.shiftright(lower, 32)
    upper = upper + high * f[0] + F.shiftleft((high * f[1]).bitwiseAND(quarter), 16)
    upper = upper + low * f[2] + F.shiftleft((low * f[3]).bitwiseAND(quarter), 16)
    return F.shiftleft(upper.bitwiseAND(half), 32).bitwiseOR(lower.bitwiseAND(half))


def _multiplier(factor: int):
    return lambda v: _times(v, factor)


def mix64(key: Column) -> Column:
    """A 64-bit finaliser: shifts by 33 around two multiplications."""
    fold = lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 33))
    # fixed values of the finaliser
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        key = _let(_let(key, fold), _multiplier(factor))
    return _let(key, fold)
