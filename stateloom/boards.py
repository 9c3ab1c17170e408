"""Boards of single-player jump puzzles: holes, bit numbers, jumps, symmetries, invariants."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

#: Shapes, a row of text for each row of holes.
SHAPES = {
    "cross33": ("..ooo..", "..ooo..", "ooooooo", "ooooooo", "ooooooo", "..ooo..", "..ooo.."),
    "cross37": ("..ooo..", ".ooooo.", "ooooooo", "ooooooo", "ooooooo", ".ooooo.", "..ooo.."),
    "cross49": ("...ooo...", "...ooo...", "..ooooo..", "ooooooooo", "ooooooooo", "ooooooooo", "..ooooo..", "...ooo...", "...ooo..."),
}


def curve_position(side: int, x: int, y: int) -> int:
    """Place of a cell on the Hilbert curve over a square whose side is a power of two."""
    place, half = 0, side // 2
    while half:
        right, lower = int(bool(x & half)), int(bool(y & half))
        place += half * half * ((3 * right) ^ lower)
        if not lower:
            if right:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        half //= 2
    return place


#: Images of a cell (row, col) under the eight symmetries of a square with last index m.
SYMMETRIES = (
    lambda r, c, m: (r, c),
    lambda r, c, m: (c, m - r),
    lambda r, c, m: (m - r, m - c),
    lambda r, c, m: (m - c, r),
    lambda r, c, m: (r, m - c),
    lambda r, c, m: (m - r, c),
    lambda r, c, m: (c, r),
    lambda r, c, m: (m - c, m - r),
)


@dataclass(frozen=True)
class Board:
    """A board whose states are integers with one bit for each hole; a set bit is a peg."""

    name: str
    shape: tuple[str, ...]

    @cached_property
    def holes(self) -> tuple[tuple[int, int], ...]:
        """(row, col) in order of the bit numbers, which follow a Hilbert curve."""
        n = len(self.shape)
        side = 1 << (n - 1).bit_length()
        cells = [(r, c) for r in range(n) for c in range(n) if self.shape[r][c] == "o"]
        return tuple(sorted(cells, key=lambda rc: curve_position(side, rc[1], rc[0])))

    @cached_property
    def bits(self) -> dict[tuple[int, int], int]:
        return {cell: i for i, cell in enumerate(self.holes)}

    @property
    def size(self) -> int:
        return len(self.holes)

    @property
    def full(self) -> int:
        return (1 << self.size) - 1

    @property
    def start(self) -> int:
        """All pegs but the central one."""
        middle = len(self.shape) // 2
        return self.full & ~(1 << self.bits[middle, middle])

    def bit_at(self, row: int, col: int) -> int:
        return self.bits.get((row, col), -1)

    @cached_property
    def permutations(self) -> tuple[tuple[int, ...], ...]:
        """For each symmetry, the bit that each bit moves to."""
        last = len(self.shape) - 1
        return tuple(tuple(self.bits[move(r, c, last)] for r, c in self.holes) for move in SYMMETRIES)

    def transform(self, state: int, t: int) -> int:
        out = 0
        for source, target in enumerate(self.permutations[t]):
            if state >> source & 1:
                out |= 1 << target
        return out

    def canonical(self, state: int) -> int:
        return min(self.transform(state, t) for t in range(8))

    @cached_property
    def jumps(self) -> tuple[tuple[int, int, int], ...]:
        """(occupied, empty, changed) masks of every jump: from and over hold pegs, the target doesn't."""
        out = []
        for r, c in self.holes:
            for dr, dc in ((-1, 0), (0, 1), (1, 0), (0, -1)):
                over, target = self.bit_at(r + dr, c + dc), self.bit_at(r + 2 * dr, c + 2 * dc)
                if over >= 0 and target >= 0:
                    occupied = 1 << self.bits[r, c] | 1 << over
                    out.append((occupied, 1 << target, occupied | 1 << target))
        return tuple(out)

    def successors(self, state: int) -> list[int]:
        """Children of one state, with repetitions, not canonical."""
        return [state ^ changed for occupied, target, changed in self.jumps if state & occupied == occupied and not state & target]

    @cached_property
    def parity_masks(self) -> tuple[int, int, int, int]:
        """Holes that lack one of the first two colours of both diagonal colourings; jumps keep these parities."""
        of = lambda colour, keep: sum(1 << i for i, (r, c) in enumerate(self.holes) if colour(r, c) % 3 != keep)
        return tuple(of(colour, keep) for colour in (lambda r, c: r + c, lambda r, c: r - c) for keep in (0, 1))

    def syndrome(self, state: int) -> int:
        return sum(((state & mask).bit_count() & 1) << i for i, mask in enumerate(self.parity_masks))


BOARDS = {name: Board(name, shape) for name, shape in SHAPES.items()}


def board(name: str) -> Board:
    """A board by its name, in any case."""
    found = BOARDS.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown board {name!r}; there are {', '.join(BOARDS)}")
    return found
