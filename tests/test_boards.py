import random

import pytest

from stateloom.boards import BOARDS, board, curve_position

STARTS = {"cross33": 0x1FFFFFFBF, "cross37": 0x1FFFFFFF7F, "cross49": 0x1FFFFFFF7FFFF}
JUMPS = {"cross33": 76, "cross37": 92, "cross49": 124}
MASKS = {
    "cross33": (0x1DB9B75B5, 0xAE75EEEB, 0x13BED57AD, 0x1D6B7AD7A),
    "cross37": (0x1ADD6D6B6B, 0xD72D7DDD7, 0x15DEB5AF5A, 0x1EB5DE5AF5),
    "cross49": (0x16F5BE5ADBB6E, 0x19DAEBF5ADEB9, 0x19EBB76D6BD6A, 0xED6CDD6D77B7),
}
FRONTIERS = {"cross33": [1, 1, 2, 8, 39, 171, 719], "cross37": [1, 1, 3, 15, 70, 341], "cross49": [1, 1, 4, 19, 105, 579]}
MOVES = {"cross33": [4, 3, 10, 51, 294], "cross37": [4, 5, 21, 115], "cross49": [4, 6, 28, 172]}


@pytest.mark.parametrize("name", BOARDS)
def test_geometry(name):
    b = BOARDS[name]
    assert (b.size, b.start, len(b.jumps)) == (int(name[5:]), STARTS[name], JUMPS[name])
    assert b.canonical(b.start) == b.start
    assert set(b.parity_masks) == set(MASKS[name])
    assert all(sorted(p) == list(range(b.size)) for p in b.permutations)


@pytest.mark.parametrize("name", BOARDS)
def test_first_rounds(name):
    b = BOARDS[name]
    states, sizes, moves = {b.canonical(b.start)}, [], []
    for _ in FRONTIERS[name]:
        sizes.append(len(states))
        children = [c for s in states for c in b.successors(s)]
        moves.append(len(children))
        states = {b.canonical(c) for c in children}
    assert sizes == FRONTIERS[name] and moves[: len(MOVES[name])] == MOVES[name]


@pytest.mark.parametrize("name", BOARDS)
def test_symmetries_and_invariants(name):
    b, rng = BOARDS[name], random.Random(5)
    for _ in range(100):
        s = rng.getrandbits(b.size)
        images = [b.transform(s, t) for t in range(8)]
        assert len({b.canonical(i) for i in images}) == 1 and {i.bit_count() for i in images} == {s.bit_count()}
        for child in b.successors(s):
            assert b.syndrome(child) == b.syndrome(s) and child.bit_count() == s.bit_count() - 1


def test_lookup():
    assert board(" CROSS33 ") is BOARDS["cross33"] and BOARDS["cross33"].bit_at(0, 0) == -1 and BOARDS["cross33"].bit_at(3, 3) == 6
    with pytest.raises(ValueError):
        board("round")


def test_curve_visits_neighbours():
    cells = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda c: curve_position(8, *c))
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(cells, cells[1:], strict=False))
