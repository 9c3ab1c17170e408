import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateloom.boards import BOARDS
from stateloom.functions import gf2, tables
from stateloom.functions.ranks import Ranks, class_sizes, with_rank, with_state


@pytest.mark.parametrize("masks", [(), (0b1010110101,), (0b0111001101, 0b1101101, 0b1, 0b1111111111)])
def test_ranks_number_the_words_of_each_class(masks):
    ranks = Ranks(10, masks)
    words = np.arange(1024)
    population, parity, rank = ranks.rank(words)
    seen = Counter()
    for w, p, s, r in zip(words.tolist(), population.tolist(), parity.tolist(), rank.tolist(), strict=True):
        assert p == w.bit_count() and s == sum(((w & m).bit_count() & 1) << k for k, m in enumerate(masks))
        assert r == seen[p, s]
        seen[p, s] += 1
    assert ranks.unrank(population, parity, rank).tolist() == words.tolist()
    assert sorted((p, s, n) for (p, s), n in seen.items()) == class_sizes(ranks)


@pytest.mark.parametrize("name", BOARDS)
def test_ranks_of_boards(name):
    board, rng = BOARDS[name], random.Random(4)
    states = np.array(sorted({rng.getrandbits(board.size) for _ in range(3000)} | {0, board.full, board.start}), np.int64)
    ranks = Ranks.of(board)
    population, parity, rank = ranks.rank(states)
    assert parity.tolist() == [board.syndrome(s) for s in states.tolist()]
    assert ranks.unrank(population, parity, rank).tolist() == states.tolist()
    assert sum(n for _, _, n in class_sizes(ranks)) == 1 << board.size
    own = (population == board.size - 12) & (parity == parity[0])
    assert (np.diff(rank[own]) > 0).all()
    # a jump keeps the class, so ranks of a round lie in a sixteenth of the words of its population
    child = board.successors(board.start)[0]
    assert ranks.rank(np.array([child]))[1][0] == board.syndrome(board.start)


def test_ranks_out_of_their_class_are_errors():
    ranks = Ranks(12, (3,))
    with pytest.raises(ValueError, match="bits"):
        ranks.rank(np.array([1 << 12]))
    for p, s, r in ((3, 0, 10_000), (3, 0, -1), (13, 0, 0), (3, 2, 0)):
        with pytest.raises(ValueError, match="beyond"):
            ranks.unrank(*(np.array([v]) for v in (p, s, r)))
    with pytest.raises(ValueError):
        Ranks(64)
    assert ranks.unrank(*(np.empty(0, np.int64),) * 3).tolist() == []


def test_rank_columns_keep_the_others(spark):
    ranks = Ranks.of(BOARDS["cross37"])
    df = spark.range(1000).select((F.col("id") * 99991).alias("state"), F.lit("x").alias("tag"))
    found = with_state(with_rank(df, ranks), ranks, "again")
    assert found.columns == ["state", "tag", "population", "parity", "rank", "again"]
    assert found.where("state <> again or tag <> 'x'").count() == 0 and found.count() == 1000


@pytest.mark.parametrize("name", BOARDS)
def test_parity_space_is_closed_under_symmetries(spark, name):
    board = BOARDS[name]
    space = gf2.span(board.parity_masks)
    assert len(space) == 16 and gf2.Basis.of(board.parity_masks).rank == 4 and gf2.images_outside(board) == set()
    assert sorted(r["mask"] for r in gf2.parity_space(spark, board).collect()) == sorted(space)
    # every jump meets each of these sets in an even number of holes, and no other set that one symmetry makes
    assert all((mask & changed).bit_count() % 2 == 0 for mask in space for _, _, changed in board.jumps)
    rng = random.Random(6)
    for _ in range(300):
        state = rng.getrandbits(board.size)
        for t in range(8):
            assert gf2.class_map(board, t)[board.syndrome(state)] == board.syndrome(board.transform(state, t))


def test_basis():
    basis = gf2.Basis.of([0b1100, 0b0110, 0b1010, 0])
    assert basis.rank == 2 and basis.coordinates(0b1) is None and basis.coordinates(0) == 0
    given = [0b1100, 0b0110, 0b1010, 0]
    for vector in (0b1100, 0b0110, 0b1010):
        bits, made = basis.coordinates(vector), 0
        for k, v in enumerate(given):
            made ^= v if bits >> k & 1 else 0
        assert made == vector


def test_successors_behind_lateral(spark):
    tables.register(spark)
    board = BOARDS["cross33"]
    states = [board.start, 0, 7, None]
    spark.createDataFrame([(s,) for s in states], "state long").createOrReplaceTempView("few")
    due = sorted((s, c) for s in states if s is not None for c in board.successors(s))
    one = spark.sql("SELECT s.state, n.child FROM few s, LATERAL successors_of(s.state, 'cross33') n").collect()
    batch = spark.sql("SELECT state, child FROM successors(TABLE(SELECT state FROM few), 'cross33')").collect()
    assert sorted(map(tuple, one)) == due and sorted(map(tuple, batch)) == due
