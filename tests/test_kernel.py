import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateloom.boards import BOARDS
from stateloom.functions import bitboard
from stateloom.operators import kernel


def sample(b, seed):
    rng = random.Random(seed)
    out = {0, b.full, b.start}
    out |= {1 << i for i in range(b.size)} | {b.full ^ (1 << i) for i in range(b.size)}
    for pegs in range(b.size + 1):
        for _ in range(4):
            out.add(sum(1 << i for i in rng.sample(range(b.size), pegs)))
    return sorted(out)


@pytest.mark.parametrize("name", BOARDS)
def test_both_forms_equal_the_rules(spark, name):
    b = BOARDS[name]
    states = sample(b, 11)
    expected = Counter(b.canonical(c) for s in states for c in b.successors(s))
    df = spark.createDataFrame([(s,) for s in states], "state long")
    assert Counter(r["child"] for r in kernel.children(df, b).collect()) == expected
    assert {r["state"]: r["moves"] for r in kernel.step(df, b).collect()} == expected
    assert Counter(kernel.Kernel(b).expand(np.array(states)).tolist()) == expected


def test_expressions(spark):
    b = BOARDS["cross37"]
    states = sample(b, 3)
    s = F.col("state")
    df = spark.createDataFrame([(x,) for x in states], "state long")
    rows = df.select("state", bitboard.canonical(s, b).alias("c"), bitboard.syndrome(s, b).alias("y"), bitboard.encode(bitboard.decode(s, b)).alias("e"), F.array(*bitboard.transforms(s, b)).alias("t"), bitboard.is_valid(s, b).alias("v")).collect()
    for r in rows:
        x = r["state"]
        assert (r["c"], r["y"], r["e"], r["v"]) == (b.canonical(x), b.syndrome(x), x, True)
        assert r["t"] == [b.transform(x, t) for t in range(8)]


def test_states_outside_the_board_are_refused():
    with pytest.raises(ValueError):
        kernel.Kernel(BOARDS["cross33"]).expand(np.array([1 << 33]))


def test_mix64(spark):
    def mix(x):
        mask = (1 << 64) - 1
        for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> 33)) * f & mask
        return x ^ (x >> 33)

    keys = [0, 1, 2, 12345, 2**62 - 1, 2**63 - 1, -1, -(2**63), -987654321]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", bitboard.mix64(F.col("k")).alias("m")).collect()
    assert {r["k"]: r["m"] % (1 << 64) for r in rows} == {k: mix(k % (1 << 64)) for k in keys}


def test_shard_bounds_belong_to_the_right(spark):
    low, high = -(2**63), 2**63 - 1
    keys = {low: 1, -8: 1, -7: 2, -1: 2, 0: 3, high - 1: 3, high: 4}
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", bitboard.shard(F.col("k"), [low, -7, 0, high]).alias("s")).collect()
    assert {r["k"]: r["s"] for r in rows} == keys


@pytest.mark.parametrize("rows", [1, 7, 65536])
def test_groups_of_any_size_give_the_same_moves(spark, rows):
    b = BOARDS["cross33"]
    states = sample(b, 5)
    expected = Counter(b.canonical(c) for s in states for c in b.successors(s))
    df = spark.createDataFrame([(s,) for s in states], "state long").repartition(3)
    found = kernel.expand(df, b, rows).groupBy("state").agg(F.sum("moves").alias("moves")).collect()
    assert {r["state"]: r["moves"] for r in found} == expected


@pytest.mark.parametrize("bits", [1, 5, 13, 14, 33, 37, 49, 63])
def test_mixed_states_come_back_from_their_blocks(bits):
    rng = random.Random(bits)
    states = np.array(sorted({rng.getrandbits(bits) for _ in range(3000)} | {0, (1 << bits) - 1}), np.int64)
    mixing = kernel.Mixing(bits)
    mixed = mixing.mix(states)
    assert len(np.unique(mixed)) == len(states) and mixing.unmix(mixed).tolist() == states.tolist()
    twice = np.sort(np.concatenate((mixed, mixed[::3])))
    rows = kernel.packed(twice, mixing).to_pylist()
    assert [r["cell"] for r in rows] == sorted({int(c) for c in mixing.cells(mixed)})
    assert np.concatenate([kernel.unpacked(r["cell"], {r["width"]: [r["steps"]]}, mixing) for r in rows]).tolist() == twice.tolist()


def test_cells_of_neighbouring_states_are_even():
    for shift in (0, 3, 15):
        found = np.bincount(kernel.Mixing(33).cells(kernel.Mixing(33).mix(np.arange(1 << 18) << shift)), minlength=8192)
        assert found.max() < 5 * found.mean()


@pytest.mark.parametrize("rows", [1, 7, 1 << 18])
def test_a_step_builds_no_hash_table(spark, rows):
    b = BOARDS["cross33"]
    states = sample(b, 6)
    df = spark.createDataFrame([(s,) for s in [*states, *states[:9], None]], "state long").repartition(3)
    made = kernel.step(kernel.distinct(df, b.size, rows), b, rows)
    assert {r["state"]: r["moves"] for r in made.collect()} == Counter(b.canonical(c) for s in states for c in b.successors(s))
    assert "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["state"] for r in kernel.distinct(df, b.size, rows).collect()) == states
