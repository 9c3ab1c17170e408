import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateloom.boards import BOARDS
from stateloom.operators import keys as key_ops
from stateloom.operators import routing
from stateloom.operators.kernel import Kernel, children, step
from stateloom.operators.routing import expand_routed, forecast, forecast_bounds, in_ranges, weighted_cuts
from stateloom.plans.enumeration import Enumerator, Tuning
from stateloom.plans.progress import Progress
from stateloom.sources.rounds import RoundStore

BOARD = BOARDS["cross33"]


def loop(weights, most):
    """The boundaries in words: walk the keys, and pick one when what lies before has passed the next share."""
    total, wanted = sum(weights.values()), min(most, max(0, len(weights) - 1))
    out, before, share = [], 0.0, 1
    for key in sorted(weights):
        if share <= wanted and before >= total * share / (wanted + 1):
            out.append(key)
            while share <= wanted and before >= total * share / (wanted + 1):
                share += 1
        before += weights[key]
    return out


def test_cuts_equal_a_walk_over_the_keys():
    rng = random.Random(1)
    for _ in range(200):
        weights = {rng.randrange(-500, 500): float(rng.choice([1, 1, 2, 50])) for _ in range(rng.randint(0, 60))}
        keys = np.array(sorted(weights), np.int64)
        found = weighted_cuts(keys, np.array([weights[k] for k in keys.tolist()], float), 7)
        assert found.tolist() == loop(weights, 7)


def test_forecast_is_the_table_form(spark):
    rng = random.Random(2)
    sample = {rng.getrandbits(33): rng.randint(1, 9) for _ in range(300)}
    df = spark.createDataFrame(list(sample.items()), "state long, weight long")
    made = forecast(BOARD, list(sample), list(sample.values()), lambda moves: 41)
    due = [r["bound"] for r in forecast_bounds(df, BOARD, 40).orderBy("bound").collect()]
    assert made.bounds.tolist() == due and made.moves == children(df, BOARD).join(df, "state").agg(F.sum("weight")).first()[0]


def test_ranges_hold_each_child_once_in_one_shuffle(spark):
    rng = random.Random(3)
    states = spark.createDataFrame([(rng.getrandbits(33),) for _ in range(2000)], "state long").repartition(5)
    bounds = np.array(sorted(rng.getrandbits(32) for _ in range(6)), np.int64)
    routed = expand_routed(states, BOARD, bounds, 300)
    due = {r["state"]: r["moves"] for r in step(states, BOARD).collect()}
    blocks = routed.collect()
    assert sum(r["moves"] for r in blocks) == sum(due.values()) and sum(r["n"] for r in blocks) == sum(len(r["states"]) // 8 for r in blocks) >= len(due)
    rows = in_ranges(routed, 7).withColumn("range", F.spark_partition_id()).collect()
    assert {r["state"] for r in rows} == set(due) and len(rows) == len(due)
    assert all(np.searchsorted(bounds, r["state"], "right") == r["range"] for r in rows)
    for k in range(7):
        own = [r["state"] for r in rows if r["range"] == k]
        assert own == sorted(own)
    plan = in_ranges(expand_routed(spark.range(10).selectExpr("id as state"), BOARD, bounds, 300), 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan


def test_merge_of_overlapping_blocks(spark, monkeypatch):
    monkeypatch.setattr(routing, "MERGED", 7)
    rng = random.Random(9)
    runs = [sorted(rng.sample(range(-200, 200), 60)) for _ in range(9)]
    rows = [(0, run[k], np.array(run[k : k + 5], np.int64).tobytes(), 5, 5) for run in runs for k in range(0, 60, 5)]
    rows += [(0, -500, np.array([-500, 300], np.int64).tobytes(), 2, 2)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = in_ranges(spark.createDataFrame(rows, "range int, first long, states binary, n long, moves long"), 1).collect()
        assert [r["state"] for r in made] == sorted({k for run in runs for k in run} | {-500, 300})
        assert in_ranges(spark.createDataFrame([], "range int, first long, states binary, n long, moves long"), 3).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("ranked", [False, True])
def test_rounds_of_several_ranges(spark, tmp_path, ranked):
    tuning = Tuning(rows=500, most_moves=1500, least_moves=100)
    e = Enumerator(spark, BOARD, f"file://{tmp_path}/r", verify=True, ranked=ranked, tuning=tuning)
    results = [e.run_one_round() for _ in range(10)]
    assert [r.unique for r in results] == [1, 1, 2, 8, 39, 171, 719, 2757, 9751, 31312]
    m = e.store.manifest(10)
    assert m.count == 31312 and m.stride == 0 and (m.population == 23 if ranked else m.population is None)
    plain = sorted(r["state"] for r in e.store.read(10).collect())
    assert list(e.store.stream(9)) == sorted(r["state"] for r in e.store.read(9).collect())
    kernel = Kernel(BOARD)
    parents = np.array(list(e.store.stream(9)), np.int64)
    assert plain == np.unique(kernel.expand(parents)).tolist()
    balance = [r["rows"] for r in _files(spark, f"file://{tmp_path}/r/10")]
    assert len(balance) > 20 and max(balance) < 3 * sum(balance) / len(balance)


def _files(spark, path):
    from stateloom.sources.footers import footers

    return footers(spark, path).groupBy("file").agg(F.sum("rows").alias("rows")).collect()


def test_a_ranked_round_of_mixed_states_is_an_error(spark, tmp_path):
    from stateloom.plans.enumeration import in_class

    df = spark.createDataFrame([(3,), (7,)], "state long")
    with pytest.raises(Exception, match="another class"):
        in_class(df, BOARD, 2, BOARD.syndrome(3)).collect()


def test_progress_tells_at_an_interval(spark):
    import time

    lines = []
    with Progress(spark, "round 5", 1000, 0.2, lines.append) as p:
        spark.range(0, 4, 1, 8).select(F.expr("java_method('java.lang.Thread', 'sleep', 400L)")).write.format("noop").mode("overwrite").save()
        time.sleep(0.5)
        assert p.share() == 1.0
    assert len(lines) >= 2 and all("of 1,000 states processed" in line and "a second" in line for line in lines)
    assert "1,000 of 1,000" in lines[-1]
    n = len(lines)
    time.sleep(0.4)
    assert len(lines) == n
    with pytest.raises(ValueError, match="interval"):
        Progress(spark, "x", 1, 0)


def test_missing_manifests_are_rebuilt_with_their_sample(spark, tmp_path):
    e = Enumerator(spark, BOARD, f"file://{tmp_path}/m", tuning=Tuning(most_moves=400))
    for _ in range(7):
        e.run_one_round()
    (tmp_path / "m" / "7.manifest").unlink()
    result = e.run_one_round()
    assert (result.processed, result.unique) == (719, 2757)
    assert RoundStore(spark, f"file://{tmp_path}/m").manifest(7) is None
    assert key_ops.ordinal_stride(719) == 1
