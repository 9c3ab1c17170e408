import json

import pytest
from pyspark.sql import functions as F

from stateloom.functions import units
from stateloom.sources.benchmarks import KeySetError, compare, key_faults, read_results


def result(name, score, params=None, unit="ms/op", spread=1.0, **secondary):
    metric = lambda s, u: {"score": s, "scoreError": spread, "scoreConfidence": [s - spread, s + spread], "scoreUnit": u, "rawData": [[s]]}
    out = {"jmhVersion": "1.37", "benchmark": name, "mode": "avgt", "threads": 1, "primaryMetric": metric(score, unit), "secondaryMetrics": {k: metric(v, "B/op") for k, v in secondary.items()}}
    return out | ({"params": params} if params else {})


@pytest.fixture
def runs(spark, tmp_path):
    def load(name, results):
        (tmp_path / f"{name}.json").write_text(json.dumps(results, indent=4))
        return read_results(spark, f"file://{tmp_path}/{name}.json")

    return load


def test_nested_results(runs):
    df = runs("a", [result("merge", 36.5, {"sources": "64", "keys": "1000"}, alloc=12.0), result("read", 4.0, unit="ops/s"), result("write", 2.0, unit="us/op")])
    rows = {(r["benchmark"], r["metric"]): r for r in df.collect()}
    assert len(rows) == 4
    merge = rows["merge", None]
    assert [tuple(p) for p in merge["params"]] == [("keys", "1000"), ("sources", "64")] and (merge["low"], merge["high"], merge["ms"]) == (35.5, 37.5, 36.5)
    assert (rows["merge", "alloc"]["score"], rows["merge", "alloc"]["unit"], rows["merge", "alloc"]["ms"]) == (12.0, "B/op", None)
    assert rows["read", None]["ms"] == 250.0 and rows["write", None]["ms"] == 0.002 and rows["read", None]["params"] == []


def test_runs_are_compared_by_benchmark_and_parameters(runs):
    before = runs("b", [result("merge", 100.0, {"k": "1", "j": "x"}, spread=5), result("merge", 50.0, {"k": "2", "j": "x"}), result("one", 0.0, spread=float("nan"))])
    # the order of parameters and of results doesn't matter
    after = runs("c", [result("one", 3.0, spread=float("nan")), result("merge", 25.0, {"j": "x", "k": "2"}), result("merge", 108.0, {"j": "x", "k": "1"}, spread=4)])
    found = {(r["benchmark"], r["baseline"]): (r["percent"], r["overlap"]) for r in compare(before, after).collect()}
    assert found == {("merge", 100.0): (8.0, True), ("merge", 50.0): (-50.0, False), ("one", 0.0): (None, None)}


def test_key_sets_must_agree(runs):
    a = runs("d", [result("x", 1.0, {"k": "1"}), result("y", 1.0)])
    b = runs("e", [result("x", 1.0, {"k": "2"}), result("y", 1.0), result("y", 2.0)])
    assert {(r["benchmark"], r["baseline"], r["candidate"]) for r in key_faults(a, b).collect()} == {("x", 1, 0), ("x", 0, 1), ("y", 1, 2)}
    with pytest.raises(KeySetError, match="x"):
        compare(a, b)
    assert key_faults(a, a).collect() == []
    with pytest.raises(Exception, match="units differ"):
        compare(runs("f", [result("x", 1.0)]), runs("g", [result("x", 1.0, unit="s/op")])).collect()


def test_malformed_results_are_errors(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"benchmark": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_results(spark, f"file://{tmp_path}/bad.json").collect()


def test_units(spark):
    rows = [(1 << 20, 500.0, 4), (0, 0.0, 0)]
    df = spark.createDataFrame(rows, "b long, ms double, n long")
    found = df.select(units.mib_per_second(F.col("b"), F.col("ms")), units.bytes_per_state(F.col("b"), F.col("n")), units.percent(F.lit(4.0), F.lit(5.0))).collect()
    assert [tuple(r) for r in found] == [(2.0, 262144.0, 25.0), (None, None, 25.0)]
