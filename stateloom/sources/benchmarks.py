"""Benchmark results in nested JSON, one array for each file, and pairs of runs compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units

_METRIC = "score double, scoreError string, scoreConfidence array<string>, scoreUnit string"
SCHEMA = f"benchmark string, mode string, params map<string,string>, primaryMetric struct<{_METRIC.replace(' ', ':').replace(',:', ',')}>, secondaryMetrics map<string,struct<{_METRIC.replace(' ', ':').replace(',:', ',')}>>"


class KeySetError(ValueError):
    """Two runs don't hold the same benchmarks with the same parameters."""


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(benchmark, params, metric, score, low, high, unit, ms): a row for the main metric (null name) and each secondary one.

    params: the parameters by name, sorted, as maps can't be compared.
    Confidence bounds that are no numbers ("NaN") become null.
    """
    found = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    params = F.array_sort(F.map_entries(F.coalesce("params", F.create_map().cast("map<string,string>"))))
    main = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("primaryMetric").alias("value")))
    other = F.coalesce(F.map_entries("secondaryMetrics"), F.array().cast(f"array<struct<key:string,value:struct<{_METRIC.replace(' ', ':').replace(',:', ',')}>>>"))
    rows = found.select("benchmark", params.alias("params"), F.explode(F.concat(main, other)).alias("m"))
    score, unit = F.col("m.value.score"), F.col("m.value.scoreUnit")
    bound = lambda k: F.nanvl(F.get(F.col("m.value.scoreConfidence"), F.lit(k)).try_cast("double"), F.lit(None).cast("double"))
    return rows.select("benchmark", "params", F.col("m.key").alias("metric"), score.alias("score"), bound(0).alias("low"), bound(1).alias("high"), unit.alias("unit"), units.milliseconds(score, unit).alias("ms"))


_KEY = ["benchmark", "params", "metric"]


def key_faults(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(benchmark, params, metric, baseline, candidate): keys that the two don't hold once each, with how often they do."""
    counts = [side.groupBy(*_KEY).agg(F.count(F.lit(1)).alias(name)) for side, name in ((baseline, "baseline"), (candidate, "candidate"))]
    a, b = counts[0].alias("a"), counts[1].alias("b")
    same = (F.col("a.benchmark").eqNullSafe(F.col("b.benchmark"))) & (F.col("a.params") == F.col("b.params")) & F.col("a.metric").eqNullSafe(F.col("b.metric"))
    n, m = F.coalesce("a.baseline", F.lit(0)), F.coalesce("b.candidate", F.lit(0))
    return a.join(b, same, "full").where((n != 1) | (m != 1)).select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in _KEY), n.alias("baseline"), m.alias("candidate"))


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(benchmark, params, metric, unit, baseline, candidate, percent, overlap): changes, and whether the confidence ranges meet.

    Both must hold the same keys, once each, in the same units; else a KeySetError says which differ.
    """
    faults = key_faults(baseline, candidate).limit(10).collect()
    if faults:
        raise KeySetError(", ".join(f"{r['benchmark']} {[tuple(p) for p in r['params']]} {r['metric'] or ''}: {r['baseline']} and {r['candidate']}" for r in faults))
    a, b = baseline.alias("a"), candidate.alias("b")
    same = F.col("a.benchmark").eqNullSafe(F.col("b.benchmark")) & (F.col("a.params") == F.col("b.params")) & F.col("a.metric").eqNullSafe(F.col("b.metric"))
    unit = F.when(F.col("a.unit").eqNullSafe(F.col("b.unit")), F.col("a.unit")).otherwise(F.raise_error(F.lit("units differ")).cast("string"))
    overlap = F.greatest("a.low", "b.low") <= F.least("a.high", "b.high")
    known = F.col("a.low").isNotNull() & F.col("b.low").isNotNull() & F.col("a.high").isNotNull() & F.col("b.high").isNotNull()
    return a.join(b, same).select(
        *(F.col(f"a.{c}") for c in _KEY), unit.alias("unit"), F.col("a.score").alias("baseline"), F.col("b.score").alias("candidate"),
        units.percent(F.col("a.score"), F.col("b.score")).alias("percent"), F.when(known, overlap).alias("overlap"),
    )
