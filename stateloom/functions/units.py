"""Column expressions for measures of runs: times in milliseconds, rates in MiB a second, bytes for a state, changes in percent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of a time unit, as benchmark results name it before "/op".
MILLISECONDS = {"ns": 1e-6, "us": 1e-3, "ms": 1.0, "s": 1e3, "min": 6e4}


def milliseconds(score: Column, unit: Column) -> Column:
    """A score in "<time>/op" as milliseconds; one in "ops/<time>" as milliseconds for an operation; null for other units or no operations."""
    time = F.create_map(*(F.lit(x) for pair in MILLISECONDS.items() for x in pair))
    each = F.try_element_at(time, F.regexp_extract(unit, "^([a-z]+)/op$", 1))
    rate = F.try_element_at(time, F.regexp_extract(unit, "^ops/([a-z]+)$", 1))
    return F.when(each.isNotNull(), score * each).when(rate.isNotNull() & (score > 0), rate / score)


def mib_per_second(n_bytes: Column, ms: Column) -> Column:
    return F.when(ms > 0, n_bytes / F.lit(float(1 << 20)) / (ms / 1000))


def bytes_per_state(n_bytes: Column, states: Column) -> Column:
    return F.when(states > 0, n_bytes / states)


def percent(before: Column, after: Column) -> Column:
    return F.when(before != 0, (after - before) / before * 100)
