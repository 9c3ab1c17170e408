"""Operators on tables of one BIGINT key: order, samples, boundaries, shards, differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import keep

#: States in a sample, and boundaries of ranges, at most.
SAMPLE = 4096
BOUNDS = 127


def with_ordinal(keys: DataFrame, key: str = "key", name: str = "ordinal") -> DataFrame:
    """Number the rows from 0 in key order.

    Ranges of keys are dealt to tasks; each numbers its own rows, and the
    counts of the ranges before, one row for each task, are added.  Ranges are
    drawn from a sample that differs from plan to plan, so the dealt rows are
    written once and all that follows reads them back.
    """
    ranged = keys.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    placed = keep(ranged.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ordinal")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = placed.join(F.broadcast(offsets), F.col("__part") == F.col("__p"))  # a row for each task
    return joined.withColumn(name, F.col("__place") + F.col("__before")).drop("__part", "__p", "__place", "__before")


def ordinal_stride(n: int, most: int = SAMPLE) -> int:
    """The smallest power of two that leaves at most ``most`` of n ordinals."""
    stride = 1
    while -(-n // stride) > most:
        stride *= 2
    return stride


def ordinal_sample(keys: DataFrame, key: str = "key", most: int = SAMPLE) -> DataFrame:
    """(key, weight): every k-th key in order; a key weighs as many as it stands for."""
    return sample_of(with_ordinal(keys, key), key, most)


def sample_of(placed: DataFrame, key: str = "key", most: int = SAMPLE) -> DataFrame:
    """The same of keys that ``with_ordinal`` has numbered; they were written once, and counting them reads that."""
    n = placed.count()
    k = ordinal_stride(n, most)
    picked = placed.where(F.col("ordinal") % k == 0)
    return picked.select(F.col(key), F.least(F.lit(k).cast("long"), F.lit(n) - F.col("ordinal")).alias("weight"))


def with_previous(rows: DataFrame, order: list[str], columns: list[str], what: str = "previous") -> DataFrame:
    """``rows`` (order and columns) with the columns' values of the row before it in order as prev_*; null at the first.

    One shuffle: each range takes its rows' predecessors as they pass, is
    written once, and the first row of each range takes the last of the range
    before, a row for each task.
    """
    ranged = rows.select(*dict.fromkeys([*order, *columns])).repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order)
    schema = T.StructType([*ranged.schema.fields, *(T.StructField(f"prev_{c}", ranged.schema[c].dataType) for c in columns), T.StructField("__part", T.IntegerType()), T.StructField("__place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            before = []
            for k, c in enumerate(columns):
                own = batch.column(c)
                before.append(pa.concat_arrays([last[k] if last else pa.nulls(1, own.type), own.slice(0, n - 1)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *before, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n))], names=[f.name for f in schema.fields])
            place, last = place + n, [batch.column(c).slice(n - 1, 1) for c in columns]

    placed = keep(ranged.mapInArrow(run, schema), what)
    ends = placed.groupBy("__part").agg(F.max(F.struct("__place", *columns)).alias("end"))  # a row for each task
    after = Window.orderBy("__part")
    border = ends.select(F.col("__part").alias("__p"), *(F.lag(F.col("end")[c]).over(after).alias(f"__end_{c}") for c in columns))
    joined = placed.join(F.broadcast(border), F.col("__part") == F.col("__p"))
    first = F.col("__place") == 0
    return joined.select(*ranged.columns, *(F.when(first, F.col(f"__end_{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}") for c in columns))


def is_increasing(keys: DataFrame, order: str, key: str = "key") -> DataFrame:
    """One row: pairs of neighbours, in the given order (then by key), whose keys don't increase."""
    found = with_previous(keys, list(dict.fromkeys([order, key])), [key], "increasing")
    return found.agg(F.coalesce(F.sum((F.col(key) <= F.col(f"prev_{key}")).cast("long")), F.lit(0)).alias("violations"))


def gaps(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, gap, bytes) of each key once: difference to the key before and its length in groups of seven bits; the first key is its own gap.

    Repetitions stand next to each other once the keys are in order, so no distinct comes first.
    """
    before = F.col(f"prev_{key}")
    gap = F.col(key) - F.coalesce(before, F.lit(0))
    bits = F.length(F.bin(gap))
    found = with_previous(keys, [key], [key], "gaps").where(before.isNull() | (before != F.col(key)))
    return found.select(F.col(key), gap.alias("gap"), F.ceil(bits / 7).cast("long").alias("bytes"))


def quantile_bounds(keys: DataFrame, key: str = "key", most: int = BOUNDS) -> DataFrame:
    """(bound_no, bound): keys at evenly spread places among the distinct keys."""
    placed = with_ordinal(keys.select(key).distinct(), key)
    n = placed.count()
    b = min(most, max(0, n - 1))
    wanted = keys.sparkSession.range(b).select(F.col("id").alias("bound_no"), F.floor((F.col("id") + 1) * F.lit(n) / F.lit(b + 1)).cast("long").alias("ordinal"))
    return placed.join(F.broadcast(wanted), "ordinal").select("bound_no", F.col(key).alias("bound"))


def weighted_bounds(weights: DataFrame, key: str = "key", weight: str = "weight", most: int = BOUNDS) -> DataFrame:
    """(bound): in key order, each key at which the weight before it has passed another even share of the whole.

    Equal keys are summed first.  ``most`` boundaries are asked for, fewer may come.
    """
    summed = weights.groupBy(key).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    n, total = summed.agg(F.count(F.lit(1)), F.sum("w")).first()
    b = min(most, max(0, n - 1))
    ranged = keep(summed.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()), "weighted")
    parts = ranged.groupBy("__part").agg(F.sum("w").alias("__w"))
    offsets = parts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__w").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn("run", F.col("__base") + F.coalesce(F.sum("w").over(inside), F.lit(0.0)))
    # shares total * q / (b + 1) that the weight before this key has reached, by a guess and its neighbours, exactly as they compare
    share = lambda q: F.lit(float(total or 0)) * q / (b + 1)
    guess = F.floor(F.col("run") * (b + 1) / F.lit(float(total or 1))).cast("long")
    passed = F.greatest(*(F.when((guess + k >= 0) & (guess + k <= b) & (F.col("run") >= share(guess + k)), guess + k).otherwise(F.lit(0)) for k in (-1, 0, 1)))
    ranked = with_previous(running.select(key, F.when(guess > b, F.lit(b).cast("long")).otherwise(passed).alias("q")), [key], ["q"], "bounds")
    return ranked.where(F.col("q") > F.coalesce("prev_q", F.lit(0))).select(F.col(key).alias("bound"))


def shard_counts(keys: DataFrame, shard: Column, shards: int) -> DataFrame:
    """(shard, n) for all shards, empty ones too."""
    found = keys.groupBy(shard.cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return keys.sparkSession.range(shards).select(F.col("id").alias("shard")).join(found, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("n"))


def shard_balance(counts: DataFrame) -> DataFrame:
    """Largest and mean shard, their ratio, and empty shards."""
    return counts.agg(F.max("n").alias("largest"), F.avg("n").alias("mean"), (F.max("n") / F.avg("n")).alias("ratio"), F.sum((F.col("n") == 0).cast("long")).alias("empty"))


def differences(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """(key, side, copies): keys that one side holds more often than the other."""
    l = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))  # noqa: E741
    r = right.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    both = l.join(r, key, "full").select(key, F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r")).where("l != r")
    return both.select(key, F.when(F.col("l") > F.col("r"), "left").otherwise("right").alias("side"), F.abs(F.col("l") - F.col("r")).alias("copies"))


def summary(keys: DataFrame, key: str = "key", buckets: int = 256) -> DataFrame:
    """(bucket, first_key, weight): an even cut of the keys in order, with the weight of each part."""
    placed = with_ordinal(keys, key)
    n = placed.count()
    part = F.floor(F.col("ordinal") * buckets / F.lit(max(1, n))).cast("long")
    return placed.groupBy(part.alias("bucket")).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("weight"))
