import random

import pytest
from pyspark.sql import functions as F

from stateloom.functions import bitboard
from stateloom.operators import keys


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key long")


def test_ordinals(spark):
    values = random.Random(1).sample(range(100_000), 5000)
    rows = keys.with_ordinal(frame(spark, values)).collect()
    assert [r["key"] for r in sorted(rows, key=lambda r: r["ordinal"])] == sorted(values) and {r["ordinal"] for r in rows} == set(range(5000))


@pytest.mark.parametrize("n,stride", [(0, 1), (1, 1), (4096, 1), (4097, 2), (8192, 2), (8193, 4), (10_000, 4), (100_000, 32), (353_018, 128), (1_523_417, 512)])
def test_stride(n, stride):
    assert keys.ordinal_stride(n) == stride


def test_sample(spark):
    rows = sorted((r["key"], r["weight"]) for r in keys.ordinal_sample(frame(spark, range(0, 70_000, 7))).collect())
    assert [k for k, _ in rows] == list(range(0, 70_000, 28)) and sum(w for _, w in rows) == 10_000
    assert keys.ordinal_sample(frame(spark, [])).collect() == []


def test_weighted_bounds_equal_a_loop(spark):
    rng = random.Random(4)
    for n, most in ((1, 127), (5, 127), (300, 127), (40, 3)):
        weights = {k: rng.randint(1, 50) for k in rng.sample(range(1000), n)}
        b, total, running, q, expected = min(most, n - 1), sum(weights.values()), 0, 1, []
        for k in sorted(weights):
            if q <= b and running >= total * q / (b + 1):
                expected.append(k)
                while q <= b and running >= total * q / (b + 1):
                    q += 1
            running += weights[k]
        df = spark.createDataFrame(list(weights.items()), "key long, weight long")
        assert sorted(r["bound"] for r in keys.weighted_bounds(df, most=most).collect()) == expected


def test_quantiles(spark):
    values = random.Random(6).sample(range(10_000), 1000)
    found = {r["bound_no"]: r["bound"] for r in keys.quantile_bounds(frame(spark, values + values)).collect()}
    assert found == {i: sorted(values)[(i + 1) * 1000 // 128] for i in range(127)}


def test_gaps_differences_checks(spark):
    assert sorted((r["key"], r["gap"], r["bytes"]) for r in keys.gaps(frame(spark, [5, 133, 300])).collect()) == [(5, 5, 1), (133, 128, 2), (300, 167, 2)]
    rows = keys.differences(frame(spark, [1, 1, 2]), frame(spark, [1, 3])).collect()
    assert sorted((r["key"], r["side"], r["copies"]) for r in rows) == [(1, "left", 1), (2, "left", 1), (3, "right", 1)]
    df = spark.createDataFrame([(0, 5), (1, 6), (2, 6), (3, 1)], "place long, key long")
    assert keys.is_increasing(df, "place").first()[0] == 2
    counts = keys.shard_counts(frame(spark, [1, 2, 9]), F.col("key") % 3, 4)
    assert sorted((r["shard"], r["n"]) for r in counts.collect()) == [(0, 1), (1, 1), (2, 1), (3, 0)]
    assert keys.summary(frame(spark, range(512))).count() == 256


def test_many_rows_over_many_partitions(spark):
    n = 400_000
    place = F.pmod(F.col("id") * 7919, F.lit(n))
    rows = spark.range(0, n, 1, 8).select(place.alias("place"), F.pmod(place * 104_729, F.lit(99_991)).alias("key"))
    expected = sum((p * 104_729) % 99_991 <= ((p - 1) * 104_729) % 99_991 for p in range(1, n))
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        numbered = keys.with_ordinal(rows, "place")
        assert numbered.where("ordinal != place").count() == 0 and numbered.count() == n
        assert keys.is_increasing(rows, "place").first()[0] == expected
        weights = rows.select(F.col("place").alias("key"), F.lit(1).alias("weight"))
        assert sorted(r["bound"] for r in keys.weighted_bounds(weights, most=9).collect()) == [n * q // 10 for q in range(1, 10)]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_previous_rows_by_border_rows(spark):
    rows = [(k * 7919 % 100_003, k % 11, f"s{k}") for k in range(40_000)]
    df = spark.createDataFrame(rows, "place long, key long, tag string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = {r["place"]: (r["prev_key"], r["prev_tag"]) for r in keys.with_previous(df, ["place"], ["key", "tag"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered = sorted(rows)
    assert found[ordered[0][0]] == (None, None) and len(found) == 40_000
    assert all(found[b[0]] == a[1:] for a, b in zip(ordered, ordered[1:], strict=False))


def test_shards_by_binary_search(spark):
    rng = random.Random(8)
    bounds = sorted({rng.randrange(-1000, 1000) for _ in range(100)})
    rows = spark.createDataFrame([(k,) for k in range(-1100, 1100)], "k long").select("k", bitboard.shard(F.col("k"), bounds).alias("s")).collect()
    assert all(r["s"] == sum(b <= r["k"] for b in bounds) for r in rows)
    with pytest.raises(ValueError, match="increase"):
        bitboard.shard(F.col("k"), [3, 3])
