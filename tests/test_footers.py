import os

import pytest
from pyspark.sql import functions as F

from stateloom.sources import key_files
from stateloom.sources.footers import disorder, footers, key_differences, sizes, summary
from stateloom.sources.key_files import KeyWriter, Stretch, read_key_files, register, write_key_files
from stateloom.sources.rounds import RoundStore


def stored(spark, path, keys, parts=5):
    store = RoundStore(spark, f"file://{path}")
    store.files.make_root()
    store.write(1, keys.withColumnRenamed("id", "state"), parts)
    store.files.rename("1.in-progress", "1")
    return store.files.at("1")


def test_footers_tell_what_a_scan_does(spark, tmp_path):
    path = stored(spark, tmp_path / "a", spark.range(0, 90_000, 3), 4)
    groups = footers(spark, path)
    scan = spark.read.parquet(path).agg(F.count(F.lit(1)), F.min("state"), F.max("state")).first()
    found = groups.agg(F.sum("rows"), F.min("first"), F.max("last"), F.count(F.lit(1))).first()
    assert tuple(found)[:3] == tuple(scan) and found[3] >= 30  # row groups of at most 1024
    assert disorder(groups).first()["faults"] == 0
    for most in (4096, 7, 1):
        keys = summary(groups, most).collect()
        assert len(keys) <= most and sum(r["weight"] for r in keys) == 30_000 and keys[0]["key"] == 0
        assert [r["key"] for r in keys] == sorted(r["key"] for r in keys)
        # each stands for the keys from it to the next
        ends = [r["key"] for r in keys[1:]] + [90_000]
        assert all(r["weight"] == (end - r["key"]) // 3 for r, end in zip(keys, ends, strict=True))
    s = sizes(groups).first()
    disk = sum(os.path.getsize(f"{tmp_path}/a/1/{f}") for f in os.listdir(tmp_path / "a" / "1") if f.endswith(".parquet"))
    assert (s["rows"], s["files"], s["key_bytes"] + s["other_bytes"]) == (30_000, 4, disk) and s["bytes_per_row"] == disk / 30_000


def test_footers_of_unsorted_and_empty_folders(spark, tmp_path):
    spark.createDataFrame([(5,), (1,)], "state long").repartition(1).write.parquet(f"{tmp_path}/x")
    spark.createDataFrame([(3,)], "state long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/x")
    assert disorder(footers(spark, f"file://{tmp_path}/x")).first()["faults"] == 1
    path = stored(spark, tmp_path / "none", spark.range(0), 2)
    assert footers(spark, path).collect() == [] and summary(footers(spark, path), 10).collect() == []
    assert sizes(footers(spark, path)).first()["bytes_per_row"] is None


@pytest.mark.parametrize("parts", [(1, 1), (5, 3), (3, 8)])
def test_differences_of_two_folders(spark, tmp_path, parts):
    left = spark.range(-3000, 30_000, 3).where("id <> 300 and (id < 9000 or id > 12000)")
    right = spark.range(-3000, 30_000, 3).where("id <> 600 and id < 29000").unionByName(spark.createDataFrame([(301,), (-9000,), (40_000,)], "id long"))
    a, b = stored(spark, tmp_path / "l", left, parts[0]), stored(spark, tmp_path / "r", right, parts[1])
    found = sorted((r["key"], r["side"]) for r in key_differences(spark, a, b).collect())
    l, r = ({x["id"] for x in side.collect()} for side in (left, right))  # noqa: E741
    assert found == sorted([(k, "left") for k in l - r] + [(k, "right") for k in r - l])
    assert key_differences(spark, a, a).collect() == []
    plan = key_differences(spark, a, b)._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan.lower()  # files are opened in tasks; only their names were dealt


def test_differences_with_an_empty_folder(spark, tmp_path):
    a, none = stored(spark, tmp_path / "l", spark.range(10)), stored(spark, tmp_path / "n", spark.range(0))
    assert {(r["key"], r["side"]) for r in key_differences(spark, a, none).collect()} == {(k, "left") for k in range(10)}
    assert {(r["key"], r["side"]) for r in key_differences(spark, none, a).collect()} == {(k, "right") for k in range(10)}
    assert key_differences(spark, none, none).collect() == []


def test_key_files_are_written_and_read_in_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_files, "SPLIT", 100)
    keys = spark.range(-5000, 5000, 7).select(F.col("id").alias("key"))
    path = f"file://{tmp_path}/keys"
    write_key_files(keys, path, 3)
    names = sorted(f for f in os.listdir(tmp_path / "keys") if not f.startswith("."))
    assert names == ["part-00000.longs", "part-00001.longs", "part-00002.longs"]
    raw = b"".join((tmp_path / "keys" / f).read_bytes() for f in names)
    assert [int.from_bytes(raw[i : i + 8], "big", signed=True) for i in range(0, len(raw), 8)] == list(range(-5000, 5000, 7))
    assert sorted(r["key"] for r in read_key_files(spark, path).collect()) == list(range(-5000, 5000, 7))
    with pytest.raises(Exception, match="holds keys"):
        write_key_files(keys, path, 2)
    with pytest.raises(Exception, match="33 bits"):
        read_key_files(spark, path, bits=33).collect()


def test_a_split_is_checked_with_the_key_before_it(tmp_path):
    (tmp_path / "a.longs").write_bytes(b"".join(k.to_bytes(8, "big") for k in (1, 2, 9, 3, 4, 5)))
    reader = key_files.KeyReader(f"file://{tmp_path}", None, None)
    assert next(reader.read(Stretch(f"{tmp_path}/a.longs", 0, 3))).num_rows == 3
    with pytest.raises(ValueError, match="increase"):
        next(reader.read(Stretch(f"{tmp_path}/a.longs", 3, 3)))
    (tmp_path / "b.longs").write_bytes(b"123")
    with pytest.raises(ValueError, match="whole keys"):
        reader.partitions()


def test_failed_writes_leave_nothing(spark, tmp_path):
    register(spark)
    path = f"file://{tmp_path}/failed"
    wrong = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 8, 7)], "key long").coalesce(1)
    with pytest.raises(Exception, match="increase"):
        wrong.write.format("key-files").mode("append").save(path)
    overlapping = spark.range(1, 17, 4, 2).unionByName(spark.range(3, 4, 1, 1)).withColumnRenamed("id", "key")
    with pytest.raises(Exception, match="overlap"):
        overlapping.write.format("key-files").mode("append").save(path)
    assert os.listdir(tmp_path / "failed") == []
    with pytest.raises(Exception, match="null"):
        spark.createDataFrame([(None,)], "key long").write.format("key-files").mode("append").save(path)
    with pytest.raises(Exception, match="never overwritten"):
        wrong.write.format("key-files").mode("overwrite").save(path)
    with pytest.raises(Exception, match="BIGINT"):
        wrong.selectExpr("cast(key as int) as key").write.format("key-files").mode("append").save(path)
    # a task that ran twice leaves its first file in the pending folder, which goes when the others are named
    writer = KeyWriter(path)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([4, 6], pa.int64())], names=["key"])
    writer.write(iter([batch]))
    writer.commit([writer.write(iter([batch])), writer.write(iter([])), None])
    assert os.listdir(tmp_path / "failed") == ["part-00000.longs"]
    assert [r["key"] for r in read_key_files(spark, path, bits=3, pegs=None).orderBy("key").collect()] == [4, 6]


def test_no_keys(spark, tmp_path):
    path = f"file://{tmp_path}/empty"
    write_key_files(spark.range(0).select(F.col("id").alias("key")), path, 2)
    assert read_key_files(spark, path).collect() == []
    with pytest.raises(Exception, match="none"):
        read_key_files(spark, f"file://{tmp_path}/none").collect()
