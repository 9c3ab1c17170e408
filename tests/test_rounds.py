import io
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateloom.boards import BOARDS
from stateloom.cli import UsageError, parse, run, stats_table
from stateloom.plans.enumeration import Enumerator, VerificationError, check_files, check_round, round_counts, sample_manifest
from stateloom.sources.checksum import crc32c
from stateloom.sources.key_files import read_key_files
from stateloom.sources.rounds import Manifest, ManifestError, RoundStore, file_sizes, numbered, order_faults


def states_of(store, n):
    return sorted(r["state"] for r in store.read(n).collect())


def test_rounds_resume_and_count(spark, tmp_path):
    root = f"file://{tmp_path}/rounds"
    results = [Enumerator(spark, BOARDS["cross33"], root, verify=True).run_one_round() for _ in range(6)]
    assert results[0].initialized and (results[0].processed, results[0].unique) == (0, 1)
    assert [r.unique for r in results] == [1, 1, 2, 8, 39, 171]
    assert [r.generated for r in results[1:]] == [4, 3, 10, 51, 294]
    store = RoundStore(spark, root)
    assert round_counts(store) == list(enumerate([1, 1, 2, 8, 39, 171], 1))
    m = store.manifest(6, 33)
    assert m.count == 171 and m.keys == states_of(store, 6)


def test_a_state_without_moves_ends_the_enumeration(spark, tmp_path):
    e = Enumerator(spark, BOARDS["cross33"], f"file://{tmp_path}/end")
    e.store.files.make_root()
    e.store.write(1, spark.createDataFrame([(1,)], "state long"), 1)
    e.store.publish(1, Manifest(33, 1, [1], [1]))
    first, second = e.run_one_round(), e.run_one_round()
    assert (first.destination, first.unique, first.generated) == (2, 0, 0)
    assert second.terminal and e.store.completed() == [1, 2]


def test_leftovers_and_manifests(spark, tmp_path):
    root = tmp_path / "left"
    e = Enumerator(spark, BOARDS["cross33"], f"file://{root}")
    for _ in range(3):
        e.run_one_round()
    (root / "4.in-progress").mkdir()
    (root / "4.in-progress" / "junk").write_text("x")
    for name in ("notes", "07", "5x"):
        (root / name).mkdir()
    (root / "9").write_text("a file")
    (root / "4.manifest").write_text("orphan")
    assert e.store.completed() == [1, 2, 3]
    (root / "3.manifest").unlink()
    assert e.run_one_round().unique == 8 and e.store.completed() == [1, 2, 3, 4] and not (root / "3.manifest").exists()
    (root / ".4.manifest.crc").unlink()  # of the local file system; it would notice the change by itself
    (root / "4.manifest").write_text("{}")
    with pytest.raises(ManifestError):
        e.run_one_round()
    assert not (root / "5.in-progress").exists() and e.store.completed() == [1, 2, 3, 4]
    with pytest.raises(FileExistsError):
        e.store.write(4, e.store.read(3), 1)
        e.store.publish(4, Manifest(33, 2, [1, 2], [1, 1]))


def test_malformed_manifests():
    good = Manifest(33, 100, [3, 7], [90, 10]).dump()
    assert Manifest.load(good, 33).weights == [90, 10]
    changed = json.loads(good) | {"crc32c": 1}
    for data, bits in ((good, 37), (good[:-5], 33), (json.dumps(changed).encode(), 33)):
        with pytest.raises(ManifestError):
            Manifest.load(data, bits)
    body = json.dumps({"bits": 33, "count": 3, "keys": [5], "weights": [3]})
    assert Manifest.load(json.dumps({"version": 2, "crc": zlib.crc32(body.encode()), "body": body}).encode(), 33).stride == 0
    assert crc32c(b"123456789") == 0xE3069283
    assert Manifest(33, 5, [1, 4, 9], [2, 2, 1], 2).check().stride == 2
    for bad in (Manifest(33, 5, [1, 4], [2, 3], 2), Manifest(33, 6, [1, 4], [3, 3], 3), Manifest(33, 5, [1, 4, 9], [1, 2, 2], 2), Manifest(33, 2, [3], [2], 0, 1, 0), Manifest(33, 2, [3], [2], 0, 2, None), Manifest(33, 2, [-3], [2])):
        with pytest.raises(ManifestError):
            bad.check()
    for bad in (Manifest(33, 3, [7, 3], [1, 2]), Manifest(33, 3, [1 << 33], [3]), Manifest(33, 3, [1], [2]), Manifest(33, 0, [1], [0])):
        with pytest.raises(ManifestError):
            bad.dump()


def test_verification(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "state long")
    for count in (2, 3):
        with pytest.raises(VerificationError):
            check_round(df, Manifest(33, count, [1], [count]))


def test_key_files(spark, tmp_path):
    (tmp_path / "a.longs").write_bytes(b"".join(k.to_bytes(8, "big", signed=True) for k in (-5, 0, 9)))
    assert sorted(r["key"] for r in read_key_files(spark, f"file://{tmp_path}/a.longs").collect()) == [-5, 0, 9]
    assert [(r["suffix"], r["files"], r["bytes"]) for r in file_sizes(spark, f"file://{tmp_path}").collect()] == [("longs", 1, 24)]
    (tmp_path / "b.longs").write_bytes((1).to_bytes(8, "big") * 2)
    with pytest.raises(Exception, match="increase"):
        read_key_files(spark, f"file://{tmp_path}/b.longs").collect()


def test_cli(spark, tmp_path):
    root = f"file://{tmp_path}/cli"
    out = io.StringIO()
    assert [run(["count", "-b", "CROSS33", "-d", root, "--verify-ready"], spark, out) for _ in range(3)] == [0, 0, 0]
    assert "Initialized round 1" in out.getvalue() and "round 2 -> 3" in out.getvalue()
    assert run(["stats", "-d", root], spark, out) == 0 and "Total" in out.getvalue()
    assert run(["stats", "-d", f"{root}-missing"], spark, out) == 1
    assert run(["count", "--help"], spark, out) == 0


@pytest.mark.parametrize("arguments", [["count"], ["fly", "-d", "x"], ["count", "-d", "x", "-w", "0"], ["count", "-d", "x", "-w", "257"], ["stats", "-d", "x", "-w", "3"], ["count", "-d", "x", "-b", "square"], ["count", "-d", " "]])
def test_wrong_arguments(arguments):
    with pytest.raises(UsageError):
        parse(arguments)
    assert run(arguments, out=io.StringIO()) == 2


def test_stats_table():
    assert stats_table([(1, 1), (2, 1234)]).splitlines()[-1] == "%-18s %20s" % ("Total", "1,235")


def test_files_in_order(spark, tmp_path):
    store = RoundStore(spark, f"file://{tmp_path}/order")
    keys = spark.range(0, 60_000, 3).selectExpr("id as state").repartition(5)
    written = store.write(1, keys, 7)
    assert order_faults(written) == (20_000, 0)
    assert [r["ordinal"] for r in numbered(written).orderBy("state").collect()] == list(range(20_000))
    m = sample_manifest(written, 33)
    assert (m.count, m.keys[:3], m.weights[:2], len(m.keys)) == (20_000, [0, 24, 48], [8, 8], 2500) and m.check()
    check_files(written, m)
    with pytest.raises(VerificationError, match="manifest"):
        check_files(written, Manifest(33, 1, [1], [1]))
    keys.coalesce(1).sortWithinPartitions("state").unionByName(spark.createDataFrame([(6,), (6,)], "state long").coalesce(1)).write.parquet(f"file://{tmp_path}/wrong")
    wrong = spark.read.schema("state long").parquet(f"file://{tmp_path}/wrong")
    assert order_faults(wrong) == (20_002, 2)
    with pytest.raises(VerificationError, match="above"):
        check_files(wrong, Manifest(33, 20_002, [0], [20_002]))
    assert order_faults(store.write(2, keys.where("state < 0"), 2)) == (0, 0)


def test_submitted_states_and_tasks(spark, tmp_path):
    e = Enumerator(spark, BOARDS["cross33"], f"file://{tmp_path}/counted")
    results = [e.run_one_round() for _ in range(6)]
    assert all(r.unique <= r.submitted <= r.generated and r.tasks >= 1 for r in results[1:])


def test_files_are_replaced_at_once(spark, tmp_path):
    files = RoundStore(spark, f"file://{tmp_path}/files").files
    files.make_root()
    files.write("a", b"one")
    files.write("a", b"two")
    files.write("b", b"three")
    assert files.read("a") == b"two"
    with pytest.raises(FileExistsError):
        files.rename("a", "b")
    with pytest.raises(OSError):
        files.rename("none", "c")
    assert sorted(n for n, _, _ in files.names() if n.endswith(".tmp")) == []


def test_key_files_keep_to_width_and_pegs(spark, tmp_path):
    (tmp_path / "k.longs").write_bytes(b"".join(k.to_bytes(8, "big") for k in (3, 5, 1 << 33 | 1)))
    path = f"file://{tmp_path}/k.longs"
    assert read_key_files(spark, path, bits=34, pegs=2).count() == 3
    for wrong, message in (({"bits": 33}, "33 bits"), ({"pegs": 3}, "3 bits set")):
        with pytest.raises(Exception, match=message):
            read_key_files(spark, path, **wrong).collect()


def test_launch_script(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    script = Path(__file__).resolve().parent.parent / "bin" / "stateloom"
    env = {"PATH": "/usr/bin:/bin", "PYTHON": sys.executable}
    wrong = subprocess.run([script, "count", "square", str(tmp_path)], env=env, capture_output=True, text=True)
    assert wrong.returncode == 2 and "unknown board" in wrong.stdout
    assert subprocess.run([script, "count"], env=env, capture_output=True).returncode not in (0, 1)


def test_check_of_order_takes_no_names_along(spark, tmp_path):
    from stateloom.sources import rounds

    store = RoundStore(spark, f"file://{tmp_path}/names")
    written = store.write(1, spark.range(30_000).select(F.col("id").alias("state")), 5)
    assert rounds._placed(written).dtypes == [("state", "bigint"), ("file", "bigint"), ("place", "bigint")]
    assert order_faults(written) == (30_000, 0)
    # files whose order is wrong though each is in order itself: the second holds what lies below the first
    turned = store.write_ranges(2, spark.range(0, 2000, 1, 2).select(((F.col("id") + 1000) % 2000).alias("state")))
    assert order_faults(turned) == (2000, 1)
    assert rounds._runs(np.array([7, 7, 7, -1, -1, 7]), np.array([0, 1, 5, 6, 7, 8])) == [(0, 2), (2, 3), (3, 5), (5, 6)]
    assert rounds._runs(np.array([], np.int64), np.array([], np.int64)) == []
