import time

from stateloom.llm.storage import CLEANUP, Scratch


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    before, scratch = shuffle_files(spark), Scratch(spark, "cleanup")
    kept = scratch.keep(spark.range(1000).repartition(3, "id").groupBy("id").count(), "counts")
    until = time.monotonic() + 20
    while (left := shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left
    assert kept.count() == 1000
    assert spark.conf.get(CLEANUP, None) in (None, "false")  # as it was


def test_a_setting_of_the_session_stays(spark):
    spark.conf.set(CLEANUP, "true")
    try:
        Scratch(spark, "cleanup").keep(spark.range(3), "ids")
        assert spark.conf.get(CLEANUP) == "true"
    finally:
        spark.conf.unset(CLEANUP)
