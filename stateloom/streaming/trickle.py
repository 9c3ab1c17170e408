"""Tables read as streams: batches of new files are merged into totals as they come."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_root


def user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and summed value of each user, kept up by a stream over the events' files."""
    root = f"{shared_root(spark)}/totals-{uuid.uuid4().hex}"
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    # a stream reads a folder: a table that is one file is found in its parent's
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    events = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else source.parquet(path)

    def merge(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure replaces what it wrote
        part = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
        part.write.mode("overwrite").parquet(f"{root}/batches/batch={number}")

    stream = events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    parts = spark.read.schema("user_id long, events long, total double").parquet(f"{root}/batches")
    return parts.groupBy("user_id").agg(F.sum("events").alias("events"), F.round(F.sum("total"), 4).alias("total"))
