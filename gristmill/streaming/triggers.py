"""Triggers and metrics as streams: settle windows, tumbling rates, journals that take each call once.

Streams are bounded by a watermark; what comes later than it is dropped. The batch forms in
:mod:`gristmill.operators.activity` give the same rows for closed windows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators import activity

#: Parts of a journal by a hash of its keys.
BUCKETS = 256


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Files of events that appear in ``folder`` as a stream, with ``ts`` as an instant."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def settle_windows(triggers: DataFrame, delay: str = "30 seconds", lateness: str = "1 minute") -> DataFrame:
    """One row for each closed run of triggers (key, ts): see :func:`gristmill.operators.activity.debounced`."""
    return activity.debounced(triggers.withWatermark("ts", lateness), delay)


def metric_rates(events: DataFrame, width: str = "1 hour", seconds: int = 3600, lateness: str = "1 hour") -> DataFrame:
    """Counts, rates and averages of closed tumbling windows of events (ts, name, value)."""
    return activity.rates(events.withWatermark("ts", lateness), width, seconds)


def journal(usage: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("attempt", "seq"), order: list[str] | None = None, buckets: int = BUCKETS):
    """Append each (attempt, seq) of a stream once to the Parquet table at ``path``; a batch that runs again adds nothing.

    The table is parted by ``bucket``, a hash of the keys, and a batch is held against its own buckets alone, so that a small batch doesn't
    read the whole history; ``batch`` tells which micro-batch wrote a row. Of rows with equal keys in a batch the first in ``order`` stays (by default in the order of all
    columns). Rows with a null among their keys can't be told apart: all go in, to bucket -1. :func:`compact_journal` puts the small files together.
    """
    unknown = reduce(or_, [F.col(k).isNull() for k in keys])
    bucket = F.when(unknown, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*keys), F.lit(buckets))).cast("int")

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or batch.columns)))
        fresh = batch.withColumn("bucket", bucket).withColumn("batch", F.lit(number).cast("long"))
        fresh = fresh.where("bucket >= 0").withColumn("__place", place).where("__place = 1").drop("__place").unionByName(fresh.where("bucket < 0")).persist()
        new = fresh
        if _exists(spark, path):
            met = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
            held = spark.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(met))
            again = not held.where((F.col("bucket") < 0) & (F.col("batch") == number)).isEmpty()
            new = fresh.where("bucket >= 0").join(held.where("bucket >= 0").select("bucket", *keys), ["bucket", *keys], "left_anti")
            new = new if again else new.unionByName(fresh.where("bucket < 0"))
        new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
        fresh.unpersist()

    return usage.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def compact_journal(spark: SparkSession, path: str) -> None:
    """The journal at ``path`` with one file a bucket. It is written beside, then takes the old one's place; not to be run while a stream appends."""
    beside, hadoop = f"{path.rstrip('/')}-compacted", spark.sparkContext._jvm.org.apache.hadoop.fs
    spark.read.parquet(path).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(beside)
    old, new = hadoop.Path(path), hadoop.Path(beside)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(new, old)
