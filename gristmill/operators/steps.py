"""Helpers of plans in several steps: results that are settled before they are read again, and ranks without one task a key."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; one of our own only for a local master that names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def source_mark(spark: SparkSession, path: str) -> str:
    """A name for a table as it is now: a hash of its path and of its files' names, sizes and times."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, seen = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join([path, *sorted(seen)]).encode()).hexdigest()[:32]


def settled(df: DataFrame) -> DataFrame:
    """``df`` by a reliable checkpoint: computed once, and safe when executors are lost.

    The folder is the session's; one of our own is set only for a local master that names none.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="gristmill-"))
    return df.checkpoint()


def ranges_of(rows: DataFrame, order: str, parts: int = 256) -> Column:
    """Which of ``parts`` ranges of equal width the number in ``order`` lies in; one aggregate over ``rows``."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None or high == low:
        return F.lit(0)
    return F.least(F.floor((F.col(order) - F.lit(low)) * parts / F.lit(high - low)), F.lit(parts - 1)).cast("int")


def numbered(rows: DataFrame, by: str, part: Column, order: list, name: str) -> DataFrame:
    """``rows`` with their place (from 1) within ``by`` in the order of ``part``, then ``order``.

    Places are counted within each part of a key and offset by the counts of the parts before, so that no task sees a whole key.
    """
    parted = rows.withColumn("__part", part)
    counts = parted.groupBy(F.col(by).alias("__by"), F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__by").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__by", "__of", before.alias("__before"))
    inner = parted.withColumn("__inner", F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order)))
    met = inner.join(offsets, F.col(by).eqNullSafe(F.col("__by")) & F.col("__part").eqNullSafe(F.col("__of")))
    return met.select(*rows.columns, (F.col("__before") + F.col("__inner")).cast("long").alias(name))
