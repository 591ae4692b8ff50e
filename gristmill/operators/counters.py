"""Rates of cumulative counters, and means of histograms kept as a sum and a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grown(value: Column, before: Column) -> Column:
    """What a counter gained since ``before``: all of it after a reset (a drop), nothing at its first sample."""
    return F.when(before.isNull(), 0.0).when(value < before, value).otherwise(value - before)


def increases(samples: DataFrame, by: list[str], value: str, width: str, order: list[str]) -> DataFrame:
    """``by``, window_start, increase, n of the counter ``value`` of each series ``by`` in tumbling windows of ``width``.

    A window's first sample is held against the last one before the window. Steps are taken within a window, so that a series with
    many samples is dealt out by time; only a row for each window meets its neighbours. Null times and values are passed over; equal times go
    by the rest of ``order``, which begins with ``ts``.
    """
    rows = samples.where(F.col("ts").isNotNull() & F.col(value).isNotNull()).withColumn("window_start", F.window("ts", width)["start"]).withColumn("__v", F.col(value).cast("double"))
    inner = rows.withColumn("__g", grown(F.col("__v"), F.lag("__v").over(Window.partitionBy(*by, "window_start").orderBy(*order))))
    place = F.struct(*order)
    per = inner.groupBy(*by, "window_start").agg(F.sum("__g").alias("__in"), F.min_by("__v", place).alias("__first"), F.max_by("__v", place).alias("__last"), F.count(F.lit(1)).alias("n"))
    carried = F.lag("__last").over(Window.partitionBy(*by).orderBy("window_start"))
    return per.withColumn("__c", carried).select(*by, "window_start", (F.col("__in") + grown(F.col("__first"), F.col("__c"))).alias("increase"), "n")


def rates(samples: DataFrame, by: list[str], value: str, width: str, seconds: float, order: list[str]) -> DataFrame:
    """:func:`increases` with ``per_second``."""
    return increases(samples, by, value, width, order).withColumn("per_second", F.col("increase") / F.lit(float(seconds)))


def means(samples: DataFrame, by: list[str], total: str, count: str, width: str, order: list[str]) -> DataFrame:
    """``by``, window_start, observations, mean: the gain of ``total`` over the gain of ``count``; mean is null where nothing was observed."""
    sums = increases(samples, by, total, width, order).select(*by, "window_start", F.col("increase").alias("sum"))
    counts = increases(samples, by, count, width, order).select(*by, "window_start", F.col("increase").alias("observations"))
    met = sums.join(counts, [*by, "window_start"])
    return met.select(*by, "window_start", "observations", F.when(F.col("observations") > 0, F.col("sum") / F.col("observations")).alias("mean"))
