"""Writes as relations: upserts, partial and guarded updates, idempotent inserts, sweeps. Each gives the table's next state."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], *, keep: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """``current`` with the rows of ``incoming``: new keys are added, known ones get its values.

    Columns in ``keep`` stay as they were on a known key; those in ``fill`` stay where the new value is null. ``incoming`` has one
    row for each key (see :func:`last_write`).
    """
    values = [c for c in current.columns if c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"__{c}") for c in values], F.lit(True).alias("__in"))
    met = current.withColumn("__was", F.lit(True)).join(new, keys, "full_outer")

    def value(c: str) -> Column:
        old, now = F.col(c), F.col(f"__{c}")
        changed = F.col("__was").isNotNull() & F.col("__in").isNotNull()
        if c in keep:
            return F.when(F.col("__was").isNotNull(), old).otherwise(now)
        if c in fill:
            return F.when(changed, F.coalesce(now, old)).when(F.col("__in").isNotNull(), now).otherwise(old)
        return F.when(F.col("__in").isNotNull(), now).otherwise(old)

    return met.select(*keys, *[value(c).alias(c) for c in values])


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def patch(current: DataFrame, patches: DataFrame, key: str, columns: list[str], always: list[str] = ()) -> DataFrame:
    """``current`` with the non-null values of ``patches``; columns in ``always`` take its value, null too."""
    new = patches.select(key, *[F.col(c).alias(f"__{c}") for c in [*columns, *always]], F.lit(True).alias("__in"))
    met = current.join(new, key, "left")
    value = lambda c: F.when(F.col("__in").isNotNull(), F.col(f"__{c}") if c in always else F.coalesce(f"__{c}", c)).otherwise(F.col(c))
    return met.select(*[(value(c) if c in [*columns, *always] else F.col(c)).alias(c) for c in current.columns])


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` and the rows of ``incoming`` whose keys it lacks, one for each key; rows with a null key always go in."""
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    fresh = incoming.where(known).dropDuplicates(keys).join(current.select(*keys), keys, "left_anti").select(*current.columns)
    return current.unionByName(fresh).unionByName(incoming.where(~known).select(*current.columns))


def guarded_update(current: DataFrame, attempts: DataFrame) -> DataFrame:
    """``outcome`` of each attempt (id, owner, generation): applied, with generation + 1, or conflict."""
    met = attempts.alias("a").join(current.select("id", F.col("owner").alias("held_by"), F.col("generation").alias("held_generation")), "id", "left")
    won = F.coalesce((F.col("owner") == F.col("held_by")) & (F.col("generation") == F.col("held_generation")), F.lit(False))
    return met.select("id", F.when(won, "applied").otherwise("conflict").alias("outcome"), F.when(won, F.col("generation") + 1).otherwise(F.col("held_generation")).alias("generation"))


def claim(states: DataFrame) -> DataFrame:
    """``claim`` of each row (owner, compatible, state): busy, incompatible, blocked or claimed, in this order."""
    c = F.col
    return states.withColumn("claim", F.when(c("owner").isNotNull(), "busy").when(~c("compatible"), "incompatible").when(c("state") == "blocked", "blocked").otherwise("claimed"))


def recovered(jobs: DataFrame) -> DataFrame:
    """``status`` after a crash: what was queued or running is an error."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "error").otherwise(F.col("status")))


def pruned(rows: DataFrame, before: Column) -> DataFrame:
    """Open rows without owner older than ``before`` lose their payload and become invalidated."""
    old = F.col("owner").isNull() & F.col("state").isin("active", "ready") & (F.col("at") < before)
    return rows.withColumn("payload", F.when(~F.coalesce(old, F.lit(False)), F.col("payload"))).withColumn("state", F.when(old, "invalidated").otherwise(F.col("state")))


def last_writes(writes: DataFrame, key: str, order: str) -> DataFrame:
    """The last of the ``writes`` of each ``key`` in the order of ``order``; rows without a key are nobody's and go."""
    whole = F.struct(*writes.columns)
    return writes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max_by(whole, order).alias("w")).select("w.*")


def marked_posted(reviews: DataFrame, marks: DataFrame) -> DataFrame:
    """``reviews`` (review_id, posted, review_url and more) with those of ``marks`` (review_id, review_url) posted; a mark without an address keeps the one that is there.

    Marks of reviews that don't exist change nothing; of several marks of a review the largest address counts.
    """
    told = marks.where("review_id IS NOT NULL").groupBy("review_id").agg(F.max("review_url").alias("__url"), F.lit(True).alias("__marked"))
    met = reviews.join(told, "review_id", "left")
    return met.select(*[F.when(F.col("__marked"), F.lit(1)).otherwise(F.col(c)).alias(c) if c == "posted" else F.coalesce("__url", c).alias(c) if c == "review_url" else F.col(c) for c in reviews.columns])
