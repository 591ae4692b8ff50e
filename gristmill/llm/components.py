"""Connected components of a link table by alternating stars, all on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import Scratch

#: Links that a task contracts at a time before anything is shuffled.
CONTRACT_ROWS = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each run of links by stars with the same components."""

    def stars(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            if a != b:
                a, b = min(a, b), max(a, b)
                parent[b] = a
        found = [(x, root(x)) for x in parent]
        return pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(held) >= CONTRACT_ROWS:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id`` and ``component_id`` (the smallest id reachable) of every id that a row (a, b) of ``links`` links.

    Links are undirected longs; loops, repeats and nulls do no harm. Each round hangs every neighbour on the
    smallest one, first the larger neighbours, then the smaller, and is written to the shared folder. Minima are
    aggregated before they are shuffled, and joins on an id with very many links are split by Spark.
    """
    scratch = Scratch(links.sparkSession, "components")
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInArrow(_contract, "a long, b long")
    edges = scratch.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "round0")
    before = None
    for k in range(max_rounds):
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.hint("merge").join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = large.hint("merge").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = scratch.put(lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"round{k + 1}")
        scratch.drop(f"round{k}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return stars.unionByName(stars.select(F.col("component_id").alias("id"), "component_id").distinct())
