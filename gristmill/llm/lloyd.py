"""Plain Lloyd rounds on integer vectors: exact, and the same however the rows are dealt.

Components become integers, so sums over partitions are exact in any order. Every round broadcasts the centroids (k rows of
``dimension`` numbers), each partition sends back k rows of counts and sums, and those merge through ``groupBy``. Nothing that
grows with the input reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to this size of a component, squared distances of any two vectors of up to 1 024 components fit a long.
NARROW = 1 << 25
#: Integers beyond a long have no place in the result: vectors with such a component aren't kept.
WIDEST = 1 << 63
#: Numbers of a batch's table of differences that are held at a time.
HELD = 1 << 20


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, in double precision and then as an integer."""
    return np.floor(scale * vectors).astype(np.int64)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (points x centroids): longs, or Python integers where a long could overflow."""
    wide = max(np.abs(a).max(initial=0) if a.dtype == object else max(int(a.max(initial=0)), -int(a.min(initial=0))) for a in (points, centroids)) > NARROW
    if wide:
        points, centroids = points.astype(object), centroids.astype(object)
    out = np.zeros((len(points), len(centroids)), dtype=points.dtype)
    step = max(1, HELD // max(1, centroids.size))
    for at in range(0, len(points), step):
        apart = points[at : at + step, None, :] - centroids[None, :, :]
        out[at : at + step] = (apart * apart).sum(2)
    return out


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point, the lowest number among equals, and its squared distance."""
    apart = squared(points, centroids)
    cluster = apart.argmin(1)
    return cluster, apart[np.arange(len(points)), cluster]


def _points(part: pd.DataFrame, scale: int) -> np.ndarray:
    return integers(np.stack(part["vector"].to_numpy()).astype(np.float64), scale)


def _saturated(number: int) -> int:
    return min(int(number), WIDEST - 1)


def kept_vectors(vectors: DataFrame, dimension: int, scale: int) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.floor(F.abs(x)) < float("inf")) & (F.abs(x * F.lit(scale)) < float(WIDEST)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(F.coalesce((F.size("vector") == dimension) & fits, F.lit(False)))


def seeds(kept: DataFrame, k: int, scale: int, seed: str = "1") -> np.ndarray:
    """The integer vectors of the ``k`` rows with the smallest sha256 of ``<seed>:<vec_id>``, in that order.

    Rows of equal id come in the order of their components; those without id come after all others.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(k).collect()
    return integers(np.array([r["vector"] for r in rows], dtype=np.float64), scale) if rows else np.zeros((0, 0), np.int64)


def _sums(centroids, scale: int):
    """For each partition, a row for each of its clusters: rows, distance, and the sums of the components."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = centroids.value
        count, apart, sums = [0] * len(codes), [0] * len(codes), np.zeros(codes.shape, dtype=object)
        for part in parts:
            points = _points(part, scale)
            cluster, distance = nearest(points, codes)
            for c in np.unique(cluster):
                own = cluster == c
                count[c] += int(own.sum())
                apart[c] += sum(distance[own].tolist())
                # 2**31 rows of a batch would still fit where components are narrow
                sums[c] += (points[own] if np.abs(points[own]).max(initial=0) <= NARROW else points[own].astype(object)).sum(0)
        met = [c for c in range(len(codes)) if count[c]]
        columns = {"cluster": met, "n": [count[c] for c in met], "apart": [Decimal(apart[c]) for c in met]}
        yield pd.DataFrame(columns | {f"s{d}": [Decimal(int(sums[c][d])) for c in met] for d in range(codes.shape[1])})

    return run


def _totals(kept: DataFrame, codes: np.ndarray, scale: int) -> list:
    """One pass: count, distance and component sums of every non-empty cluster (k rows at most)."""
    spark, d = kept.sparkSession, codes.shape[1]
    held = spark.sparkContext.broadcast(codes)
    kind = "cluster int, n long, apart decimal(38,0), " + ", ".join(f"s{i} decimal(38,0)" for i in range(d))
    sums = [F.sum(c).alias(c) for c in ("n", "apart", *[f"s{i}" for i in range(d)])]
    rows = kept.mapInPandas(_sums(held, scale), kind).groupBy("cluster").agg(*sums).collect()
    held.destroy()
    return rows


def lloyd(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept row of ``vectors`` (vec_id, embedding).

    Kept are vectors of exactly ``dimension`` components, none null or non-finite; a component x becomes the integer
    floor(scale * x). Centroids start at :func:`seeds`; if fewer than ``k`` vectors are kept, there are as many centroids. In each of
    ``rounds`` rounds every vector goes to the nearest centroid (ties: the smaller number), and every non-empty centroid moves to the
    floor of its vectors' exact mean; empty ones stay. Then vectors are assigned once more.

    Rows with equal ids, or none, are vectors of their own. Components whose integer passes a long leave their vector out;
    distances and inertias that pass a long are given as the largest long, while the nearest centroid is found exactly. Other
    columns aren't read; an empty table gives an empty result. ``vectors`` is read ``rounds`` + 3 times.
    """
    kept = kept_vectors(vectors, dimension, scale)
    codes = seeds(kept, k, scale, seed)
    if not len(codes):
        kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], kind)
    for _ in range(rounds):
        for row in _totals(kept, codes, scale):
            codes[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dimension)]
    inertia = [0] * len(codes)
    for row in _totals(kept, codes, scale):
        inertia[row["cluster"]] = int(row["apart"])
    each, whole = [_saturated(x) for x in inertia], _saturated(sum(inertia))
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in codes]
    held = vectors.sparkSession.sparkContext.broadcast((codes, each, names))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, each, names = held.value
        for part in parts:
            cluster, distance = nearest(_points(part, scale), codes)
            if distance.dtype == object:
                distance = np.array([_saturated(x) for x in distance], np.int64)
            yield pd.DataFrame({"vec_id": part["vec_id"].astype("Int64"), "cluster": cluster.astype(np.int32), "distance": distance, "cluster_inertia": np.array(each, np.int64)[cluster], "inertia": np.full(len(part), whole, np.int64), "centroid_sha256": np.array(names, object)[cluster]})

    return kept.mapInPandas(assign, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
