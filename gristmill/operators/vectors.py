"""A stored vector index that is searched exactly: cells with radii, left out only where the triangle inequality allows it.

Every vector lives in the cell of its nearest centre. ``cells`` has a row for each repository, cell and block of some thousand vectors: its centre,
the radius that holds the block, ids and vectors as flat buffers. A probe is first held against centres alone: a block at distance d
with radius r holds nothing nearer than d - r, and all it holds is nearer than d + r; so blocks that begin beyond the distance within which enough
vectors are sure to lie are never read. The rest is compared block by block, as products of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators.search import CANDIDATES, LIMIT, l2, ranked, valid_vector

#: Vectors of a block, about; vectors that centres are drawn from, and centres at most; probes of a block that are compared at a time.
BLOCK, SAMPLE, MOST_CENTRES, PROBES = 1_024, 8_192, 256, 256
CELLS = "repo_id string, cell int, block int, n bigint, centre array<double>, radius double, ids binary, vectors binary"


def _centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    centres = sample[np.random.default_rng(11).choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = _nearest(sample, centres)
        for c in np.unique(near):
            centres[c] = sample[near == c].mean(0)
    return centres


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * vectors @ centres.T).argmin(1)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


class VectorIndex:
    """The index in ``folder``, which driver and executors must share, of vectors of ``dimension`` numbers."""

    def __init__(self, spark: SparkSession, folder: str, dimension: int):
        self.spark, self.folder, self.dimension = spark, folder.rstrip("/"), dimension

    def exists(self) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/cells/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def cells(self) -> DataFrame:
        return self.spark.read.schema(CELLS).parquet(f"{self.folder}/cells")

    def build(self, vectors: DataFrame) -> VectorIndex:
        """Index all valid ``vectors`` (chunk_id, repo_id, embedding); others take no part, nor do rows without an id or repository."""
        d = self.dimension
        rows = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("repo_id").cast("string").alias("repo_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        rows = rows.where(valid_vector(F.col("embedding"), d) & F.col("chunk_id").isNotNull() & F.col("repo_id").isNotNull())
        n = rows.count()
        chance = F.pmod(F.xxhash64("chunk_id", "repo_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, n)))
        drawn = rows.where(chance).select("embedding").limit(2 * SAMPLE).toArrow().column(0).combine_chunks()
        centres = _centres(_matrix(drawn, d) if len(drawn) else np.zeros((1, d)), max(1, min(MOST_CENTRES, round(n**0.5 / 4))))
        held = self.spark.sparkContext.broadcast(centres)  # MOST_CENTRES rows at most

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell = _nearest(_matrix(batch.column(2), d), held.value)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

        def pack(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by("chunk_id")
            x, centre = _matrix(table["embedding"].combine_chunks(), d), held.value[key[1].as_py()]
            radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max())
            columns = [[k.as_py()] for k in key] + [[table.num_rows], [centre.tolist()], [radius], [table["chunk_id"].combine_chunks().to_numpy().tobytes()], [x.tobytes()]]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.binary(), pa.binary()]
            return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["repo_id", "cell", "block", "n", "centre", "radius", "ids", "vectors"])

        placed = rows.mapInArrow(place, "chunk_id long, repo_id string, embedding array<double>, cell int")
        sizes = placed.groupBy("repo_id", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
        dealt = placed.join(sizes, ["repo_id", "cell"]).withColumn("block", F.pmod(F.xxhash64("chunk_id"), "blocks").cast("int")).drop("blocks")
        dealt.groupBy("repo_id", "cell", "block").applyInArrow(pack, CELLS).write.mode("overwrite").parquet(f"{self.folder}/cells")
        held.destroy()
        return self

    def met(self, probes: DataFrame, limit: int) -> DataFrame:
        """query_id, repo_id, cell, block, n, probe: the blocks that ``probes`` (query_id, repo_id, probe) must be compared with."""
        heads = self.cells().select("repo_id", "cell", "block", "n", "centre", "radius")
        far = probes.select("query_id", "repo_id", F.col("probe").cast("array<double>").alias("probe")).join(heads, "repo_id").withColumn("d", l2(F.col("probe"), F.col("centre")))
        # sums of many squares end in other digits in another order: distances are known but for that
        slack = F.lit(1e-9) * (F.col("d") + F.col("radius") + 1)
        far = far.withColumn("low", F.col("d") - F.col("radius") - slack).withColumn("high", F.col("d") + F.col("radius") + slack)
        sure = F.sum("n").over(Window.partitionBy("query_id").orderBy("high", "repo_id", "cell", "block").rowsBetween(Window.unboundedPreceding, 0))
        within = F.min(F.when(F.col("sure") >= limit, F.col("high"))).over(Window.partitionBy("query_id"))
        return far.withColumn("sure", sure).withColumn("within", within).where(F.coalesce(F.col("low") <= F.col("within"), F.lit(True))).select("query_id", "repo_id", "cell", "block", "n", "probe")

    def nearest(self, probes: DataFrame, limit: int = LIMIT * CANDIDATES) -> DataFrame:
        """query_id, chunk_id, repo_id, distance, rank, score: the nearest ``limit`` vectors of each of ``probes`` (query_id, repo_id, probe) within its repositories.

        Exact; equal distances (to nine places) go by id. Probes of another dimension, or that aren't valid, find nothing.
        """
        d, valid = self.dimension, probes.where(valid_vector(F.col("probe"), self.dimension))
        lot = F.pmod(F.xxhash64("query_id"), F.greatest(F.ceil(F.col("asked") / F.lit(PROBES)), F.lit(1))).cast("int")
        met = self.met(valid, limit)
        asked = met.groupBy("repo_id", "cell", "block").agg(F.count(F.lit(1)).alias("asked"))
        lots = met.join(asked, ["repo_id", "cell", "block"]).groupBy("repo_id", "cell", "block", lot.alias("lot")).agg(F.collect_list(F.struct("query_id", "probe")).alias("probes"))
        rows = self.cells().select("repo_id", "cell", "block", "ids", "vectors").join(lots, ["repo_id", "cell", "block"]).select("repo_id", "ids", "vectors", "probes")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, x = np.frombuffer(batch.column("ids")[k].as_buffer(), np.int64), np.frombuffer(batch.column("vectors")[k].as_buffer()).reshape(-1, d)
                    held = batch.column("probes")[k].values
                    queries, p = held.field("query_id").to_numpy(zero_copy_only=False), _matrix(held.field("probe"), d)
                    rough = (p**2).sum(1)[:, None] - 2 * p @ x.T + (x**2).sum(1)[None]
                    slack = 1e-6 * (1 + (p**2).sum(1) + (x**2).sum(1).max())
                    most = min(limit, len(ids)) - 1
                    row, at = np.nonzero(rough <= np.partition(rough, most, 1)[:, most][:, None] + slack[:, None])
                    apart = np.sqrt(((p[row] - x[at]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(queries[row]), pa.array(ids[at]), pa.array([batch.column("repo_id")[k].as_py()] * len(row), pa.string()), pa.array(apart)], ["query_id", "chunk_id", "repo_id", "distance"])

        found = rows.mapInArrow(compare, f"query_id {valid.schema['query_id'].dataType.simpleString()}, chunk_id long, repo_id string, distance double")
        return ranked(found, [F.round("distance", 9), F.col("chunk_id")], limit).withColumn("score", 1 / (1 + F.col("distance")))
