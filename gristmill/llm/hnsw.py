"""Nearest vectors by cosine through hierarchical navigable small-world graphs, one for each shard.

Vectors are dealt into shards by a hash; a shard's graph is built in one task from at most about :data:`SHARD` distinct vectors and is one
row of a table: vectors, link arrays of all layers and offsets as flat buffers. Nodes are numbered by falling level, so a layer
is a prefix of the nodes and its links a matrix of fixed width. Nodes enter in batches: a batch descends the finished layers
above, searches the links made so far, meets the batch's own earlier nodes directly, and links to a diverse choice of what it found.

Query blocks stream past each shard; every shard answers with its best, scored on the original vectors in double precision, and the answers of
all shards are merged by rank. Equal vectors are one node that carries the smallest of their ids, as many as an answer can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._shared import Scratch

#: Distinct vectors of a shard, about; a shard's graph is built and searched in the memory of one task.
SHARD = 8_192
#: Links of a node on the upper layers (twice as many on the lowest), and how widely building and searching look.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 64, 192
#: Nodes that enter a graph, or queries that search it, at a time; query blocks of a task that searches a shard.
BATCH, BLOCKS = 256, 64
#: Pads the ids of a node; no row may have it.
NO_ID = -(1 << 63)


def prepared(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(1, initial=0))
    return np.ldexp(vectors, -exponent[:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of prepared rows, each the same number wherever it is worked out."""
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes of each query that best-first search meets from its ``entry`` (numbers, similarities; -1 and -inf pad)."""
    n, rows = len(queries), np.arange(len(queries))
    found, near, open_ = np.full((n, width), -1), np.full((n, width), -np.inf), np.zeros((n, width), bool)
    seen = np.zeros((n, len(links)), bool)
    found[:, 0], near[:, 0], open_[:, 0] = entry, (vectors[entry] * queries).sum(1), True
    seen[rows, entry] = True
    while len(rows):
        best = np.where(open_[rows], near[rows], -np.inf).argmax(1)
        going = open_[rows, best]
        rows, best = rows[going], best[going]
        if not len(rows):
            break
        open_[rows, best] = False
        then = links[found[rows, best]]
        new = (then >= 0) & ~seen[rows[:, None], then]
        r, c = np.nonzero(new)
        seen[rows[r], then[r, c]] = True
        met = np.full(then.shape, -np.inf)
        met[r, c] = np.einsum("ij,ij->i", vectors[then[r, c]], queries[rows[r]])
        both = np.concatenate([near[rows], met], 1)
        order = np.argpartition(-both, width - 1, 1)[:, :width]
        at = rows[:, None]
        near[rows] = np.take_along_axis(both, order, 1)
        found[rows] = np.take_along_axis(np.concatenate([found[rows], then], 1), order, 1)
        open_[rows] = np.take_along_axis(np.concatenate([open_[at[:, 0]], new], 1), order, 1) & (near[rows] > -np.inf)
    found[near == -np.inf] = -1
    order = np.lexsort((found, -near), axis=1)
    return np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)


def diverse(vectors: np.ndarray, found: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """For each row of candidates (nearest first, -1 pads) up to ``links``: those nearer to the node than to any one chosen before; then the nearest of the rest."""
    n, width = found.shape
    own = vectors[found]
    apart = own @ own.transpose(0, 2, 1)
    chosen, count, real = np.zeros((n, width), bool), np.zeros(n, int), found >= 0
    closest = np.full((n, width), -np.inf)  # similarity to the nearest one chosen so far
    for k in range(width):
        take = real[:, k] & (near[:, k] > closest[:, k]) & (count < links)
        chosen[take, k] = True
        count += take
        closest[take] = np.maximum(closest[take], apart[take, k])
    order = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)) * width + np.arange(width)[None], 1)[:, :links]
    out = np.take_along_axis(found, order, 1)
    return np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)


class Graph:
    """Layers of a small-world graph over unit ``vectors``; ``layers[0]`` holds the links of all nodes, each further one those of a prefix."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def built(cls, vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 13) -> tuple[Graph, np.ndarray]:
        """The graph, and the order in which it numbers the rows of ``vectors``."""
        n = len(vectors)
        levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
        order = np.argsort(-levels, kind="stable")
        vectors, levels = vectors[order], levels[order]
        graph = cls(vectors, [])
        for level in range(levels[0], -1, -1):
            graph.layers.insert(0, graph._layer(int((levels >= level).sum()), links if level else 2 * links, width))
        return graph, order

    def _descend(self, queries: np.ndarray) -> np.ndarray:
        """The node from which each query goes on below the layers that stand."""
        entry = np.zeros(len(queries), int)
        for layer in reversed(self.layers):
            entry = beam(self.vectors, layer, queries, entry, 1)[0][:, 0]
        return entry

    def _layer(self, size: int, links: int, width: int) -> np.ndarray:
        made = np.full((size, links), -1, np.int32)
        above = len(self.layers[0]) if self.layers else 0
        at = 1
        while at < size:
            to = min(size, at + min(BATCH, at))
            if at < above:
                to = min(to, above)
            own = self.vectors[at:to]
            entry = self._descend(own) if at >= above and above else np.zeros(to - at, int)
            found, near = beam(self.vectors, made[:at], own, entry, min(width, at))
            among = np.where(np.tri(to - at, k=-1, dtype=bool), own @ own.T, -np.inf)
            found = np.concatenate([found, np.where(among > -np.inf, np.arange(at, to)[None], -1)], 1)
            near = np.concatenate([near, among], 1)
            order = np.lexsort((found, -near), axis=1)[:, :width]
            chosen = diverse(self.vectors, np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1), links)
            made[at:to] = chosen
            self._link_back(made, at, chosen, links)
            at = to
        return self._joined(made)

    def _link_back(self, made: np.ndarray, first: int, chosen: np.ndarray, links: int) -> None:
        """Nodes that were chosen link back; where that is too many, a diverse choice stays."""
        source, k = np.nonzero(chosen >= 0)
        target = chosen[source, k]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order] + first
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        for lot in np.array_split(np.argsort(count, kind="stable"), max(1, len(nodes) // 512)):  # nodes with about as many new links
            if not len(lot):
                continue
            more = np.full((len(lot), int(count[lot].max())), -1)
            row, column = np.repeat(np.arange(len(lot)), count[lot]), np.concatenate([np.arange(c) for c in count[lot]])
            more[row, column] = source[np.repeat(start[lot], count[lot]) + column]
            for at in range(0, more.shape[1], 3 * links):
                held = np.concatenate([made[nodes[lot]], more[:, at : at + 3 * links]], 1)
                near = np.where(held >= 0, np.einsum("ijk,ik->ij", self.vectors[held], self.vectors[nodes[lot]]), -np.inf)
                by = np.lexsort((held, -near), axis=1)
                held, near = np.take_along_axis(held, by, 1), np.take_along_axis(near, by, 1)
                full = (held >= 0).sum(1) > links
                made[nodes[lot[~full]]] = held[~full, :links]
                if full.any():
                    made[nodes[lot[full]]] = diverse(self.vectors, held[full], near[full], links)

    def _joined(self, made: np.ndarray) -> np.ndarray:
        """``made`` with links added in further columns until every node can be reached from the first."""
        while True:
            reached, rim = np.zeros(len(made), bool), np.array([0])
            reached[0] = True
            while len(rim):
                then = np.unique(made[rim])
                rim = then[(then >= 0) & ~reached[then]]
                reached[rim] = True
            apart = np.flatnonzero(~reached)
            if not len(apart):
                return made
            # each from its nearest node that is reached; one link of a node a round, in a column of its own
            apart, known = apart[:BATCH], np.flatnonzero(reached)
            nearest = known[(self.vectors[apart] @ self.vectors[known].T).argmax(1)]
            use, first = np.unique(nearest, return_index=True)
            more = np.full(len(made), -1, np.int32)
            more[use] = apart[first]
            made = np.concatenate([made, more[:, None]], 1)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Numbers of the ``width`` nearest nodes found for each unit query; -1 pads."""
        entry = np.zeros(len(queries), int)
        for layer in self.layers[:0:-1]:
            entry = beam(self.vectors, layer, queries, entry, 1)[0][:, 0]
        return beam(self.vectors, self.layers[0], queries, entry, width)[0]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null or empty, some component not zero, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


INDEX = "dim int, shard int, n int, ids binary, vectors binary, sizes binary, links binary"


def _build(links: int, width: int):
    """One row for each shard: its nodes' ids (a fixed number each, NO_ID pads) and vectors in node order, and all layers' links, flat."""

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        dim, shard = (k.as_py() for k in keys)
        table = table.sort_by("key")
        vectors = prepared(np.array(table["vector"].combine_chunks().flatten().to_numpy()).reshape(-1, dim))
        graph, order = Graph.built(_unit(vectors), links, width)
        ids = table["ids"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        sizes = np.array([layer.shape for layer in graph.layers], np.int32)
        flat = np.concatenate([layer.ravel() for layer in graph.layers]).astype(np.int32)
        return pa.table(
            {"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "n": pa.array([len(order)], pa.int32()), "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
             "vectors": pa.array([vectors[order].tobytes()], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()), "links": pa.array([flat.tobytes()], pa.binary())}
        )

    return run


class Shard:
    """A shard's row, ready to be searched."""

    def __init__(self, dim: int, n: int, ids: bytes, vectors: bytes, sizes: bytes, links: bytes):
        self.ids, self.vectors = np.frombuffer(ids, np.int64).reshape(n, -1), np.frombuffer(vectors).reshape(n, dim)
        layers, at, flat = [], 0, np.frombuffer(links, np.int32)
        for rows, wide in np.frombuffer(sizes, np.int32).reshape(-1, 2).tolist():
            layers.append(flat[at : at + rows * wide].reshape(rows, wide))
            at += rows * wide
        self.graph = Graph(_unit(self.vectors), layers)

    def answers(self, ids: np.ndarray, vectors: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id, score: the best ``k`` rows found for each query but its own id, ties by vec_id."""
        found = self.graph.search(_unit(vectors), max(width, k + 1))
        real = found >= 0
        score = np.where(real, cosines(vectors[:, None], self.vectors[found]), -np.inf)
        owner, node = np.nonzero(real)
        held = self.ids[found[owner, node]]
        row, copy = np.nonzero((held != NO_ID) & (held != ids[owner][:, None]))
        query, vec, score = owner[row], held[row, copy], score[owner, node][row]
        by = np.lexsort((vec, -score, query))
        query, vec, score = query[by], vec[by], score[by]
        first = np.arange(len(query)) - np.searchsorted(query, query) < k
        return ids[query[first]], vec[first], score[first]


def build_index(vectors: DataFrame, *, copies: int, shard_rows: int = SHARD, links: int = LINKS, width: int = BUILD_WIDTH) -> DataFrame:
    """A row (see :data:`INDEX`) for each shard of ``vectors`` (vec_id, embedding as doubles): all usable rows with an id are in it.

    A node stands for all rows of one vector and holds the ``copies`` smallest of their ids, none of which repeats.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    nodes = rows.distinct().withColumn("place", place).where(F.col("place") <= copies)
    nodes = nodes.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    ids = F.concat("ids", F.array_repeat(F.lit(NO_ID), F.lit(copies) - F.size("ids")))
    counts = {r["dim"]: r["n"] for r in nodes.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = F.lit(1)
    for dim, n in counts.items():
        shards = F.when(F.size("embedding") == dim, F.lit(-(-n // shard_rows))).otherwise(shards)
    dealt = nodes.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("embedding"), shards).cast("int").alias("shard"), F.xxhash64("embedding", F.lit(1)).alias("key"), F.col("embedding").alias("vector"), ids.alias("ids"))
    return dealt.groupBy("dim", "shard").applyInArrow(_build(links, width), INDEX)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks: up to :data:`BATCH` queries of one dimension, flat."""
    held: dict[int, tuple[list, list]] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids, vectors = held.pop(dim)
        return pa.RecordBatch.from_pydict(
            {"dim": pa.array([dim], pa.int32()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "vectors": pa.array([prepared(np.array(vectors, np.float64)).tobytes()], pa.binary())}
        )

    for batch in batches:
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids, vectors = held.setdefault(len(vector), ([], []))
            ids.append(vec_id)
            vectors.append(vector)
            if len(ids) >= BATCH:
                yield block(len(vector))
    for dim in list(held):
        yield block(dim)


def _searched(k: int, width: int):
    """Answers of each shard to the query blocks that follow it in the order of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shard = None
        for batch in batches:
            names = [batch.column(c) for c in ("dim", "shard", "lot", "n", "ids", "vectors", "sizes", "links")]
            for at in range(batch.num_rows):
                dim, number, lot, n, ids, vectors, sizes, links = (c[at].as_py() for c in names)
                if n is not None:
                    key, shard = (dim, number, lot), Shard(dim, n, ids, vectors, sizes, links)
                elif key == (dim, number, lot):
                    query, vec, score = shard.answers(np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, dim), k, width)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def nearest(vectors: DataFrame, *, every: int = 50, k: int = 5, shard_rows: int = SHARD, links: int = LINKS, build_width: int = BUILD_WIDTH, search_width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) with vec_id divisible by ``every`` its ``k`` nearest others found.

    Nearness is the cosine in double precision of the original vectors; ties go to the smaller vec_id. All usable rows are indexed; null,
    empty and zero vectors and those with null or non-finite components take no part, nor do rows without vec_id.
    Vectors of different dimensions never meet. Rows that repeat with id and vector count once; a query never meets its own id, and of
    several vectors with a query's id the one that sorts first asks. If there are fewer than ``k`` candidates, all are given.
    Other columns aren't read; an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "hnsw")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    index = scratch.put(build_index(rows, copies=k + 1, shard_rows=shard_rows, links=links, width=build_width), "index")
    asked = rows.where((F.col("vec_id") % every == 0) & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = scratch.put(asked.mapInArrow(_blocks, "dim int, ids binary, vectors binary"), "queries")
    lots = -(-blocks.count() // BLOCKS)
    lot = F.pmod(F.xxhash64("ids"), F.lit(max(1, lots))).cast("int")
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))  # one row a dimension
    none = {c: F.lit(None) for c in ("n", "sizes", "links")}
    guests = blocks.join(shards, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("shard"), lot.alias("lot"), none["n"].cast("int").alias("n"), "ids", "vectors", none["sizes"].cast("binary").alias("sizes"), none["links"].cast("binary").alias("links"))
    hosts = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, lots - 1)))).alias("lot"), "n", "ids", "vectors", "sizes", "links")
    met = hosts.unionByName(guests).repartition("dim", "shard", "lot").sortWithinPartitions("dim", "shard", "lot", F.col("n").isNull())
    answers = met.mapInArrow(_searched(k, search_width), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = scratch.put(answers.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "result")
    scratch.drop("index", "queries")
    return out
