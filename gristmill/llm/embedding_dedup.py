"""Near-duplicate vectors of equal label through an inverted multi-index.

The two halves of every unit vector have a codebook each, and the pairs of nearest codewords form a product grid of cells. A
vector visits the cells of the grid in the order of the sum of its halves' squared distances to the codewords - the
multi-sequence traversal, a heap over the two sorted lists - for as many cells as the target recall needs, and is compared in
double precision with the vectors that live there. How many cells that is, is measured on the sample: its vectors are turned by
the threshold angle in random directions, and the rank of the cell in which they then live is counted.

Codebooks come from a bounded sample, and grow with the square root of the number of vectors so that cells stay small; every
vector is indexed, and every one visits. Cells of a row of the grid are put together into blocks, large ones split, and a
visitor is sent to the blocks that hold cells it visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._shared import Scratch
from gristmill.llm.components import components

#: Vectors that the codebooks are fitted on, at most about so many; and for each codeword, if there are more of those.
SAMPLE, SAMPLE_EACH = 4_096, 32
#: Codewords of a half, at most: as many as let about PER_CELL vectors live in a cell.
MOST_CODEWORDS, PER_CELL = 256, 64
TARGET_RECALL = 0.98
#: Vectors that live in one block of cells, about.
BLOCK = 512
#: Ids of classes of which no row has one stand beyond all real ids, from here on.
NO_ID = 1 << 62


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Codewords of ``points`` by Lloyd's rounds from a seeded start."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    codes = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = distances(points, codes).argmin(1)
        sums = np.zeros_like(codes)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=k)
        codes = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], codes)
    return codes


def distances(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ codes.T + (codes**2).sum(1)[None], 0)


def traverse(first: np.ndarray, second: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The ``count`` cells (i, j) with the least first[i] + second[j], nearest first (multi-sequence traversal)."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap, cells, reached = [(x[0] + y[0], 0, 0)], [], [0] * (len(x) + 1)
    reached[0] = 1
    while heap and len(cells) < count:
        _, i, j = heapq.heappop(heap)
        cells.append((int(a[i]), int(b[j])))
        # (i, j + 1) follows in its row; (i + 1, j) opens or goes on with the next row
        if j + 1 < len(y) and (i == 0 or reached[i - 1] > j + 1) and reached[i] == j + 1:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            reached[i] = j + 2
        if i + 1 < len(x) and reached[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
            reached[i + 1] = j + 1
    return cells


class MultiIndex:
    """Two codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, threshold: float, codewords: int = 16, target: float = TARGET_RECALL, seed: int = 7):
        self.half = sample.shape[1] // 2
        # what is visited is measured on vectors that the codewords weren't fitted on
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(sample))
        apart = min(1_024, len(sample) // 2) if codewords > 1 else 0
        probes, fitted = sample[order[:apart]], sample[order[apart:]]
        self.codes = [kmeans(fitted[:, : self.half], codewords, seed=seed), kmeans(fitted[:, self.half :], codewords, seed=seed + 1)]
        if not apart:
            self.visits = len(self.codes[0]) * len(self.codes[1])
            return
        noise = rng.normal(size=probes.shape)
        noise -= (noise * probes).sum(1)[:, None] * probes
        noise /= np.maximum(np.linalg.norm(noise, axis=1)[:, None], 1e-300)
        turned = threshold * probes + np.sqrt(1 - threshold**2) * noise
        own, (d1, d2) = self.cells(turned), self.spread(probes)
        at = d1[np.arange(len(probes)), own[:, 0]] + d2[np.arange(len(probes)), own[:, 1]]
        ranks = [int((a[:, None] + b[None, :] <= t).sum()) for a, b, t in zip(d1, d2, at, strict=True)]
        self.visits = int(np.ceil(np.quantile(ranks, target)))

    def spread(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(unit[:, : self.half], self.codes[0]), distances(unit[:, self.half :], self.codes[1])

    def cells(self, unit: np.ndarray) -> np.ndarray:
        d1, d2 = self.spread(unit)
        return np.stack([d1.argmin(1), d2.argmin(1)], 1)


def _unit(vectors: list, even: int) -> np.ndarray:
    """Unit rows in double precision, padded by zeros to ``even`` columns."""
    x = np.zeros((len(vectors), even))
    for k, v in enumerate(vectors):
        x[k, : len(v)] = v
    x /= np.abs(x).max(1)[:, None]  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1)[:, None]


def codewords_for(n: int) -> int:
    """Codewords of a half for ``n`` vectors: one, and so a single cell in which all are compared, while they fit in a block."""
    return 1 if n <= BLOCK else min(MOST_CODEWORDS, round((n / PER_CELL) ** 0.5))


def _index(classes: DataFrame, index: MultiIndex, even: int) -> DataFrame:
    """A row (role 0) for the cell in which each class lives, with all the cells that it visits, and one (role 1) for each row of the grid that it visits, with the columns of its cells there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across = len(index.codes[1])
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                some = batch.slice(at, 1_024)
                unit = _unit(some.column("embedding").to_pylist(), even)
                own, (d1, d2) = index.cells(unit), index.spread(unit)
                rows, row_of, role, visits, columns = [], [], [], [], []
                for k in range(len(unit)):
                    cells, home = traverse(d1[k], d2[k], index.visits), (int(own[k, 0]), int(own[k, 1]))
                    if home not in cells:
                        cells.append(home)
                    by_row: dict[int, list[int]] = {}
                    for i, j in cells:
                        by_row.setdefault(i, []).append(j)
                    rows += [k] * (1 + len(by_row))
                    row_of += [home[0], *by_row]
                    role += [0] + [1] * len(by_row)
                    visits += [np.array(sorted(i * across + j for i, j in cells), np.int32).tobytes()] + [None] * len(by_row)
                    columns += [[home[1]], *by_row.values()]
                home = (own[:, 0] * across + own[:, 1]).astype(np.int32)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": some.column("label").take(take),
                        "cell_row": pa.array(row_of, pa.int32()),
                        "role": pa.array(role, pa.int32()),
                        "id": some.column("id").take(take),
                        "copies": some.column("copies").take(take),
                        "home": pa.array(home[rows], pa.int32()),
                        "columns": pa.array(columns, pa.list_(pa.int32())),
                        "visits": pa.array(visits, pa.binary()),
                        "unit": pa.array([unit[k].tobytes() for k in rows], pa.binary()),
                    }
                )

    label = dict(classes.dtypes)["label"]
    return classes.mapInArrow(run, f"label {label}, cell_row int, role int, id long, copies long, home int, columns array<int>, visits binary, unit binary")


def _dealt(visits: DataFrame) -> DataFrame:
    """``visits`` with the block in which a class lives (role 0), or once for each block with a cell that it visits (role 1)."""
    cells = visits.where("role = 0").groupBy("label", "cell_row", F.col("columns")[0].alias("column")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label", "cell_row").orderBy("column").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.lit(1)).cast("int")
    placed = cells.select("label", "cell_row", F.struct("column", F.floor(before / F.lit(BLOCK)).cast("int").alias("first"), blocks.alias("blocks")).alias("cell"))
    rows = placed.groupBy("label", "cell_row").agg(F.collect_list("cell").alias("cells"))  # at most as many as there are codewords
    met = F.filter("cells", lambda c: F.array_contains("columns", c["column"]))
    lives = F.transform(met, lambda c: c["first"] + F.pmod(F.xxhash64("id"), c["blocks"]).cast("int"))
    looks = F.array_distinct(F.flatten(F.transform(met, lambda c: F.sequence(c["first"], c["first"] + c["blocks"] - 1))))
    known = visits.join(rows, ["label", "cell_row"])
    return known.withColumn("block", F.explode(F.when(F.col("role") == 0, lives).otherwise(looks))).drop("cells")


def _compared(dealt: DataFrame, threshold: float, across: int) -> DataFrame:
    """For every block: links counted for each class (id, links), and a class linked with it (other) as a hint for components.

    A pair that is found from both sides is counted once for each end: the visitor counts in its own visit, and the resident
    here only if it doesn't visit the visitor's cell itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, living, held = None, [], None

        def hold() -> tuple:
            ids, copies, home, _, visits, unit = zip(*living, strict=True)
            sizes = [len(v) // 4 for v in visits]
            codes = np.repeat(np.arange(len(ids), dtype=np.int64), sizes) * (1 << 32) + np.frombuffer(b"".join(visits), np.int32)
            return np.array(ids), np.array(copies), np.array(home), np.sort(codes), np.frombuffer(b"".join(unit)).reshape(len(ids), -1)

        def compare(guests: list[tuple]) -> pa.RecordBatch:
            ids, copies, home, codes, unit = held
            g_ids, g_copies, g_home, g_columns, _, g_unit = zip(*guests, strict=True)
            g_ids, g_copies, g_home = np.array(g_ids), np.array(g_copies), np.array(g_home)
            looks = np.zeros((len(guests), across), bool)
            for k, columns in enumerate(g_columns):
                looks[k, columns] = True
            linked = (np.frombuffer(b"".join(g_unit)).reshape(len(guests), -1) @ unit.T >= threshold) & looks[:, home % across] & (g_ids[:, None] != ids[None])
            at_g, at_r = np.nonzero(linked)
            if not len(at_g):
                return None
            wanted = at_r.astype(np.int64) * (1 << 32) + g_home[at_g]
            found = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
            one_way = codes[found] != wanted
            for_g = np.bincount(at_g, weights=copies[at_r], minlength=len(g_ids)).astype(np.int64)
            for_r = np.bincount(at_r[one_way], weights=g_copies[at_g[one_way]], minlength=len(ids)).astype(np.int64)
            low_g, low_r = g_ids.copy(), ids.copy()
            while True:  # the smallest id of each connected part of this block
                before = (low_g.copy(), low_r.copy())
                np.minimum.at(low_r, at_r, low_g[at_g])
                np.minimum.at(low_g, at_g, low_r[at_r])
                if (before[0] == low_g).all() and (before[1] == low_r).all():
                    break
            use_g, use_r = np.unique(at_g), np.unique(at_r)
            out = {"id": np.concatenate([g_ids[use_g], ids[use_r]]), "other": np.concatenate([low_g[use_g], low_r[use_r]]), "links": np.concatenate([for_g[use_g], for_r[use_r]])}
            return pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in out.items()})

        for batch in batches:
            guests: list[tuple] = []
            for label, row, block, role, *rest in zip(*[batch.column(k).to_pylist() for k in range(10)], strict=True):
                if (label, row, block) != key:
                    if guests and held and (found := compare(guests)):
                        yield found
                    key, living, held, guests = (label, row, block), [], None, []
                if role == 0:
                    living.append(tuple(rest))
                    continue
                if held is None and living:
                    held = hold()
                if held is not None:
                    guests.append(tuple(rest))
                    if len(guests) >= 512:
                        if found := compare(guests):
                            yield found
                        guests = []
            if guests and held and (found := compare(guests)):
                yield found

    ordered = dealt.select("label", "cell_row", "block", "role", "id", "copies", "home", "columns", "visits", "unit")
    return ordered.repartition("label", "cell_row", "block").sortWithinPartitions("label", "cell_row", "block", "role").mapInArrow(run, "id long, other long, links long")


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.93, sample: int = SAMPLE, codewords: int | None = None, target: float = TARGET_RECALL) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their dimensions are equal, and their cosine in double precision is at least
    ``threshold``; none below it links. Null or empty vectors, zero vectors and those with a null or non-finite component link with
    nothing. Equal vectors are one class with a count, so copies are never paired. ``n_links`` counts other rows;
    repeated rows count as rows. ``component_id`` is the smallest vec_id that links reach; rows without vec_id count and link
    like others, have no component and aren't kept. Other columns aren't read; an empty table gives an empty result.

    ``codewords``: of each half; by default by the number of vectors (:func:`codewords_for`).
    """
    scratch = Scratch(vectors.sparkSession, "embedding-dedup")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    classes = rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    beyond = F.lit(NO_ID) + F.pmod(F.xxhash64("label", "embedding"), F.lit(NO_ID))
    classes = scratch.put(classes.withColumn("id", F.coalesce("id", beyond)), "vector-classes")
    facts = classes.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    parts = []
    for d, n in sorted((r["d"], r["n"]) for r in facts):
        own, even = classes.where(F.size("embedding") == d), max(2, d + d % 2)
        wide = codewords or codewords_for(n)
        wanted = max(sample, SAMPLE_EACH * wide)
        chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / n))
        drawn = own.where(chance).select("embedding").limit(2 * wanted).toArrow()["embedding"].to_pylist() or own.select("embedding").limit(1).toArrow()["embedding"].to_pylist()
        index = MultiIndex(_unit(drawn, even), threshold, wide, target)
        # staged, so that a row's cells are worked out once
        visits = scratch.put(_index(own, index, even), "vector-visits")
        parts.append(_compared(_dealt(visits), threshold, len(index.codes[1])))
    own_links = classes.select("id", (F.col("copies") - 1).alias("links"))
    if parts:
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
        found = scratch.put(found, "vector-links")
        scratch.drop("vector-visits")
        links = own_links.unionByName(found.select("id", "links")).groupBy("id").agg(F.sum("links").alias("links"))
        joined = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
        links = links.join(joined, "id", "left").select("id", "links", F.coalesce("component_id", "id").alias("component"))
    else:
        links = own_links.select("id", "links", F.col("id").alias("component"))
    by_class = classes.select("label", "embedding", "id").join(links, "id").select("label", "embedding", "links", "component")
    paired = rows.where("fit").hint("merge").join(by_class, ["label", "embedding"], "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    alone = rows.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return paired.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
