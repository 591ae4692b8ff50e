"""Shards of near-equal size by best-fit-decreasing bin packing of indivisible groups.

Documents of equal text form a group that no shard boundary cuts. Best fit needs only how many groups there are of each
size, since groups of one size are interchangeable: the driver packs that histogram - its length is bounded by rounding
sizes up to 12 significant bits, at most 2 048 sizes a power of two - and hands back, for each size, which run of ranks
goes to which shard. Ranks, assignment and slots are worked out on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._shared import staged

#: Plan rows above which the plan is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 500_000


class _Node:
    __slots__ = ("key", "level", "left", "right")

    def __init__(self, key):
        self.key, self.level, self.left, self.right = key, 1, None, None


class CapacityTree:
    """A balanced (AA) tree of (remaining capacity, bin): finds the tightest bin that still has room."""

    def __init__(self):
        self.root = None

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        node, best = self.root, None
        while node:
            if node.key[0] >= size:
                node, best = node.left, node.key
            else:
                node = node.right
        return best

    @staticmethod
    def _skew(t):
        if t and t.left and t.left.level == t.level:
            s = t.left
            t.left, s.right = s.right, t
            return s
        return t

    @staticmethod
    def _split(t):
        if t and t.right and t.right.right and t.right.right.level == t.level:
            r = t.right
            t.right, r.left = r.left, t
            r.level += 1
            return r
        return t

    def _add(self, t, key):
        if t is None:
            return _Node(key)
        if key < t.key:
            t.left = self._add(t.left, key)
        else:
            t.right = self._add(t.right, key)
        return self._split(self._skew(t))

    def _remove(self, t, key):
        if t is None:
            return None
        if key == t.key:
            if t.left is None or t.right is None:
                return t.left or t.right
            after = t.right
            while after.left:
                after = after.left
            t.key = after.key
            t.right = self._remove(t.right, after.key)
        elif key < t.key:
            t.left = self._remove(t.left, key)
        else:
            t.right = self._remove(t.right, key)
        least = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
        if least < t.level:
            t.level = least
            if t.right and t.right.level > least:
                t.right.level = least
        t = self._skew(t)
        t.right = self._skew(t.right)
        if t.right:
            t.right.right = self._skew(t.right.right)
        t = self._split(t)
        t.right = self._split(t.right)
        return t


def best_fit(histogram: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first rank, end rank, bin) of best fit decreasing; None if ``bins`` bins don't hold everything.

    Placing one group into the tightest bin leaves that bin the tightest, so a run of equal groups goes there
    until it is full: the result is that of placing them one by one. A size above ``capacity`` gets bins of its own.
    """
    tree, made, runs = CapacityTree(), 0, []
    for size, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            found = tree.tightest(size)
            if found is None:
                if bins is not None and made == bins:
                    return None
                found = (max(capacity, size), made)
                made += 1
            else:
                tree.remove(found)
            room, at = found
            n = min(count - rank, room // size)
            runs.append((size, rank, rank + n, at))
            rank += n
            tree.add((room - n * size, at))
    return runs


def level_fit(histogram: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Best fit decreasing into ``bins`` bins at the least capacity, to within 1/4 096, at which it fits.

    A group larger than an even share takes a bin alone, and the share of the others is reckoned anew.
    """
    left, total, runs, free = {s: n for s, n in histogram}, sum(s * n for s, n in histogram), [], bins
    for size, count in sorted(histogram, reverse=True):
        taken = 0
        while taken < count and free > 1 and size * free > total:
            runs.append((size, taken, taken + 1, bins - free))
            taken, total, free = taken + 1, total - size, free - 1
        left[size] -= taken
        if taken < count:
            break
    alone = {s: n - left[s] for s, n in histogram}
    rest = [(s, n) for s, n in left.items() if n]
    share, step = -(-total // free), 1
    while rest:
        capacity = max(share + share * step // 4096, max(s for s, _ in rest))
        if (packed := best_fit(rest, capacity, free)) is not None:
            return runs + [(s, a + alone[s], b + alone[s], at + bins - free) for s, a, b, at in packed]
        step = step + 1 if step < 8 else step * 2
    return runs


def rounded(size: Column, bits: int = 12) -> Column:
    """``size`` rounded up to ``bits`` significant bits."""
    length = F.length(F.bin(size))
    unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(length - bits, F.lit(0)))
    return (F.floor((size - 1) / unit).cast("bigint") + 1) * unit


def assign_shards(docs: DataFrame, n_shards: int | None = 40, *, capacity: int | None = None, text: str = "text", salts: int = 64, buckets: int = 1024) -> DataFrame:
    """``doc_id``, size, text_crc32, shard and slot of every row of ``docs``.

    Give ``n_shards`` for that many shards of near-equal bytes, or ``capacity`` (bytes) for as few shards as best fit
    makes. size: UTF-8 bytes of the text plus 16. Rows of equal text share a shard; null texts, 0 bytes, count as
    equal; repeated rows keep a slot each; ids may be null. slot counts from 0 without gaps within a shard. Columns other than
    ``doc_id`` and the text aren't read. An empty table gives an empty result.

    A hot group is counted by partial aggregation, and its rows are joined by a sort-merge join whose large partitions
    Spark splits. Ranks are counted in ``salts`` parts of a size and slots in ``buckets`` parts of a shard, each
    part offset by the counts of those before, so that no task sees a whole size or shard.
    """
    body = F.col(text)
    rows = staged(
        docs.select(
            F.col("doc_id"),
            (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("bigint").alias("size"),
            F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(body.cast("binary"))), F.lit(b"")).alias("key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("mass")).withColumn("class", rounded(F.col("mass"))).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    groups = staged(groups.drop("mass"), "shard-groups")
    histogram = [(r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()]
    runs = best_fit(histogram, capacity) if capacity else level_fit(histogram, n_shards)
    plan = docs.sparkSession.createDataFrame(runs, "class long, lo long, hi long, shard int")
    plan = F.broadcast(plan) if len(runs) <= BROADCAST_ROWS else plan

    parts = groups.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = groups.withColumn("inner", F.row_number().over(Window.partitionBy("class", "salt").orderBy("key")) - 1).join(parts, ["class", "salt"])
    ranked = ranked.select("key", "class", (F.col("first") + F.col("inner")).alias("rank"))
    placed = ranked.join(plan, "class").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("key", "shard")

    sharded = rows.hint("merge").join(placed, "key").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    sharded = staged(sharded.drop("key"), "shard-placed")
    cells = sharded.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    inner = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return sharded.withColumn("inner", inner).join(cells, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("inner")).cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, assignment: DataFrame, path: str) -> None:
    """Write ``docs`` to ``path``, a folder for each shard, in the order of the slots. ``doc_id`` must be a key here."""
    joined = docs.join(assignment.select("doc_id", "shard", "slot"), "doc_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
