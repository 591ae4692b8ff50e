"""Exact Jaccard join of word n-gram sets by prefix trees.

All n-grams stand in one global order: those that many documents share come last, by how many, the others by a hash.
Two sets that are similar enough share an n-gram among the first few of each (the prefix). The work goes in steps:

1. documents of equal sets are one class; only one of each class goes on;
2. a first round compares classes with one leader of each group that shares a minimum under one of a few other
   orders, and joins most copies at a linear cost;
3. the exact round lists the prefix n-grams that classes of different components share, counts for each pair how many it
   shares, drops pairs whose sizes, positions or counts rule the similarity out, and compares the rest;
4. comparing is done in groups of pairs that share one n-gram, in blocks of about ``GROUP`` members: the members' ordered sets
   form one prefix tree, all probes of the block walk it, shared beginnings are counted once for each probe, and a
   subtree is skipped as a whole when what remains of the sets in it can't reach the overlap.

Pairs already in one component by other links are not compared: the components are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._shared import Scratch, free_name
from gristmill.llm.components import components

#: Members that one prefix tree holds, about.
GROUP = 256
#: n-grams in the table of common ones, at most.
COMMON = 400_000
#: Documents counted at a time, and the share of them that must hold an n-gram for it to be listed.
CHUNK_DOCS, COMMON_SHARE = 8_000, 0.00025
#: Orders other than the global one whose minima name leaders.
MINIMA = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes than that are hashed one by one.
LONG_WORD = 1_024


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of ``words``: eight bytes at a time through the finaliser, all words at once; very long ones by BLAKE2."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    joined = b"".join(words) + bytes(8)
    eights = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    hashes = _mix(sizes.astype(np.uint64) * _ODD)
    for at in range(0, min(int(sizes.max(initial=0)), LONG_WORD), 8):
        left = np.flatnonzero(sizes > at)
        keep = np.minimum(sizes[left] - at, 8).astype(np.uint64)
        some = eights[starts[left] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - keep) * np.uint64(8)))
        hashes[left] = _mix((hashes[left] ^ some) * _ODD + np.uint64(at + 1))
    for k in np.flatnonzero(sizes > LONG_WORD):
        hashes[k] = int.from_bytes(hashlib.blake2b(words[k], digest_size=8).digest(), "little")
    return hashes


def ngram_keys(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 62-bit hashes of the word ``n``-grams of ``text``.

    Words are runs of other than ASCII white space, with A-Z in lower case. A text of fewer than ``n`` words has the whole
    sequence as its one n-gram; one without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    step = 100_000  # very long texts go in pieces that overlap by n - 1 words
    if len(words) > step + n:
        return np.unique(np.concatenate([_keys(words[k : k + step + n - 1], n) for k in range(0, len(words) - n + 1, step)]))
    return _keys(words, n)


def _keys(words: list[bytes], n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        hashes, n = _word_hashes(words), min(n, len(words))
        many = len(words) - n + 1
        keys = _mix(hashes[:many] + np.uint64(n))
        for k in range(1, n):
            keys = _mix(keys * _ODD ^ hashes[k : k + many])
    return np.unique((keys >> np.uint64(2)).astype(np.int64))


class Order:
    """The global order: common n-grams are renumbered past all hashes, the most common last."""

    def __init__(self, common: np.ndarray):
        """common: hashes from the least to the most common."""
        self.rank = np.argsort(common)
        self.sorted = common[self.rank]

    def apply(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.sorted) or not len(keys):
            return keys
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        common = self.sorted[at] == keys
        if not common.any():
            return keys
        return np.concatenate([keys[~common], np.sort((1 << 62) + self.rank[at[common]])])


def required(nx, ny, percent: int):
    """Least intersection of two sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (nx + ny) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class PrefixTree:
    """Ordered sets as a prefix tree, laid out as the sorted list of its branches and where each leaves the one before."""

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.members = sorted(members, key=lambda m: m[1].astype(">i8").tobytes())
        self.sizes = np.array([len(own) for _, own in self.members], np.int64)
        shared = [0]
        for (_, a), (_, b) in zip(self.members, self.members[1:], strict=False):
            n = min(len(a), len(b))
            apart = np.flatnonzero(a[:n] != b[:n])
            shared.append(int(apart[0]) if len(apart) else n)
        self.shared = np.array(shared, np.int64)

    def similar(self, probe: np.ndarray, percent: int, step: int = 128) -> Iterator[int]:
        """Ids of the members with 100 * intersection >= percent * union with ``probe``."""
        n, at = len(probe), 0
        path = np.zeros(0, np.int64)  # overlap after each n-gram of the current branch, as far as it was counted
        while at < len(self.members):
            path = path[: self.shared[at]]
            key, own = self.members[at]
            while True:
                depth = len(path)
                have, ahead = (int(path[-1]), n - int(np.searchsorted(probe, own[depth - 1], "right"))) if depth else (0, n)
                if have + min(len(own) - depth, ahead) < required(n, len(own), percent):
                    at = self._next(at, depth, have, ahead, n, percent)
                    break
                if depth == len(own):
                    yield key
                    at += 1
                    break
                some = own[depth : depth + step]
                found = np.minimum(np.searchsorted(probe, some), n - 1)
                path = np.concatenate([path, have + np.cumsum(probe[found] == some)])

    def _next(self, at: int, depth: int, have: int, ahead: int, n: int, percent: int) -> int:
        """The branch after ``at`` to walk: the first of its subtree from ``depth`` on that can still reach the overlap, or else the one after that subtree."""
        outside = np.flatnonzero(self.shared[at + 1 :] < depth)
        end = at + 1 + int(outside[0]) if len(outside) else len(self.members)
        sizes = self.sizes[at + 1 : end]
        able = np.flatnonzero(have + np.minimum(sizes - depth, ahead) >= required(n, sizes, percent))
        return at + 1 + int(able[0]) if len(able) else end


def common_ngrams(docs: DataFrame, n: int, scratch: Scratch) -> np.ndarray:
    """Hashes of the n-grams that most documents share, the most common last; at most ``COMMON``.

    Every task lists those that a share of a chunk of its documents hold (equal documents of a chunk counted once); the
    sums over all documents decide. The table only orders the n-grams, so its bound never costs a pair.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(parts: list[np.ndarray]) -> pa.RecordBatch:
            keys = np.concatenate(parts)
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            counts = np.diff(np.concatenate([first, [len(keys)]]))
            many = counts >= max(2, int(np.ceil(COMMON_SHARE * len(parts))))
            return pa.RecordBatch.from_pydict({"key": pa.array(keys[first[many]], pa.int64()), "n": pa.array(counts[many], pa.int64())})

        parts, seen, held = [], set(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text or (mark := hash(text)) in seen:
                    continue
                seen.add(mark)
                parts.append(ngram_keys(text, n))
                held += len(parts[-1])
                if len(parts) >= CHUNK_DOCS or held > 5_000_000:
                    yield listed(parts)
                    parts, seen, held = [], set(), 0
        if parts:
            yield listed(parts)

    counted = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = scratch.put(counted, "ngram-common")
    sizes = counted.groupBy(F.floor(F.log2("n") * 16).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    kept, least = 0, None
    for level, size in sorted(((r["level"], r["n"]) for r in sizes), reverse=True):
        if (kept := kept + size) > COMMON:
            break
        least = level
    if least is None:
        return np.zeros(0, np.int64)
    found = counted.where(F.floor(F.log2("n") * 16) >= least).toArrow()
    scratch.drop("ngram-common")
    keys, counts = found["key"].to_numpy(), found["n"].to_numpy()
    return keys[np.lexsort((keys, counts))].astype(np.int64)


def _profiles(docs: DataFrame, n: int, percent: int, common) -> DataFrame:
    """doc_id, size of the set, how many of it aren't common, a digest of it, its prefix, and its minima under the other orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(common.value)
        seeds = [np.uint64(int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest(), "little")) for k in range(MINIMA)]
        for batch in batches:
            size, digest, prefix, minima, rare = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                keys = ngram_keys(text, n)
                size.append(len(keys))
                if not len(keys):
                    digest.append(None)
                    prefix.append([])
                    minima.append([])
                    rare.append(0)
                    continue
                digest.append(hashlib.blake2b(keys.tobytes(), digest_size=16).digest())
                minima.append([int(keys[_mix(keys.astype(np.uint64) ^ s).argmin()]) for s in seeds])
                ordered = order.apply(keys)
                rare.append(int(np.searchsorted(ordered, 1 << 62)))
                prefix.append(ordered[: prefix_length(len(keys), percent)])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array(size, pa.int64()), "rare": pa.array(rare, pa.int64()), "digest": pa.array(digest, pa.binary()), "prefix": pa.array(prefix, longs), "minima": pa.array(minima, longs)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, rare long, digest binary, prefix array<long>, minima array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int, common) -> DataFrame:
    """The rows (probe, member, key) of ``pairs`` that are similar, and others found on the way, as links (a, b).

    ``key`` is an n-gram that both share; a pair has one. The members of a key are dealt over blocks of about ``GROUP``, so
    that a key of very many members is spread over tasks; a block holds one prefix tree, and each probe that has a
    pair in it walks it once, however many pairs those are. A text is sent once to each block it belongs to.
    """
    members = pairs.select("key", "member").distinct()
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block")
    placed = members.hint("merge").join(sizes, "key").select("key", block, F.col("member").alias("doc_id"), F.lit(0).alias("role"))
    probes = pairs.hint("merge").join(sizes, "key").select("key", block, F.col("probe").alias("doc_id"), F.lit(1).alias("role")).distinct()
    texts = docs.select("doc_id", "text").hint("merge").join(placed.unionByName(probes), "doc_id")
    grouped = texts.select("key", "block", "role", "doc_id", "text").repartition("key", "block").sortWithinPartitions("key", "block", "role", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, at, members, tree = Order(common.value), None, [], None
        for batch in batches:
            probes, found = [], []
            for key, block, role, doc, text in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if (key, block) != at:
                    at, members, tree = (key, block), [], None
                own = order.apply(ngram_keys(text, n))
                if role == 0:
                    members.append((doc, own))
                    continue
                tree = tree or PrefixTree(members)
                met = [m for m in tree.similar(own, percent) if m != doc]
                probes += [doc] * len(met)
                found += met
            yield pa.RecordBatch.from_pydict({"a": pa.array(probes, pa.int64()), "b": pa.array(found, pa.int64())})

    return grouped.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (doc_id long, text).

    Documents link when 100 * intersection >= ``percent`` * union of their n-gram sets; ``component_id`` is the smallest
    doc_id that links reach, the own one included. n-grams are compared by 62-bit hashes of their words, in which no
    text is known to collide. Null texts and texts without
    words have no n-gram and link with nothing. Rows of one doc_id count as one document, so they share a component; a row without
    id has its count and no component. Other columns aren't read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    staged = scratch.put
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = spark.sparkContext.broadcast(common_ngrams(docs, n, scratch))
    profiles = staged(_profiles(docs, n, percent, common), "ngram-profiles")
    counts = staged(profiles.select("doc_id", "n"), "ngram-counts")

    with_set = profiles.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = with_set.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    copies = with_set.select("doc_id", "digest").hint("merge").join(classes.where("copies > 1"), "digest").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    heads = with_set.join(classes.select("digest", F.col("head").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest"])
    heads = staged(heads.drop("digest"), "ngram-heads")
    copies = staged(copies, "ngram-copies")
    scratch.drop("ngram-profiles")
    close = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent

    # first round: members against the leader of their group, the one with the fewest n-grams of its own: copies that were
    # changed differ less from their source than from each other
    groups = heads.select("doc_id", "n", "rare", F.posexplode("minima").alias("k", "key"))
    leaders = groups.groupBy("k", "key").agg(F.min(F.struct("rare", "doc_id", "n")).alias("first"), F.count(F.lit(1)).alias("held")).where("held > 1").select("k", "key", F.col("first.doc_id").alias("probe"), F.col("first.n").alias("m"))
    star = groups.hint("merge").join(leaders, ["k", "key"]).where((F.col("doc_id") != F.col("probe")) & close(F.col("n"), F.col("m")))
    star = staged(star.groupBy("probe", F.col("doc_id").alias("member")).agg(F.min("key").alias("key")), "ngram-star")
    links = staged(copies.unionByName(_verified(docs, star, n, percent, common)), "ngram-links")
    joined = staged(components(links), "ngram-joined")
    scratch.drop("ngram-star", "ngram-copies", "ngram-links")

    # exact round: prefix n-grams that different components share
    entries = heads.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component"), F.posexplode("prefix").alias("at", "key"))
    shared = entries.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    # before: how many shared n-grams stand before this one in the same set; the others can't be in common
    before = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    entries = staged(entries.hint("merge").join(shared, "key").withColumn("before", before), "ngram-entries")
    scratch.drop("ngram-heads")
    left, right = (entries.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "component", "at", "before")]) for s in "xy")
    need = F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100 + percent) - 1e-9)
    reach = F.least("before_x", "before_y") + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    met = left.hint("merge").join(right, "key").where(
        (F.struct("n_x", "doc_id_x") < F.struct("n_y", "doc_id_y")) & (F.col("component_x") != F.col("component_y")) & close(F.col("n_x"), F.col("n_y")) & (reach >= need)
    )
    counted = met.groupBy("doc_id_x", "doc_id_y").agg(F.first("n_x").alias("n_x"), F.first("n_y").alias("n_y"), F.count(F.lit(1)).alias("met"), F.min("key").alias("key"))
    # common n-grams up to the end of either prefix were all met; beyond it at most the rest of that set is common
    rest = lambda size: F.ceil(size * percent / 100) - 1
    pairs = counted.where(F.col("met") + F.greatest(rest(F.col("n_x")), rest(F.col("n_y"))) >= need)
    pairs = staged(pairs.select(F.col("doc_id_x").alias("probe"), F.col("doc_id_y").alias("member"), "key"), "ngram-pairs")
    scratch.drop("ngram-entries")
    more = staged(_verified(docs, pairs, n, percent, common), "ngram-links")
    whole = staged(components(joined.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more)), "ngram-components")
    scratch.drop("ngram-pairs", "ngram-links", "ngram-joined")
    found = counts.select("doc_id", F.col("n").alias("n_shingles")).join(whole.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those whose component holds a smaller doc_id; all columns stay.

    Documents that link with nothing stay, and so do rows without id. No name of a column of ``docs`` can clash.
    """
    own, gone = docs.columns, free_name(docs.columns, "gone")
    found = jaccard_components(docs, n=n, percent=percent).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == found[gone], "left_anti").select(*own)
