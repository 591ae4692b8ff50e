"""Phrases that words form more often than chance: vertical positional lists, extended word by word.

Texts become chunks: for a language, some two million words as numbers of the chunk's own dictionary, with marks where a piece
ends. In a chunk a phrase is the list of the positions where it starts, and the length of the list is its exact frequency there.
A level joins the lists of frequent phrases with the postings of the word that follows, by merging sorted positions, and sends
one row for each longer phrase of the chunk. Rows of all chunks meet by phrase: their sum is the frequency, and each chunk learns which of
its own phrases go on to the next level. So what is shuffled is a row for a phrase and chunk, never one for an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._shared import Scratch

#: Words of a chunk, about; texts are cut only where a piece ends.
CHUNK_WORDS = 1 << 21
#: Bytes of a text that are cut into words at a time.
SLICE_BYTES = 1 << 22
#: Stands for the end of a piece; no UTF-8 text holds this byte.
MARK = b"\xff"
#: A-Z in lower case, and all ends of pieces as marks.
BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + MARK * 10)
#: A word's number: the chunk where it is first met, then its place in that chunk's dictionary (below 2 ** 27).
PLACE_BITS, SERIAL_BITS = 27, 16
#: Rows of one batch that a chunk sends.
ROWS = 100_000


class _Numbers(dict):
    """Numbers of words in the order in which they are first met; a mark is -1."""

    def __init__(self) -> None:
        super().__init__({MARK: -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def slices(text: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """``text`` with its marks, in slices that end at a mark as long as there is one."""
    marked, at = text.translate(BYTES), 0
    while len(marked) - at > size:
        end = marked.rfind(MARK, at, at + size)
        end = end if end > at else marked.find(MARK, at + size)
        if end < 0:
            break
        yield marked[at:end]
        at = end
    yield marked[at:]


class _Chunk:
    def __init__(self) -> None:
        self.numbers, self.words, self.size = _Numbers(), [], 0

    def add(self, text: bytes) -> None:
        found = text.replace(MARK, b" \xff ").split()
        found.append(MARK)
        self.words.append(np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found)))
        self.size += len(found)

    def row(self) -> tuple:
        words = np.concatenate(self.words)
        names = list(self.numbers)[1:]
        return names, np.bincount(words[words >= 0], minlength=len(names)), words.tobytes()


def _chunks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, held = TaskContext.get().partitionId() << SERIAL_BITS, {}

        def rows(langs: list) -> Iterator[pa.RecordBatch]:
            nonlocal serial
            for lang in langs:
                names, counts, words = held.pop(lang).row()
                yield pa.RecordBatch.from_pydict(
                    {"chunk": pa.array([serial], pa.int64()), "lang": pa.array([lang], pa.string()), "names": pa.array([names], pa.list_(pa.binary())), "counts": pa.array([counts], pa.list_(pa.int64())), "words": pa.array([words], pa.binary())}
                )
                serial += 1

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                lang = lang.as_py()
                for part in slices(text.as_py()):
                    chunk = held.setdefault(lang, _Chunk())
                    chunk.add(part)
                    if chunk.size >= limit:
                        yield from rows([lang])
                if len(held) > 1 and sum(c.size for c in held.values()) >= 2 * limit:
                    yield from rows(sorted(held, key=lambda name: -held[name].size)[: 1 + len(held) // 2])
        yield from rows(list(held))

    return run


def occurrences(words: np.ndarray, phrases: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Where (ascending) which row of ``phrases`` (distinct rows of word numbers) starts in ``words``: the lists of a level.

    Lists of first words are merged with the postings of the second, and so on; no mark is part of a phrase.
    """
    m = phrases.shape[1]
    follows = np.concatenate([words, np.full(m, -1, words.dtype)])
    first = np.full(vocabulary + 1, -1, np.int64)  # a mark looks up the last place
    first[phrases[:, 0]] = phrases[:, 0]
    code = first[words]
    at = np.flatnonzero(code >= 0)
    code, own = code[at], phrases[:, 0].astype(np.int64)
    for j in range(1, m):
        keys = own * vocabulary + phrases[:, j]
        known = np.unique(keys)
        then = follows[at + j]
        wanted = code * vocabulary + then
        place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        met = (known[place] == wanted) & (then >= 0)
        at, code, own = at[met], place[met], np.searchsorted(known, keys)
    row = np.zeros(int(own.max(initial=0)) + 1, np.int64)
    row[own] = np.arange(len(phrases))
    return at, row[code]


def extended(words: np.ndarray, phrases: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases one word longer whose first and last words both form one of ``phrases``: row of the first, last word, list length."""
    m = phrases.shape[1]
    at, which = occurrences(words, phrases, vocabulary)
    i = np.flatnonzero(at[1:] == at[:-1] + 1)  # lists merged with those that start one word later
    keys, counts = np.unique(which[i] * vocabulary + words[at[i] + m], return_counts=True)
    return keys // vocabulary, keys % vocabulary, counts


def _extend(m: int):
    """Rows (chunk, w1 ... wm, n) of the phrases of m words that extend a chunk's frequent phrases."""
    names = ["chunk", *[f"w{k + 1}" for k in range(m)], "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, words = batch.column("chunk")[k].as_py(), np.frombuffer(batch.column("words")[k].as_buffer(), np.int32)
                known = batch.column("known")[k].values
                place, word = (known.field(n).to_numpy(zero_copy_only=False) for n in ("place", "word"))
                order = np.argsort(word)
                by_word, by_place = word[order], place[order]
                if m == 2:
                    phrases = by_place[:, None]
                else:
                    held = batch.column("phrases")[k].values
                    columns = [held.field(f"w{j + 1}").to_numpy(zero_copy_only=False) for j in range(m - 1)]
                    phrases = np.stack([by_place[np.searchsorted(by_word, c)] for c in columns], 1)
                vocabulary = batch.column("vocabulary")[k].as_py()
                ids = np.zeros(vocabulary, np.int64)
                ids[place] = word
                row, last, counts = extended(words, phrases, vocabulary)
                for at in range(0, len(row), ROWS):
                    some = slice(at, at + ROWS)
                    columns = [*ids[phrases[row[some]]].T, ids[last[some]], counts[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[-1]), chunk)), *[pa.array(np.ascontiguousarray(c)) for c in columns]], names)

    return run, ", ".join(f"{n} long" for n in names)


class Counts:
    """What :func:`count_phrases` finds: ``words`` (id, lang, word, f), ``phrases`` (ws, f) of two words and more, ``totals`` (lang, n)."""

    def __init__(self, words: DataFrame, phrases: DataFrame, totals: DataFrame):
        self.words, self.phrases, self.totals = words, phrases, totals


def count_phrases(docs: DataFrame, scratch: Scratch, *, max_words: int, min_count: int, chunk_words: int) -> Counts:
    """Exact frequencies, in each language, of all words and of phrases of up to ``max_words`` words that occur ``min_count`` times.

    A phrase that frequent has frequent parts alone, so a level extends frequent phrases only.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chunks = scratch.put(texts.mapInArrow(_chunks(chunk_words), "chunk long, lang string, names array<binary>, counts array<long>, words binary"), "chunks")
    totals = scratch.put(chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")), "totals")
    own = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("names", "counts")).alias("place", "met"))
    own = own.select("chunk", "lang", "place", F.col("met.names").cast("string").alias("word"), F.col("met.counts").alias("n"), F.shiftleft("chunk", PLACE_BITS).bitwiseOR(F.col("place").cast("long")).alias("own"))
    alike = Window.partitionBy("lang", "word")
    held = own.withColumn("f", F.sum("n").over(alike)).withColumn("id", F.min("own").over(alike)).where(F.col("f") >= min_count)
    held = scratch.put(held.select("chunk", "lang", "place", "word", "f", "id", (F.col("id") == F.col("own")).alias("first")), "words")
    words = held.where("first").select("id", "lang", "word", "f")
    # what a chunk knows: at most as many words as its dictionary holds
    known = held.groupBy("chunk").agg(F.collect_list(F.struct("place", F.col("id").alias("word"))).alias("known"))
    chunks = scratch.put(chunks.select("chunk", "words", F.size("names").cast("long").alias("vocabulary")).join(known, "chunk"), "known")
    scratch.drop("chunks")
    levels = []
    for m in range(2, max_words + 1):
        keys = [f"w{k + 1}" for k in range(m)]
        run, kind = _extend(m)
        rows = chunks if m == 2 else chunks.join(levels[-1].groupBy("chunk").agg(F.collect_list(F.struct(*keys[:-1])).alias("phrases")), "chunk")
        rows = rows.mapInArrow(run, kind)
        if m < max_words:
            alike = Window.partitionBy(*keys)
            rows = rows.withColumn("f", F.sum("n").over(alike)).withColumn("first", F.col("chunk") == F.min("chunk").over(alike)).where(F.col("f") >= min_count).drop("n")
        else:
            rows = rows.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count).withColumn("first", F.lit(True))
        levels.append(scratch.put(rows, f"level{m}"))
    phrases = None
    for m, level in enumerate(levels, 2):
        part = level.where("first").select(F.array(*[f"w{k + 1}" for k in range(m)]).alias("ws"), "f")
        phrases = part if phrases is None else phrases.unionByName(part)
    return Counts(words, phrases, totals)


def scored(found: Counts) -> DataFrame:
    """ws, a, l, r, score of every phrase: of its cut that scores least, the first of those that score alike."""
    parts = found.words.select(F.array("id").alias("ws"), "f").unionByName(found.phrases)
    cuts = found.phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)))
    cuts = cuts.select("ws", F.col("f").alias("a"), "k", F.slice("ws", F.lit(1), F.col("k")).alias("head"), F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")).alias("tail"))
    cuts = cuts.join(parts.select(F.col("ws").alias("head"), F.col("f").alias("l")), "head").join(parts.select(F.col("ws").alias("tail"), F.col("f").alias("r")), "tail")
    wide = {n: F.col(n).cast("decimal(19,0)") for n in ("a", "l", "r")}
    cuts = cuts.withColumn("over", wide["a"] * wide["a"] * F.lit(1_000_000)).withColumn("under", wide["l"] * wide["r"]).withColumn("score", F.expr("over div under"))
    least = cuts.groupBy("ws", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return least.select("ws", "a", "c.l", "c.r", "c.score")


def without_parts(phrases: DataFrame, percent: int) -> DataFrame:
    """``phrases`` (ws, a and more) but for those that a longer one holds with at least ``percent`` hundredths of their frequency."""
    within = phrases.select(F.col("a").alias("longer"), "ws", F.explode(F.sequence(F.lit(1), F.size("ws"))).alias("i"), F.size("ws").alias("m"))
    within = within.select("longer", "ws", "i", F.explode(F.when(F.least(F.col("m") - 1, F.col("m") + 1 - F.col("i")) >= 2, F.sequence(F.lit(2), F.least(F.col("m") - 1, F.col("m") + 1 - F.col("i"))))).alias("size"))
    most = within.groupBy(F.slice("ws", F.col("i"), F.col("size")).alias("ws")).agg(F.max("longer").alias("longer"))
    return phrases.join(most, "ws", "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, *, max_words: int = 3, min_count: int = 10, percent: int = 50, limit: int = 2_000, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``limit`` phrases of each language of ``docs`` (lang, text).

    Texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those into words ``[^\\x20\\x09]+``, A-Z in lower case. ``a`` is how often
    a phrase of 2 to ``max_words`` words occurs, at least ``min_count`` times; ``l`` and ``r`` are those of the two parts of the cut with the least
    floor(1000000 * a * a / (l * r)), exact as long as a stays below 10 ** 15; ``n`` are all words of the language. Phrases inside a longer one that has at least
    ``percent`` hundredths of their frequency go. Order: score, a, both descending, then the phrase by its UTF-8 bytes.

    A null ``lang`` is ``und``, a null text is empty; repeated rows count each. Very long texts are cut where a piece ends. Other columns
    aren't read; an empty table, or one without frequent phrases, gives an empty result.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    scratch = Scratch(docs.sparkSession, "collocations")
    found = count_phrases(docs, scratch, max_words=max_words, min_count=min_count, chunk_words=chunk_words)
    kept = without_parts(scored(found), percent)
    spelled = kept.select("ws", "a", "l", "r", "score", F.posexplode("ws").alias("i", "id")).join(found.words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ws", "lang", "a", "l", "r", "score").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = spelled.withColumn("rank", place.cast("long")).where(F.col("rank") <= limit)
    out = first.join(found.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out = scratch.put(out, "result")
    scratch.drop("words", "known", "totals", *[f"level{m}" for m in range(2, max_words + 1)])
    return out
