"""Language of whole texts by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams (one to three letters, words bounded by a space) in order. A document's own
n-grams are ranked the same way; the out-of-place distance adds up how far each stands from its place in the profile,
and a full profile length for each that the profile lacks. The nearest profile gives the language.

Profiles are learned from a bounded sample: about ``sample_docs`` labelled rows of each language, taken by a hash of
the id. The prediction reads the text alone.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of each language that the profiles are learned from, at most about so many; and languages that are learned at most.
SAMPLE_DOCS, LANGUAGES = 3_000, 1_000
PROFILE = 400
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter: 1, or a mark, which belongs to the letter before it: 2; built once a process.

    Planes 4 to 16 hold no letter and no mark but for the variation selectors of plane 14.
    """
    if not _LETTERS:
        kinds = {"L": 1, "M": 2}
        found = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
        found[:0x40000] = [kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x40000)]
        found[0xE0100:0xE01F0] = 2
        _LETTERS.append(found)
    return _LETTERS[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to three characters of ``text`` and their counts.

    An n-gram is its code points packed 21 bits each. What isn't a letter counts as a space, and runs of spaces as one.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    kind = _letters()[points]
    if not (kind == 1).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = kind > 0
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of other characters
    points = np.concatenate([[32], points[keep], [32]])
    points = points[1:] if points[1] == 32 else points
    points = points[:-1] if points[-2] == 32 else points
    two = (points[:-1] << 21) | points[1:]
    three = (two[:-1] << 21) | points[2:]
    grams = np.concatenate([points[points != 32], two, three[points[1:-1] != 32]])
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.concatenate([first, [len(grams)]]))


def top_grams(text: str, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams of ``text``, most frequent first; equals by their code points."""
    grams, counts = gram_counts(text)
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        chosen = counts >= least
        grams, counts = grams[chosen], counts[chosen]
    return grams[np.argsort(-counts, kind="stable")][:size]


class Profiles:
    """Language profiles, ready for distances."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.names = sorted(ranked)
        self.grams, self.ranks = [], []
        for name in self.names:
            grams = np.array(ranked[name][:size], dtype=np.int64)
            order = np.argsort(grams)
            self.grams.append(grams[order])
            self.ranks.append(order.astype(np.int64))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Mean out-of-place distance of ranked n-grams to each profile, from 0 (the same order) to 1 (none in common)."""
        places, out = np.arange(len(own)), []
        for grams, ranks in zip(self.grams, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            off = np.where(grams[at] == own, np.abs(ranks[at] - places), self.size)
            out.append(off.sum() / (len(own) * self.size))
        return np.array(out)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 minus its distance; ``und`` and 0 without a letter or without profiles."""
        own = top_grams(text, self.size) if text else ()
        if len(own) == 0 or not self.names:
            return UNKNOWN, 0.0
        d = self.distances(own)
        k = int(d.argmin())
        return self.names[k], float(min(1.0, max(0.0, 1.0 - d[k])))


def held_out(doc_id: Column) -> Column:
    """Rows that learning may not see: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, languages: int = LANGUAGES, size: int = PROFILE) -> Profiles:
    """Profiles of the languages in ``docs`` (doc_id, text, lang), without held-out rows and null languages.

    n-grams are counted on the executors, summed a language, and the ``size`` foremost of each come to the driver. Where the
    column names more than ``languages``, those with most labelled rows are learned (of equal ones the first by name): a column
    full of stray values costs the rarest of them their profiles, and every text is still told.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["lang"]: r["n"] for r in counts.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not totals:
        return Profiles({}, size)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    chances = docs.sparkSession.createDataFrame([(lang, min(1.0, sample_docs / n)) for lang, n in totals.items()], "lang string, chance double")
    drawn = rows.select("text", "lang", place.alias("place")).join(F.broadcast(chances), "lang").where("place < chance")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[tuple]] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(lang, []).append(gram_counts(text))
                if len(sums[lang]) >= 256:
                    sums[lang] = [_merged(sums[lang])]
        for lang, parts in sums.items():
            grams, counts = _merged(parts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams)), "gram": pa.array(grams, pa.int64()), "n": pa.array(counts, pa.int64())})

    counted = drawn.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked: dict[str, list[int]] = {}
    for r in summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, size)


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    found, at = np.unique(grams, return_inverse=True)
    return found, np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``lang_score`` beside them (existing ones of these names go).

    Nothing but the text is read, and texts of any length whole. Null, empty and letterless texts (combining marks alone are no
    letter) give ``und`` and 0; of equally near languages the first by name wins; repeated rows get equal answers; an empty table
    stays empty.
    """
    kept = docs.drop("lang_pred", "lang_score")
    at = kept.columns.index(text)
    schema = kept.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*batch.schema, ("lang_pred", pa.string()), ("lang_score", pa.float64())]))

    return kept.mapInArrow(run, schema)
