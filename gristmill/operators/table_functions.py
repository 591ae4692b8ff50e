"""Table functions over source texts, for SQL and DataFrames alike: segments that begin at definitions, and parts within a budget of characters.

:func:`register` names them for a session; a query then calls them laterally, ``FROM files, LATERAL merged_segments(content, language, 80)``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.operators import corpus

SPAN = T.StructType([T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType())])


def segments(rows: list[str], language: str | None, max_lines: int) -> Iterator[tuple[int, int]]:
    """First and last line (from 1) of runs of whole segments: a segment begins at a definition, and joins the run before it while that stays within ``max_lines``."""
    cuts = corpus._cuts(rows, re.compile(corpus.DEFINITIONS.get(language or "", corpus.OTHERS)))
    first = 0
    for begin, end in zip(cuts, [*cuts[1:], len(rows)], strict=True):
        if begin > first and end - first > max_lines:
            yield first + 1, begin
            first = begin
    yield first + 1, len(rows)


class MergedSegments:
    """start_line, end_line of the merged segments of a text; a blank or null text has none. A lone segment may be longer than ``max_lines``."""

    def eval(self, content: str, language: str, max_lines: int) -> Iterator[tuple[int, int]]:
        if content and content.strip():
            yield from segments(content.split("\n"), language, max_lines)


class CharParts:
    """start_line, end_line of the parts of a text that hold ``max_chars`` with their line ends; a longer line is a part of its own, blank parts are left out."""

    def eval(self, content: str, max_chars: int) -> Iterator[tuple[int, int]]:
        if content and content.strip():
            rows = content.split("\n")
            yield from ((first, last) for first, last, _ in corpus._within(rows, 0, len(rows), max_chars))


def register(spark: SparkSession) -> None:
    """Name the table functions ``merged_segments`` and ``char_parts`` in ``spark``."""
    spark.udtf.register("merged_segments", F.udtf(MergedSegments, returnType=SPAN, useArrow=True))
    spark.udtf.register("char_parts", F.udtf(CharParts, returnType=SPAN, useArrow=True))
