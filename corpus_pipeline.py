"""The corpus pipeline: documents in, packed training windows out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; the driver of the
pipeline writes it as Parquet and reads it again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import language, line_dedup, ngram_join, packing, private_data
from gristmill.llm._shared import Scratch


#: Key of the registered query's surrogates, which must give the same rows each time; a user takes a secret one.
KEY = b"key of the registered pipeline"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles tell; null texts and those without a letter go. ``lang`` is the prediction."""
    found = language.identify(docs, language.learn(docs)).where(f"lang_pred <> '{language.UNKNOWN}'")
    return found.withColumn("lang", found["lang_pred"]).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near-duplicate lines go; so do documents that have no word left."""
    return line_dedup.dedup_lines(docs, span=5, percent=80)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, Jaccard 0.8."""
    return ngram_join.keep_one_of_each(docs, n=5, percent=80)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data gives way to surrogates."""
    return private_data.replace_private(docs, KEY).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4 096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=4096, end_id=2, with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", join_ngrams),
    ("private_data", replace_private),
    ("packing", pack),
]

#: No SQL says what these stages do (profiles, surrogates, tokenizers); tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each stage's table goes once the next one is written, but for the last, which the result reads."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
