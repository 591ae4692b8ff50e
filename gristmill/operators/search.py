"""Hybrid code search for many queries at once: BM25 and vector rankings, fused by reciprocal rank.

An index is a table of postings; a search is a join of query terms with it, so that the work follows the postings of
those terms. Ranks are cut per query by ``row_number``, which Spark applies before its shuffle as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import paths, text
from gristmill.operators.steps import settled

#: Published defaults of BM25, and the weight of a term in the path.
K1, B, PATH_WEIGHT = 1.2, 0.75, 2.0
LEAST_IDF = 1e-6
#: Stands for a term in the one posting of a chunk that carries its length; no token is empty.
LENGTH = ""
LIMIT, CANDIDATES, RRF_K = 12, 3, 60


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, repo_id, tf (weighted) of every term of ``chunks`` (chunk_id, repo_id, path, content)."""
    own = F.transform(text.index_tokens(F.col("content")), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("w")))
    named = F.transform(text.index_tokens(F.col("path")), lambda t: F.struct(t.alias("term"), F.lit(PATH_WEIGHT).alias("w")))
    every = chunks.select("chunk_id", "repo_id", F.explode(F.concat(own, named)).alias("t"))
    return every.groupBy("chunk_id", "repo_id", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"))


def lengths(chunks: DataFrame) -> DataFrame:
    """chunk_id, dl (tokens of content and path)."""
    return chunks.select("chunk_id", (F.size(text.index_tokens(F.col("content"))) + F.size(text.index_tokens(F.col("path")))).cast("double").alias("dl"))


def corpus_size(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks, avg_dl."""
    return lengths(chunks).agg(F.count(F.lit(1)).cast("double").alias("n_chunks"), F.avg("dl").alias("avg_dl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term of ``queries`` (query_id, query)."""
    return queries.select("query_id", F.explode(text.query_tokens(F.col("query"))).alias("term"))


def bm25(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, repo_id, score of every chunk that holds a term of the query.

    Chunks are tokenised once: of their postings those of terms that some query names are kept, before anything is
    aggregated, and one more for each chunk that carries its length. What is kept is settled, and frequencies, lengths and scores are
    worked out from it. Frequencies and lengths cover all chunks and repositories, as scopes are applied to rows that were found.
    """
    terms = query_terms(queries)
    wanted = terms.select("term").unionByName(queries.sparkSession.createDataFrame([(LENGTH,)], "term string")).distinct()
    own = F.transform(text.index_tokens(F.col("content")), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("w")))
    named = F.transform(text.index_tokens(F.col("path")), lambda t: F.struct(t.alias("term"), F.lit(PATH_WEIGHT).alias("w")))
    every = chunks.select("chunk_id", "repo_id", F.concat(own, named).alias("tokens")).withColumn("dl", F.size("tokens").cast("double"))
    every = every.withColumn("tokens", F.concat("tokens", F.array(F.struct(F.lit(LENGTH).alias("term"), F.lit(0.0).alias("w")))))
    held = every.select("chunk_id", "repo_id", "dl", F.explode("tokens").alias("t")).select("chunk_id", "repo_id", "dl", "t.term", "t.w").join(wanted, "term", "left_semi")
    whole = settled(held.groupBy("term", "chunk_id", "repo_id", "dl").agg(F.sum("w").alias("tf")))
    found, stats = whole.where(F.col("term") != LENGTH), whole.where(F.col("term") == LENGTH).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avg")).first()
    n, avg = F.lit(stats["n"]), F.lit(stats["avg"])
    df = found.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avg))
    scored = found.join(df, "term").withColumn("part", idf * tf).join(terms, "term")
    return scored.groupBy("query_id", "chunk_id", "repo_id").agg(F.sum("part").alias("score"))


def ranked(hits: DataFrame, by: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first ``limit`` hits of each query in the order ``by``, with their rank from 1."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    return hits.withColumn(name, place.cast("long")).where(F.col(name) <= limit)


def lexical_top(chunks: DataFrame, queries: DataFrame, limit: int = LIMIT * CANDIDATES) -> DataFrame:
    """Best chunks of each query by BM25; equal scores (to nine places) by id."""
    return ranked(bm25(chunks, queries), [F.round("score", 9).desc(), F.col("chunk_id")], limit)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, d: s + d))


def valid_vector(v: Column, dimension: int) -> Column:
    """Whether ``v`` has the dimension and only finite components; false for null."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimension) & finite, F.lit(False))


def nearest(vectors: DataFrame, probes: DataFrame, limit: int = LIMIT * CANDIDATES) -> DataFrame:
    """Nearest ``limit`` vectors of each probe (query_id, repo_id, probe) within its repositories: score 1 / (1 + distance).

    The probes are the stated query set; they meet the vectors of their own repositories alone.
    """
    met = vectors.select("chunk_id", "repo_id", "embedding").join(probes.select("query_id", "repo_id", "probe"), "repo_id")
    near = met.select("query_id", "chunk_id", "repo_id", l2(F.col("embedding"), F.col("probe")).alias("distance"))
    top = ranked(near, [F.round("distance", 9), F.col("chunk_id")], limit)
    return top.withColumn("score", 1 / (1 + F.col("distance")))


def fused(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, lexical_rank, semantic_rank, rrf: reciprocal rank fusion of two rankings (query_id, chunk_id, rank)."""
    a = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"), F.lit(None).cast("long").alias("semantic_rank"))
    b = semantic.select("query_id", "chunk_id", F.lit(None).cast("long").alias("lexical_rank"), F.col("rank").alias("semantic_rank"))
    both = a.unionByName(b).groupBy("query_id", "chunk_id").agg(F.max("lexical_rank").alias("lexical_rank"), F.max("semantic_rank").alias("semantic_rank"))
    share = lambda rank: F.coalesce(1.0 / (k + F.col(rank)), F.lit(0.0))
    return both.withColumn("rrf", share("lexical_rank") + share("semantic_rank"))


def search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, probes: DataFrame, *, excluded: list[str] = (), limit: int = LIMIT, lexical: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """Hybrid search: both rankings cut to ``limit`` * 3, fused, weighed by path, then exclusions, then ``limit``.

    Exclusions come after the candidate pools are cut, so a query may end with fewer than ``limit`` results. Vectors
    without a chunk are dropped after their pool is cut, too. ``lexical`` and ``semantic``: rankings that stored
    indexes give already.
    """
    pool = limit * CANDIDATES
    hits = fused(lexical_top(chunks, queries, pool) if lexical is None else lexical, nearest(vectors, probes, pool) if semantic is None else semantic)
    named = hits.join(chunks.select("chunk_id", "path"), "chunk_id").join(queries.select("query_id", text.query_tokens(F.col("query")).alias("tokens")), "query_id")
    weighed = named.withColumn("score", F.col("rrf") * paths.path_weight(F.col("path"), F.col("tokens"))).drop("tokens")
    kept = weighed.where(~F.col("path").isin(list(excluded))) if excluded else weighed
    order = [F.round("score", 9).desc(), F.col("lexical_rank").asc_nulls_last(), F.col("semantic_rank").asc_nulls_last(), F.col("chunk_id")]
    return ranked(kept, order, limit)


def rendered(repo: Column, path: Column, first: Column, last: Column, content: Column) -> Column:
    """A chunk as a headed fenced block."""
    head = F.concat(F.lit("### "), repo, F.lit(" "), path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"))
    return F.concat(head, F.lit("\n```"), paths.fence(path), F.lit("\n"), content, F.lit("\n```"))


def context(blocks: DataFrame, budget: int = 24_000) -> DataFrame:
    """query_id, context: blocks (query_id, rank, block, bare) joined by a blank line, up to the first that overflows ``budget``.

    The first block always stays, cut to the budget; ``bare`` is how long it is without its content.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    sized = blocks.withColumn("end", F.sum(F.length("block") + F.when(F.row_number().over(w) > 1, 2).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sized = sized.withColumn("over", F.max(F.when(F.col("end") > budget, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = sized.where((F.col("over") == 0) | (F.col("rank") == 1))
    tail = F.lit("\n```")
    cut = F.concat(F.substr("block", F.lit(1), F.greatest(F.lit(budget) - F.length(tail), F.col("bare") - F.length(tail))), tail)
    shown = F.when(F.col("end") <= budget, F.col("block")).otherwise(cut)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", shown.alias("b")))), lambda s: s["b"]), "\n\n")
    return kept.groupBy("query_id").agg(joined.alias("context"), F.count(F.lit(1)).alias("n_blocks"))
