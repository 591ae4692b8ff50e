"""A stored full-text index: postings of terms by block of chunks, kept over generations, and top-k search that skips blocks.

``postings/gen=G/bucket=B`` has a row for each term and block of chunks: how many chunks hold the term, the bounds that say how
well any of them can score (largest frequency, least length), and the postings themselves. ``blocks/gen=G`` has a row for each block that
generation G wrote: chunks, and the sum of their lengths. A block belongs to the last generation that wrote it, and that generation's
``blocks`` are written last, so a build that ends early is never read. A search reads the buckets of its own terms alone: first counts and
bounds, then the postings of blocks that can still reach a query's k-th score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators.search import B, CANDIDATES, K1, LEAST_IDF, LIMIT, PATH_WEIGHT, query_terms, ranked

#: Chunk ids of a block, and parts of the index by a hash of the term.
BLOCK, BUCKETS = 32, 64
#: Blocks of a query that are scored first, to learn what its k-th score is at least.
FIRST_BLOCKS = 8
#: Chunks of an index from which on a search looks at bounds before it reads postings.
SKIP_CHUNKS = 1_000_000
#: Up to so many different terms of all queries are handed to the scan as a filter; beyond, they are joined alone.
PUSHED_TERMS = 1_000
POSTINGS = f"term string, block bigint, n bigint, max_tf double, min_dl double, held array<struct<chunk_id: bigint, repo_id: string, tf: double, dl: double>>, gen int, bucket int"
BLOCKS = "block bigint, n_chunks bigint, sum_dl double, gen int"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def block_of(chunk_id: Column) -> Column:
    return F.floor(chunk_id / F.lit(BLOCK)).cast("long")


def _postings(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of postings and of blocks of ``chunks`` (chunk_id, repo_id, path, content)."""
    weigh = lambda c, w: F.transform(text.index_tokens(F.coalesce(F.col(c), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    tokens = chunks.where("chunk_id IS NOT NULL").select("chunk_id", "repo_id", F.concat(weigh("content", 1.0), weigh("path", PATH_WEIGHT)).alias("tokens")).withColumn("dl", F.size("tokens").cast("double"))
    each = tokens.select("chunk_id", "repo_id", "dl", F.explode("tokens").alias("t")).groupBy("chunk_id", "repo_id", "dl", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"))
    held = F.sort_array(F.collect_list(F.struct("chunk_id", "repo_id", "tf", "dl")))  # a block's chunks at most
    rows = each.groupBy("term", block_of(F.col("chunk_id")).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), held.alias("held"))
    return rows, tokens.groupBy(block_of(F.col("chunk_id")).alias("block")).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("dl").alias("sum_dl"))


class SearchIndex:
    """The index in ``folder``, which driver and executors must share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._stats = spark, folder.rstrip("/"), None

    def _path(self, part: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        """Finished generations, oldest first."""
        at, fs = self._path("blocks")
        if not fs.exists(at):
            return []
        names = [s.getPath() for s in fs.listStatus(at)]
        return sorted(int(p.getName()[4:]) for p in names if p.getName().startswith("gen=") and fs.exists(self._path(f"blocks/{p.getName()}/_SUCCESS")[0]))

    def blocks(self) -> DataFrame:
        """block, gen, n_chunks, sum_dl as they stand now."""
        rows = self.spark.read.schema(BLOCKS).parquet(f"{self.folder}/blocks").where(F.col("gen").isin(self.generations()))
        return rows.groupBy("block").agg(F.max("gen").alias("gen"), F.max_by("n_chunks", "gen").alias("n_chunks"), F.max_by("sum_dl", "gen").alias("sum_dl"))

    def postings(self) -> DataFrame:
        """Rows of all finished generations, those of blocks written again later among them."""
        return self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings").where(F.col("gen").isin(self.generations()))

    def _write(self, postings: DataFrame, blocks: DataFrame) -> None:
        gen = max(self.generations(), default=-1) + 1
        dealt = postings.withColumn("bucket", bucket_of(F.col("term"))).repartition("bucket").sortWithinPartitions("bucket", "term", "block")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/gen={gen}")
        blocks.coalesce(8).write.mode("overwrite").parquet(f"{self.folder}/blocks/gen={gen}")

    def build(self, chunks: DataFrame) -> SearchIndex:
        """Index all ``chunks`` (chunk_id, repo_id, path, content) as a generation of their own; null contents are empty, chunks without id aren't indexed."""
        self._write(*_postings(chunks))
        return self

    def update(self, chunks: DataFrame, changed: DataFrame) -> SearchIndex:
        """Write again the blocks that hold a chunk of ``changed`` (chunk_id), added, altered or gone; ``chunks`` are all as they are now."""
        touched = changed.where("chunk_id IS NOT NULL").select(block_of(F.col("chunk_id")).alias("block")).distinct()
        postings, blocks = _postings(chunks.where("chunk_id IS NOT NULL").withColumn("block", block_of(F.col("chunk_id"))).join(touched, "block", "left_semi"))
        whole = touched.join(blocks, "block", "left").select("block", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), F.coalesce("sum_dl", F.lit(0.0)).alias("sum_dl"))
        self._write(postings, whole)
        return self

    def compact(self) -> SearchIndex:
        """All standing rows as one generation; older ones go. Not to be run while others search."""
        old = self.generations()
        standing = self.postings().join(self.blocks().select("block", "gen"), ["block", "gen"]).select("term", "block", "n", "max_tf", "min_dl", "held")
        self._write(standing, self.blocks().where("n_chunks > 0").select("block", "n_chunks", "sum_dl"))
        for part in ("blocks", "postings"):
            for gen in old:
                at, fs = self._path(f"{part}/gen={gen}")
                fs.delete(at, True)
        return self

    def rows_for(self, terms: DataFrame) -> DataFrame:
        """Standing rows of the ``terms`` (query_id, term): only their buckets are read, at most :data:`BUCKETS` numbers on the driver."""
        wanted = terms.select("term").distinct().withColumn("bucket", bucket_of(F.col("term")))
        few = wanted.limit(PUSHED_TERMS + 1).collect()
        if len(few) <= PUSHED_TERMS:
            met = F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("term").isin(sorted(r["term"] for r in few))
        else:
            met = F.col("bucket").isin([r["bucket"] for r in wanted.select("bucket").distinct().collect()])
        rows = self.postings().where(met)
        if len(few) > PUSHED_TERMS:
            rows = rows.join(wanted, ["bucket", "term"], "left_semi")
        # a lone generation holds no block that was written again
        return rows if len(self.generations()) == 1 else rows.join(self.blocks().select("block", "gen"), ["block", "gen"])

    def statistics(self) -> tuple[float, float]:
        """Chunks and their mean length; asked once for each state of the index."""
        key = tuple(self.generations())
        if self._stats is None or self._stats[0] != key:
            stats = self.blocks().agg(F.sum("n_chunks").alias("n"), (F.sum("sum_dl") / F.sum("n_chunks")).alias("avg")).first()
            self._stats = key, (float(stats["n"] or 0), stats["avg"] or 1.0)
        return self._stats[1]

    def _known(self, terms: DataFrame, rows: DataFrame) -> DataFrame:
        """query_id, term, idf of the ``terms`` that the index holds."""
        n = F.lit(self.statistics()[0])
        df = rows.groupBy("term").agg(F.sum("n").cast("double").alias("df"))
        return terms.join(df, "term").withColumn("idf", F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))).select("query_id", "term", "idf")

    def _part(self, tf: Column, dl: Column) -> Column:
        return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(self.statistics()[1])))

    def parts(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        """query_id, chunk_id, term, tf, dl, idf, part: what each term of ``queries`` adds to the score of ``hits`` (query_id, chunk_id)."""
        terms = query_terms(queries)
        rows = self.rows_for(terms)
        wanted = hits.select("query_id", "chunk_id", block_of(F.col("chunk_id")).alias("block")).join(self._known(terms, rows), "query_id")
        met = rows.select("term", "block", "held").join(wanted, ["term", "block"])
        one = met.withColumn("p", F.explode(F.filter("held", lambda p: p["chunk_id"] == F.col("chunk_id"))))
        return one.select("query_id", "chunk_id", "term", F.col("p.tf").alias("tf"), F.col("p.dl").alias("dl"), "idf", self._part(F.col("p.tf"), F.col("p.dl")).alias("part"))

    def top(self, queries: DataFrame, limit: int = LIMIT * CANDIDATES, *, repos: list[str] | None = None, skip: bool | None = None) -> DataFrame:
        """query_id, chunk_id, repo_id, score, rank: the best ``limit`` chunks of each of ``queries`` (query_id, query) by BM25.

        Frequencies and lengths cover all repositories; ``repos`` restricts what is found. Equal scores (to nine places) go by id. Exact:
        a block is passed over only if the sum of its terms' bounds is below a score that ``limit`` chunks of the query reach. To learn that score takes a pass of its
        own, which pays on large indexes alone: ``skip`` says whether to, by default from :data:`SKIP_CHUNKS` chunks on. The rows are the same either way.
        """
        part, terms = self._part, query_terms(queries)
        rows = self.rows_for(terms)
        known = self._known(terms, rows)

        def scores(blocks: DataFrame | None) -> DataFrame:
            met = rows.select("term", "block", "held").join(known, "term").select("query_id", "block", "idf", "held")
            met = met if blocks is None else met.join(blocks.select("query_id", "block"), ["query_id", "block"])
            # whole blocks are dealt out, so that the sums of their chunks need no further exchange
            one = met.repartition("query_id", "block").select("query_id", "block", "idf", F.explode("held").alias("p")).select("query_id", "block", "p.chunk_id", "p.repo_id", part(F.col("p.tf"), F.col("p.dl")).alias("part"))
            one = one.where(F.col("repo_id").isin(repos)) if repos is not None else one
            return one.groupBy("query_id", "block", "chunk_id", "repo_id").agg(F.sum("part").alias("score")).drop("block")

        order = [F.round("score", 9).desc(), F.col("chunk_id")]
        if not (self.statistics()[0] > SKIP_CHUNKS if skip is None else skip):
            return ranked(scores(None), order, limit)
        bounds = rows.select("term", "block", "max_tf", "min_dl").join(known, "term").groupBy("query_id", "block").agg(F.sum(part(F.col("max_tf"), F.col("min_dl"))).alias("bound"))
        bounds = bounds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")))
        reached = ranked(scores(bounds.where(F.col("place") <= FIRST_BLOCKS)), order, limit).where(F.col("rank") == limit).select("query_id", F.col("score").alias("reached"))
        # a little below, as sums in another order may differ in their last digits
        open_ = bounds.join(reached, "query_id", "left").where(F.coalesce(F.col("bound") >= F.col("reached") * (1 - 1e-9) - 1e-8, F.lit(True)))
        return ranked(scores(open_), order, limit)
