"""The registered queries of the training-data operators, and their SQL for the oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import collocations, embedding_dedup, hnsw, language, line_dedup, lloyd, ngram_join, packing, pieces, private_data, quality, sharding, tokens
from gristmill.llm._shared import documents


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.clean_lines(documents(spark, sf_dir).select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_share", "lines_boilerplate", "lines_navigation", "lines_punctuation")
    return judged.select("doc_id", *[f"quality.{n}" for n in names])


def op1_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(documents(spark, sf_dir), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.removed_lines(documents(spark, sf_dir), span=5, percent=80)
    return found.withColumn("removed", F.array_join("removed", ","))


#: Key of the registered query, which must give the same rows each time; a user takes a secret one.
KEY = b"key of the registered query"


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(documents(spark, sf_dir).select("doc_id", "text"), word_bpe(), end_id=2, with_ids=False)


def op6_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), n_best=3)


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = private_data.replace_private(documents(spark, sf_dir).select("doc_id", "text"), KEY)
    return replaced.select("doc_id", "text", "private_found", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir), n=3, percent=90)


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), word_bpe(), length=4096, end_id=2, with_ids=False)


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, dimension=64, scale=64, seed="1")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), max_words=3, min_count=10, percent=50, limit=2_000)


def op13_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


QUERIES = {
    "op11_lloyd": op11_lloyd,
    "op12_collocations": op12_collocations,
    "op13_hnsw": op13_hnsw,
    "op10_line_dedup": op10_line_dedup,
    "op1_language_profiles": op1_language_profiles,
    "op2_best_fit_shards": op2_best_fit_shards,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_token_files": op5_token_files,
    "op6_nbest_pieces": op6_nbest_pieces,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_surrogates": op8_surrogates,
    "op9_sum_of_squares_packing": op9_sum_of_squares_packing,
    "op3_quality_rules": op3_quality_rules,
}

SPLIT = r"[^\x20\x09-\x0D]+"


def _words(column: str) -> str:
    return f"regexp_extract_all({column}, '{SPLIT}')"


def _among(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest({_words('text')}) AS w, generate_subscripts({_words('text')}, 1) AS i FROM d),
g AS (SELECT *, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM g),
r AS (SELECT doc_id, w, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS met FROM c),
b AS (SELECT doc_id, count(*) AS n_words, cast(sum(length(w)) AS bigint) AS chars, cast(sum(met) AS bigint) AS n_repeat FROM r GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT doc_id, line, lower(line) AS low, len(regexp_split_to_array(line, '[\x20\x09-\x0D]+')) AS n, len(list_filter({_words('line')}, lambda x: regexp_matches(x, '^[|»«›‹>•·→/\\~*=_-]+$'))) AS seps, list_sum(list_transform({_words('line')}, lambda x: length(x))) AS chars,
  len(list_filter(regexp_split_to_array(lower(line), '[^\p{{L}}\p{{N}}_]+'), lambda x: x IN {_among(quality.MENU)})) AS menu FROM l WHERE regexp_matches(line, '{SPLIT}')),
f AS (SELECT doc_id, line, chars, CASE WHEN {' OR '.join(f"contains(low, '{phrase}')" for phrase in quality.BOILERPLATE)} THEN 'boilerplate' WHEN (seps > 0 AND seps > n * 0.3) OR (n <= 12 AND menu * 2 > n) THEN 'navigation'
  WHEN NOT regexp_matches(line, '[.!?…。！？:;]["''”’»)\]]*[\x20\x09-\x0D]*$') OR len(regexp_extract_all(line, '[#*$%&|<>{{}}=\\^~]|!!|\?\?')) > length(line) * 0.08 THEN 'punctuation' END AS fault FROM n),
k AS (SELECT doc_id, count(*) FILTER (WHERE fault = 'boilerplate') AS lines_boilerplate, count(*) FILTER (WHERE fault = 'navigation') AS lines_navigation, count(*) FILTER (WHERE fault = 'punctuation') AS lines_punctuation, count(*) - count(DISTINCT line) AS n_dup, coalesce(sum(chars) FILTER (WHERE fault IS NOT NULL), 0) AS lost FROM f GROUP BY 1),
j AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(b.chars, 0) AS word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) AS bigint) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(lines_boilerplate, 0) AS lines_boilerplate, coalesce(lines_navigation, 0) AS lines_navigation, coalesce(lines_punctuation, 0) AS lines_punctuation, CASE WHEN b.chars > 0 THEN cast(b.chars - lost AS double) / b.chars ELSE 0.0::double END AS kept_share FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT *, NOT base_failed AND kept_share >= 0.5 AS kept FROM v
"""

LINES_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
w AS (SELECT doc_id, k, {_words('line')} AS ws, regexp_matches(line, '[\p{{L}}\p{{N}}]') AS says FROM l),
s AS (SELECT doc_id, k, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 AND says THEN [array_to_string(ws, ' ')] ELSE [] END AS ts FROM w),
t AS (SELECT doc_id, k, len(ts) AS n, unnest(ts) AS t FROM s),
met AS (SELECT a.doc_id, a.k, count(*) AS shared, a.n + b.n AS total FROM t a JOIN t b ON a.t = b.t AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.k < a.k)) GROUP BY a.doc_id, a.k, b.doc_id, b.k, a.n, b.n),
gone AS (SELECT DISTINCT doc_id, k FROM met WHERE shared * 180 >= total * 80)
SELECT l.doc_id, count(*) AS n_lines, count(g.k) AS n_removed, coalesce(string_agg(g.k, ',' ORDER BY g.k), '') AS removed FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY l.doc_id
"""


def _lloyd_sql(k: int, rounds: int, dimension: int, scale: int, seed: str) -> str:
    """Every round assigns all vectors to all centroids, and takes the exact floor of each component's mean."""
    vector = f"list_transform(embedding, lambda x: cast(floor({scale} * cast(x AS double)) AS bigint))"
    fits = f"len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    apart = "cast(list_sum(list_transform(range(1, len(v.q) + 1), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))) AS bigint)"
    parts = [f"kept AS (SELECT row_number() OVER () AS v, vec_id, {vector} AS q FROM embeddings WHERE {fits})", f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, q FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT * FROM (SELECT v.v, v.vec_id, v.q, c.c, {apart} AS d FROM kept v, c{r} c) QUALIFY row_number() OVER (PARTITION BY v ORDER BY d, c) = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY c, i)")
            parts.append(f"m{r} AS (SELECT c, list(cast((s - ((s % n) + n) % n) // n AS bigint) ORDER BY i) AS q FROM s{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, cast(a.c AS integer) AS cluster, d AS distance, cast(sum(d) OVER (PARTITION BY a.c) AS bigint) AS cluster_inertia, cast(sum(d) OVER () AS bigint) AS inertia, "
        f"sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"
    )


COLLOCATIONS_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
q AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM q),
n AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS m, w AS phrase FROM n UNION ALL SELECT lang, 2, w || ' ' || w2 FROM n WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM n WHERE w3 IS NOT NULL),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY 1, 2, 3), t AS (SELECT lang, cast(sum(a) AS bigint) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 10),
k AS (SELECT *, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.m, k.a, k.ws, k.k, l.a AS l, r.a AS r, cast(1000000::hugeint * k.a * k.a // (l.a::hugeint * r.a) AS bigint) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.head JOIN f r ON r.lang = k.lang AND r.phrase = k.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS part FROM c WHERE m = 3) GROUP BY 1, 2),
o AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.part = b.phrase AND b.m = 2 WHERE h.longer IS NULL OR 100 * h.longer < 50 * b.a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score FROM o JOIN t ON t.lang = o.lang QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {"op3_quality_rules": QUALITY_SQL, "op10_line_dedup": LINES_SQL, "op11_lloyd": _lloyd_sql(16, 3, 64, 64, "1"), "op12_collocations": COLLOCATIONS_SQL}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
