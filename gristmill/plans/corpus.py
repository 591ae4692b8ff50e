"""Queries of incremental indexing, chunks, change risk and document checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import paths, text
from gristmill.operators import corpus as ops
from gristmill.operators import diffs, table_functions
from gristmill.operators.steps import numbered, ranges_of, settled
from gristmill.plans.registry import query
from gristmill.sources.tables import CHUNKS, FILES, NEW_FILES, OLD_FILES, over, table

CHANGES = "ch AS (SELECT coalesce(o.path, n.path) AS path, o.blob_hash AS old_hash, n.blob_hash AS new_hash, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN o.blob_hash = n.blob_hash THEN 'unchanged' ELSE 'changed' END AS change FROM v_old o FULL JOIN v_new n ON o.path = n.path)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("o063_snapshot_changes", over("v_old v_new", f"WITH {CHANGES} SELECT path, change FROM ch"))
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reconcile(OLD_FILES.frame(spark, sf_dir), NEW_FILES.frame(spark, sf_dir)).select("path", "change")


@query("o105_index_summary", over("v_old v_new", f"WITH {CHANGES} SELECT count(*) FILTER (WHERE change IN ('new', 'changed')) AS indexed, count(*) FILTER (WHERE change = 'unchanged') AS skipped, count(*) FILTER (WHERE change = 'removed') AS removed FROM ch"))
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.col("change")
    found = ops.reconcile(OLD_FILES.frame(spark, sf_dir), NEW_FILES.frame(spark, sf_dir))
    return found.agg(F.count_if(change.isin("new", "changed")).alias("indexed"), F.count_if(change == "unchanged").alias("skipped"), F.count_if(change == "removed").alias("removed"))


@query("o163_removed_files", over("v_old v_new", "SELECT path FROM v_old WHERE path NOT IN (SELECT path FROM v_new)"))
def removed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OLD_FILES.frame(spark, sf_dir).select("path").join(NEW_FILES.frame(spark, sf_dir), "path", "left_anti")


@query("o024_next_generation", over("v_old v_new", f"WITH {CHANGES} SELECT path, blob_hash FROM v_old WHERE path NOT IN (SELECT path FROM ch WHERE change IN ('removed', 'changed')) UNION ALL SELECT path, new_hash FROM ch WHERE change IN ('new', 'changed')"))
def next_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = OLD_FILES.frame(spark, sf_dir), NEW_FILES.frame(spark, sf_dir)
    changes = ops.reconcile(old, new)
    fresh = changes.where("change IN ('new', 'changed')").select("path", F.col("new_hash").alias("blob_hash"))
    return ops.next_generation(old.select("path", "blob_hash"), changes, fresh)


@query("o188_input_hashes", over("v_chunks", "SELECT chunk_id, sha256(path || chr(10) || content) AS input_hash FROM v_chunks"))
def input_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CHUNKS.frame(spark, sf_dir).select("chunk_id", ops.input_hash(F.col("path"), F.col("content")).alias("input_hash"))


@query("o065_cache_probe", over("v_chunks v_vec", "WITH h AS (SELECT chunk_id, sha256(path || chr(10) || content) AS input_hash FROM v_chunks), c AS (SELECT h.input_hash, v.embedding FROM h JOIN v_vec v ON v.chunk_id = h.chunk_id) SELECT h.chunk_id, c.embedding IS NOT NULL AS hit FROM h LEFT JOIN c ON c.input_hash = h.input_hash"))
def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = input_hashes(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    cache = inputs.join(vectors, "chunk_id").select("input_hash", "embedding")
    return ops.probe_cache(inputs, cache, 64).select("chunk_id", F.col("embedding").isNotNull().alias("hit"))


@query("o231_batches", "SELECT source, doc_id, cast(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 16) AS bigint) AS batch FROM documents")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.batches(documents(spark, sf_dir).select("source", "doc_id"), 16, "source", "doc_id")


@query("o129_line_windows", "WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, cast(greatest(ceil((n - 80) / 72), 0) AS bigint) + 1)) * 72 + 1 AS s FROM n) SELECT doc_id AS file_id, s AS start_line, least(s + 79, n) AS end_line FROM w")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.line_windows(documents(spark, sf_dir).select(F.col("doc_id").alias("file_id"), F.col("text").alias("content")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FILES.frame(spark, sf_dir).select("file_id", "path", "content")


LINES = "t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE regexp_matches(text, '\\S')), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS k FROM t), z AS (SELECT doc_id, len(ls) AS z FROM t)"
COMMENT = "regexp_matches(line, '^\\s*(//|#|--|;|%|\\*|/\\*|\"\"\"|\\x27\\x27\\x27|<!--)')"
KIND = "CASE WHEN regexp_matches(path, '(^|/)Dockerfile') THEN '' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.md' THEN 'markdown' ELSE '' END"
STARTS = "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_matches(line, '^(?:{ops.DEFINITIONS[k]})')" for k in ("typescript", "javascript", "python", "markdown")) + " ELSE regexp_matches(line, '^[A-Za-z_]') END"
#: Chunks: as the merged segments below, by each path's own language; then windows of 80 lines every 72, each cut at 6 000 characters.
CHUNKED = (
    f"WITH RECURSIVE t AS (SELECT file_id, path, {KIND} AS kind, string_split(content, chr(10)) AS ls FROM v_files WHERE regexp_matches(content, '\\S')), l AS (SELECT file_id, kind, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS k FROM t), "
    f"c AS (SELECT *, coalesce(max(CASE WHEN NOT {COMMENT} THEN k END) OVER (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 AS lead FROM l), "
    f"b AS (SELECT file_id, 0 AS s FROM t UNION SELECT c.file_id, c.lead FROM c LEFT JOIN l p ON p.file_id = c.file_id AND p.k = c.lead - 1 WHERE c.k > 0 AND regexp_matches(c.line, '\\S') AND {STARTS.replace('kind', 'c.kind').replace('line', 'c.line')} AND (c.lead = 0 OR NOT regexp_matches(p.line, '\\S'))), "
    "g AS (SELECT b.file_id, s, coalesce(lead(s) OVER (PARTITION BY b.file_id ORDER BY s), len(ls)) AS e, row_number() OVER (PARTITION BY b.file_id ORDER BY s) AS i FROM b JOIN t ON t.file_id = b.file_id), "
    "r AS (SELECT file_id, i, s AS first, e FROM g WHERE i = 1 UNION ALL SELECT g.file_id, g.i, CASE WHEN g.e - r.first <= 80 THEN r.first ELSE g.s END, g.e FROM r JOIN g ON g.file_id = r.file_id AND g.i = r.i + 1), "
    "sp AS (SELECT file_id, first, max(e) AS e FROM r GROUP BY 1, 2), w AS (SELECT file_id, e, unnest(CASE WHEN e - first <= 80 THEN [first] ELSE range(first, e - 80 + 72, 72) END) AS begun FROM sp), "
    "wl AS (SELECT w.file_id, begun, l.k, line, length(line) AS n FROM w JOIN l ON l.file_id = w.file_id AND l.k >= begun AND l.k < least(begun + 80, e)), "
    "q AS (SELECT file_id, begun, k, k AS first, n + 1 AS size, n >= 6000 AS lone FROM wl WHERE k = begun UNION ALL SELECT x.file_id, x.begun, x.k, CASE WHEN x.n >= 6000 OR q.lone OR q.size + x.n + 1 > 6000 THEN x.k ELSE q.first END, CASE WHEN q.lone OR q.size + x.n + 1 > 6000 THEN x.n + 1 ELSE q.size + x.n + 1 END, x.n >= 6000 FROM q JOIN wl x ON x.file_id = q.file_id AND x.begun = q.begun AND x.k = q.k + 1) "
    "SELECT q.file_id, path, first + 1 AS start_line, max(q.k) + 1 AS end_line, string_agg(substr(line, 1, 6000), chr(10) ORDER BY q.k) AS content FROM q JOIN wl ON wl.file_id = q.file_id AND wl.begun = q.begun AND wl.k = q.k JOIN t ON t.file_id = q.file_id GROUP BY q.file_id, path, q.begun, first HAVING bool_or(regexp_matches(substr(line, 1, 6000), '\\S'))"
)


@query("o220_chunks", over("v_files", CHUNKED))
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chunks(_files(spark, sf_dir))


SEGMENTS = (
    f"WITH RECURSIVE {LINES}, c AS (SELECT *, coalesce(max(CASE WHEN NOT {COMMENT} THEN k END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 AS lead FROM l), "
    "b AS (SELECT DISTINCT doc_id, 0 AS s FROM l UNION SELECT c.doc_id, c.lead FROM c LEFT JOIN l p ON p.doc_id = c.doc_id AND p.k = c.lead - 1 WHERE c.k > 0 AND regexp_matches(c.line, '^[A-Za-z_]') AND (c.lead = 0 OR NOT regexp_matches(p.line, '\\S'))), "
    "g AS (SELECT b.doc_id, s, coalesce(lead(s) OVER (PARTITION BY b.doc_id ORDER BY s), z.z) AS e, row_number() OVER (PARTITION BY b.doc_id ORDER BY s) AS i FROM b JOIN z ON z.doc_id = b.doc_id), "
    "r AS (SELECT doc_id, i, s AS first, e FROM g WHERE i = 1 UNION ALL SELECT g.doc_id, g.i, CASE WHEN g.e - r.first <= 80 THEN r.first ELSE g.s END, g.e FROM r JOIN g ON g.doc_id = r.doc_id AND g.i = r.i + 1) SELECT doc_id, first + 1 AS start_line, max(e) AS end_line FROM r GROUP BY doc_id, first"
)
PARTS = (
    f"WITH RECURSIVE {LINES}, r AS (SELECT doc_id, k, 0::bigint AS first, length(line) + 1 AS size, length(line) >= 300 AS lone FROM l WHERE k = 0 UNION ALL SELECT l.doc_id, l.k, CASE WHEN length(l.line) >= 300 OR r.lone OR r.size + length(l.line) + 1 > 300 THEN l.k ELSE r.first END, CASE WHEN r.lone OR r.size + length(l.line) + 1 > 300 THEN length(l.line) + 1 ELSE r.size + length(l.line) + 1 END, length(l.line) >= 300 FROM r JOIN l ON l.doc_id = r.doc_id AND l.k = r.k + 1) "
    "SELECT r.doc_id, first + 1 AS start_line, max(r.k) + 1 AS end_line FROM r JOIN l ON l.doc_id = r.doc_id AND l.k = r.k GROUP BY r.doc_id, first HAVING bool_or(regexp_matches(line, '\\S'))"
)


def _lateral(spark: SparkSession, sf_dir: str, call: str) -> DataFrame:
    table_functions.register(spark)
    return spark.sql(f"SELECT d.doc_id, s.* FROM {{docs}} AS d, LATERAL {call} AS s", docs=documents(spark, sf_dir).select("doc_id", "text"))


@query("o128_merged_segments", SEGMENTS)
def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lateral(spark, sf_dir, "merged_segments(d.text, CAST(NULL AS string), 80)")


@query("o222_char_budget", PARTS)
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lateral(spark, sf_dir, "char_parts(d.text, 300)")


@query("o221_definition_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^#{1,6}\\s')) AS markdown, count(*) FILTER (WHERE regexp_matches(line, '^[A-Za-z_]')) AS others FROM l GROUP BY 1")
def definition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.explode(text.lines(F.col("text"))).alias("line"))
    return rows.groupBy("doc_id").agg(F.count_if(ops.definition_line(F.col("line"), F.lit("markdown"))).alias("markdown"), F.count_if(ops.definition_line(F.col("line"), F.lit(None).cast("string"))).alias("others"))


@query("o230_packed_batches", "WITH RECURSIVE f AS (SELECT doc_id // 50 AS g, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS k FROM documents), r AS (SELECT g, k, doc_id, 0::bigint AS batch, 1::bigint AS n, n_chars AS bytes FROM f WHERE k = 1 UNION ALL SELECT f.g, f.k, f.doc_id, CASE WHEN r.n >= 12 OR r.bytes + f.n_chars > 65536 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 12 OR r.bytes + f.n_chars > 65536 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 12 OR r.bytes + f.n_chars > 65536 THEN f.n_chars ELSE r.bytes + f.n_chars END FROM r JOIN f ON f.g = r.g AND f.k = r.k + 1) SELECT g AS group_id, doc_id AS file_id, batch FROM r")
def packed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.packed_batches(documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 50).alias("group_id"), F.col("doc_id").alias("file_id"), F.col("n_chars").alias("size")))


NAMES = [n for n, _, _ in diffs.SIGNALS]
SCORE = " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END" for _, p, w in diffs.SIGNALS)
FOUND = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p, _ in diffs.SIGNALS)
RISK = f"risk AS (SELECT doc_id, CASE WHEN {SCORE} > 0 THEN {SCORE} WHEN regexp_matches(text, '\\S') THEN 1 ELSE 0 END AS score, CASE WHEN {SCORE} > 0 THEN concat_ws(',', {FOUND}) WHEN regexp_matches(text, '\\S') THEN 'execution' ELSE '' END AS signals FROM documents)"


@query("o107_change_risk", f"WITH {RISK} SELECT doc_id, cast(score AS bigint) AS score, signals FROM risk")
def change_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select("doc_id", diffs.assessed(F.col("text")).alias("a"))
    return found.select("doc_id", F.col("a.score").cast("long").alias("score"), F.array_join("a.signals", ",").alias("signals"))


@query("o057_risky_documents", f"WITH {RISK} SELECT doc_id FROM risk WHERE score >= 4")
def risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = documents(spark, sf_dir).select("doc_id", diffs.assessed(F.col("text")).alias("a")).select("doc_id", "a.score", "a.signals")
    return scored.where((F.col("score") >= 4) | F.array_contains("signals", "security")).select("doc_id")


@query("o145_riskiest_first", f"WITH {RISK} SELECT d.source, r.doc_id, cast(row_number() OVER (PARTITION BY source ORDER BY score DESC, r.doc_id) AS bigint) AS rank FROM risk r JOIN documents d ON d.doc_id = r.doc_id")
def riskiest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = settled(documents(spark, sf_dir).select("source", "doc_id", diffs.risk(F.col("text")).alias("score")))
    part = F.struct((-F.col("score")).alias("s"), ranges_of(scored, "doc_id").alias("r"))
    return numbered(scored, "source", part, ["doc_id"], "rank").drop("score")


@query("o201_truncated_status", "WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS s FROM documents) SELECT doc_id, CASE WHEN length(s) <= 140 THEN s ELSE substr(s, 1, 139) || '…' END AS status FROM s")
def truncated_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.truncated(F.col("text")).alias("status"))


@query("o213_clipped", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 500) || '…' END AS clipped FROM documents")
def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.clipped(F.col("text"), 500).alias("clipped"))


@query("o217_indented_body", "SELECT doc_id, '- **' || source || ':1** — ' || replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), chr(10) || '  ') AS item FROM documents")
def indented_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.replace(text.stripped(F.col("text")), F.lit("\n"), F.lit("\n  "))
    return documents(spark, sf_dir).select("doc_id", F.concat(F.lit("- **"), "source", F.lit(":1** — "), body).alias("item"))


@query("o208_path_parts", over("v_files", "WITH b AS (SELECT file_id, string_split(path, '/')[-1] AS base FROM v_files) SELECT file_id, base, lower(regexp_extract(base, '^.+\\.([^.]*)$', 1)) AS ext, CASE WHEN regexp_matches(base, '^.+\\.[^.]*$') THEN regexp_extract(base, '^(.+)\\.[^.]*$', 1) ELSE base END AS stem FROM b"))
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return FILES.frame(spark, sf_dir).select("file_id", paths.basename(p).alias("base"), paths.extension(p).alias("ext"), paths.stem(p).alias("stem"))


@query("o209_normalised_paths", over("v_files", "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'lib/' || path ELSE path END AS path FROM v_files"))
def normalised_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("./x/../lib//"), F.col("path"))).otherwise(F.concat(F.lit("../"), F.col("path")))
    return FILES.frame(spark, sf_dir).select("file_id", paths.normalised(raw).alias("path"))


@query("o079_ancestor_rules", over("v_files", "WITH p AS (SELECT file_id, string_split(path, '/') AS s FROM v_files), a AS (SELECT file_id, s, unnest(range(0, len(s))) AS k FROM p) SELECT DISTINCT CASE WHEN k = 0 THEN '' ELSE array_to_string(s[1:k], '/') || '/' END || 'RULES.md' AS path FROM a"))
def ancestor_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = FILES.frame(spark, sf_dir).select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).distinct()
    return folders.select(F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), F.lit("RULES.md")).alias("path"))


@query("o162_changed_paths", over("v_old v_new", "SELECT path FROM v_old UNION SELECT path FROM v_new"))
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OLD_FILES.frame(spark, sf_dir).select("path").union(NEW_FILES.frame(spark, sf_dir).select("path")).distinct()


@query("o070_import_resolution", over("v_files", "WITH c AS (SELECT DISTINCT path FROM v_files), w AS (SELECT file_id, 'src/file' || cast(file_id + 6 AS string) AS base FROM v_files WHERE regexp_matches(path, '^src/[^/]*$')), t AS (SELECT w.file_id, c.path, row_number() OVER (PARTITION BY w.file_id ORDER BY CASE c.path WHEN w.base || '.ts' THEN 0 WHEN w.base || '.py' THEN 1 ELSE 2 END) AS k FROM w JOIN c ON c.path IN (w.base || '.ts', w.base || '.py', w.base || '.md')) SELECT file_id, path FROM t WHERE k = 1"))
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = FILES.frame(spark, sf_dir)
    wanted = files.where(F.col("path").rlike("^src/[^/]*$")).select("file_id", paths.normalised(F.concat(F.lit("src/./x/../file"), (F.col("file_id") + 6).cast("string"))).alias("base"))
    tried = wanted.select("file_id", "base", F.posexplode(F.array(*map(F.lit, [".ts", ".py", ".md"]))).alias("k", "suffix")).withColumn("path", F.concat("base", "suffix"))
    return tried.join(files.select("path").distinct(), "path").groupBy("file_id").agg(F.min_by("path", "k").alias("path"))


@query("o112_focus_text", "SELECT doc_id // 20 AS g, cast(length(string_agg(text, chr(10) ORDER BY doc_id)) AS bigint) AS n_chars, sha256(string_agg(text, chr(10) ORDER BY doc_id)) AS digest FROM documents WHERE text <> '' GROUP BY 1")
def focus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ops.joined_text(documents(spark, sf_dir).where("text <> ''").withColumn("g", F.floor(F.col("doc_id") / 20)), "g", "doc_id", between="\n")
    return held.select("g", F.length("whole").cast("long").alias("n_chars"), F.sha2("whole", 256).alias("digest"))


@query("o135_clipped_fill", "WITH s AS (SELECT doc_id // 20 AS g, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY doc_id // 20 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, text FROM documents) SELECT g, doc_id, cast(length(substr(text, 1, cast(12000 - used AS bigint))) AS bigint) AS taken FROM s WHERE used < 12000")
def clipped_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 20).alias("g"), "doc_id", "text")
    return ops.clipped_fill(rows, "g", "doc_id", "text", 12_000).select("g", "doc_id", F.length("shown").cast("long").alias("taken"))


@query("o219_matching_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, count(*) FILTER (WHERE regexp_matches(lower(line), '(^|[^a-z0-9_$])the($|[^a-z0-9_$])')) AS n_matching FROM l GROUP BY 1")
def matching_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.size(ops.matching_lines(F.col("text"), ["the"])).cast("long").alias("n_matching"))


@query("o002_read_with_fallback", "SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'own ' || doc_id WHEN doc_id % 5 > 0 THEN 'kept ' || doc_id % 5 END AS content FROM documents")
def read_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    blob = F.concat(F.lit("b"), (F.col("doc_id") % 5).cast("string"))
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    working = docs.where("doc_id % 3 = 0").select(path.alias("path"), F.concat(F.lit("own "), F.col("doc_id").cast("string")).alias("content"))
    stored = docs.select(blob.alias("blob_hash"), F.concat(F.lit("kept "), (F.col("doc_id") % 5).cast("string")).alias("content")).where("blob_hash <> 'b0'").distinct()
    return ops.with_fallback(docs.select(path.alias("path"), blob.alias("blob_hash")), working, stored)


@query("o001_tree_entries", "SELECT source AS repo_id, 'src/f' || doc_id || '.ts' AS path, sha1(cast(doc_id AS string)) AS blob_hash, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END AS size FROM documents WHERE source IS NOT NULL AND doc_id % 4 > 1")
def tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 4 == 0, "160000 commit").when(F.col("doc_id") % 4 == 1, "120000 blob").otherwise("100644 blob")
    size = F.when(F.col("doc_id") % 7 == 0, "-").otherwise(F.col("n_chars").cast("string"))
    record = F.concat(kind, F.lit(" "), F.sha1(F.col("doc_id").cast("string").cast("binary")), F.lit("  "), size, F.lit("\tsrc/f"), F.col("doc_id").cast("string"), F.lit(".ts"))
    listings = documents(spark, sf_dir).where("source IS NOT NULL").groupBy(F.col("source").alias("repo_id")).agg(F.array_join(F.collect_list(record), "\0").alias("raw"))
    return ops.tree_entries(listings)


@query("o022_chunk_ids", "SELECT file_id, count(*) AS n, count(*) AS n_ids FROM (SELECT doc_id AS file_id, unnest([1, 2]) FROM documents) GROUP BY 1")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("file_id"), F.explode(F.array(F.lit(1), F.lit(41))).alias("start_line"), F.col("text").alias("content"))
    made = ops.with_chunk_ids(rows.withColumn("end_line", F.col("start_line") + 39))
    return made.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("n_ids"))
