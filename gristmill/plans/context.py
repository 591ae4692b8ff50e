"""Queries of what reviewers are shown: names, mentions, windows of lines, fills, rankings, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import context as ops
from gristmill.operators import diffs, evidence
from gristmill.plans.registry import query
from gristmill.sources.tables import CHANGES, CODE, DRAFTS, FINDINGS, over, table

NAMES = "names AS (SELECT file_id, pull_id, path, unnest(['fn' || file_id % 40, 'y' || file_id % 23, 'z' || file_id % 7]) AS name FROM v_code)"
SYMBOLS = "syms AS (SELECT file_id, pull_id, path, unnest(CASE WHEN file_id % 3 = 0 THEN ['fn' || file_id % 40, 'ar' || file_id % 13] ELSE ['fn' || file_id % 40, 'K' || file_id % 9] END) AS name FROM v_changes)"


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CODE.frame(spark, sf_dir)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CHANGES.frame(spark, sf_dir)


@query("o210_exported_names", over("v_code", f"WITH {NAMES} SELECT file_id, string_agg(name, ',' ORDER BY name) AS names FROM names GROUP BY 1"))
def exported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).select("file_id", F.array_join(F.sort_array(ops.exported_names(F.col("content"))), ",").alias("names"))


@query("o211_changed_symbols", over("v_changes", f"WITH {SYMBOLS} SELECT file_id, string_agg(name, ',' ORDER BY name) AS symbols FROM syms GROUP BY 1"))
def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select("file_id", F.array_join(F.sort_array(ops.changed_symbols(F.col("path"), F.col("text"))), ",").alias("symbols"))


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: Telling names of a list in order, each once, and the terms of a change (file_id, path, changed), reckoned over lists of matches.
TELLING = f"list_filter({{0}}, lambda n, i: length(n) >= 2 AND NOT list_contains({_listed(ops.CONTEXT_KEYWORDS)}, lower(n)) AND list_position({{0}}, n) = i)"
DECLARED = "list_concat(" + ", ".join(f"regexp_extract_all(changed, '{p}', 1)" for p in (ops.CHANGED_FUNCTION.replace(r"(?=\s*\()", r"\s*\("), ops.CHANGED_CLASS, ops.CHANGED_ARROW)) + ")"


def _terms(view: str) -> str:
    symbols = TELLING.format("declared") + "[1:2]"
    of = lambda test: f"list_transform(list_filter(kinds, lambda x: {test}), lambda x: x.t)"
    return (
        f"m AS (SELECT file_id, path, {DECLARED} AS declared, list_concat(list_filter(regexp_extract_all(changed, '{text.IDENTIFIER}'), lambda w: length(w) >= {text.MIN_IDENTIFIER} AND NOT list_contains({_listed(text.KEYWORDS)}, lower(w))), regexp_extract_all(changed, '{ops.NAME}')) AS found, "
        f"list_concat(regexp_extract_all(changed, '\\.(\\w+)', 1), regexp_extract_all(changed, '(\\w+)(?:\\s*[.$({{\\[=,:;)]|\\z)', 1), regexp_extract_all(changed, '`[^`]*?\\b(\\w+)`', 1)) AS used FROM {view}), "
        "q AS (SELECT file_id, path, declared, list_filter(found, lambda t, i: list_position(found, t) = i AND (regexp_matches(t, '[A-Z_$]') OR list_contains(used, t))) AS precise FROM m), "
        "k AS (SELECT file_id, path, declared, list_transform(precise, lambda t: {'t': t, 'strong': regexp_matches(t, '[a-z][A-Z]|^[A-Z]{2,}$|[_$]'), 'capital': regexp_matches(t, '^[A-Z][a-z]+$')}) AS kinds FROM q), "
        f"e AS (SELECT file_id, list_concat({symbols}, {of('x.strong')}, {of('NOT x.strong AND NOT x.capital')}, regexp_extract_all(path, '[A-Za-z][A-Za-z0-9_]*'), {of('NOT x.strong AND x.capital')}) AS every FROM k) "
        f"SELECT file_id, array_to_string({TELLING.format('every')}, ',') AS terms FROM e"
    )


@query("o212_context_terms", over("v_changes", f"WITH c AS (SELECT file_id, path, text AS changed FROM v_changes), {_terms('c')}"))
def context_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select("file_id", F.array_join(ops.context_terms(F.col("path"), F.col("text")), ",").alias("terms"))


@query("o212_terms_of_texts", over("v_drafts", f"WITH {_terms('v_drafts')}"))
def terms_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DRAFTS.frame(spark, sf_dir).select("file_id", F.array_join(ops.context_terms(F.col("path"), F.col("changed")), ",").alias("terms"))


@query("o211_symbols_of_texts", over("v_drafts", f"WITH d AS (SELECT file_id, {DECLARED} AS declared FROM v_drafts) SELECT file_id, array_to_string({TELLING.format('declared')}[1:2], ',') AS symbols FROM d"))
def symbols_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DRAFTS.frame(spark, sf_dir).select("file_id", F.array_join(ops.changed_symbols(F.col("path"), F.col("changed")), ",").alias("symbols"))


@query("o210_exports_of_texts", over("v_drafts", f"WITH n AS (SELECT file_id, unnest(regexp_extract_all(content, '{ops.EXPORTED}', 1)) AS name FROM v_drafts UNION SELECT file_id, name FROM (SELECT file_id, string_split_regex(regexp_replace(one, '^\\s+|\\s+$', '', 'g'), '\\s+as\\s+')[-1] AS name FROM (SELECT file_id, unnest(string_split(listed, ',')) AS one FROM (SELECT file_id, unnest(regexp_extract_all(content, '{ops.EXPORT_LIST}', 1)) AS listed FROM v_drafts))) WHERE regexp_matches(name, '^{ops.NAME}$')) SELECT file_id, name FROM n"))
def exports_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DRAFTS.frame(spark, sf_dir).select("file_id", F.explode(ops.exported_names(F.col("content"))).alias("name"))


@query("o071_export_mentions", over("v_code v_changes", f"WITH {NAMES}, said AS (SELECT DISTINCT pull_id, path, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM v_changes) SELECT DISTINCT s.pull_id, s.path, n.path AS other FROM said s JOIN names n ON n.pull_id = s.pull_id AND n.name = s.name WHERE s.path <> n.path"))
def export_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.export_mentions(code(spark, sf_dir), changes(spark, sf_dir))


@query("o080_symbol_mentions", over("v_code v_changes", f"WITH {SYMBOLS}, ls AS (SELECT pull_id, path, file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS at FROM v_code), met AS (SELECT s.pull_id, s.path, l.path AS other, l.file_id, string_agg(DISTINCT l.at, ',' ORDER BY l.at) AS lines FROM syms s JOIN ls l ON l.pull_id = s.pull_id AND l.path <> s.path WHERE regexp_matches(l.line, '(^|[^A-Za-z0-9_$?!])' || s.name || '($|[^A-Za-z0-9_$?!])', 'i') GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY pull_id, path ORDER BY CASE WHEN starts_with(other, 'tests/') THEN 0 ELSE 1 END, file_id) AS place FROM met) SELECT pull_id, path, other, lines, cast(place AS bigint) AS place FROM r WHERE place <= 2"))
def symbol_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = ops.symbol_mentions(code(spark, sf_dir).withColumn("ordinal", F.col("file_id")), changes(spark, sf_dir))
    return met.select("pull_id", "path", "other", F.array_join("lines", ",").alias("lines"), F.col("place").cast("long").alias("place"))


@query("o132_spaced_points", "WITH g AS (SELECT o_custkey % 30 AS g, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY 1) SELECT g, array_to_string(CASE WHEN len(l) <= 8 THEN l ELSE list_transform(range(8), lambda i: l[cast(floor(i * (len(l) - 1) / 7 + 0.5) AS bigint) + 1]) END, ',') AS points FROM g")
def spaced_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 30).alias("g")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("l"))
    return groups.select("g", F.array_join(ops.spaced(F.col("l")), ",").alias("points"))


@query("o133_head_windows", "WITH t AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents WHERE text <> ''), a AS (SELECT DISTINCT doc_id, ls, unnest([doc_id % 30, 1, doc_id % 70]) AS p FROM t), v AS (SELECT *, greatest(80, 12000 // count(*) OVER (PARTITION BY doc_id)) AS share FROM a WHERE p > 0 AND p <= len(ls)), "
    "l AS (SELECT doc_id, p, share, unnest(range(greatest(1, p - 20), least(len(ls), p + 20) + 1)) AS line, ls FROM v), c AS (SELECT doc_id, p, share, line, CASE WHEN length(ls[line]) > 600 THEN substr(ls[line], 1, 600) || ' ... (line truncated)' ELSE ls[line] END AS text FROM l), "
    "s AS (SELECT *, sum(length(line || '') + 3 + length(text) + 1) OVER (PARTITION BY doc_id, p ORDER BY abs(line - p), line ROWS UNBOUNDED PRECEDING) AS used FROM c) SELECT DISTINCT doc_id, cast(line AS integer) AS line, text FROM s WHERE used <= share")  # fmt: skip
def head_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array(F.col("doc_id") % 30, F.lit(1).cast("long"), F.col("doc_id") % 70)
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), points.alias("points"))
    return ops.head_windows(files, 12_000).select("doc_id", F.explode("shown").alias("s")).select("doc_id", "s.line", "s.text")


FILL = "r AS (SELECT k, pos, id, n <= {b} AS taken, CASE WHEN n <= {b} THEN n + {s} ELSE 0 END AS used FROM i WHERE pos = 1 UNION ALL SELECT i.k, i.pos, i.id, r.used + i.n <= {b}, r.used + CASE WHEN r.used + i.n <= {b} THEN i.n + {s} ELSE 0 END FROM r JOIN i ON i.k = r.k AND i.pos = r.pos + 1)"


@query("o127_skip_fill", f"WITH RECURSIVE i AS (SELECT doc_id % 50 AS k, doc_id AS id, n_chars AS n, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS pos FROM documents), {FILL.format(b=24000, s=2)} SELECT k, id, taken FROM r")
def skip_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("k"), F.col("doc_id").alias("id"), F.col("n_chars").alias("n"))
    return ops.skip_fill(items, "k", "id", "n", 24_000).select("k", "id", "taken")


@query("o136_admitted_blocks", f"WITH RECURSIVE b AS (SELECT doc_id % 20 AS k, doc_id, repeat('block ' || doc_id % 7 || ' ', cast(doc_id % 11 AS integer)) AS block FROM documents), d AS (SELECT k, min(doc_id) AS id, cast(length(block) + 2 AS bigint) AS n FROM b WHERE trim(block) <> '' GROUP BY k, block), i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS pos FROM d), {FILL.format(b=300, s=0)} SELECT k, id, taken FROM r")
def admitted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.expr("repeat(concat('block ', doc_id % 7, ' '), cast(doc_id % 11 AS int))")
    blocks = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("key"), F.col("doc_id").alias("ordinal"), block.alias("block"))
    return ops.admitted_blocks(blocks, 300).select(F.col("key").alias("k"), F.col("ordinal").alias("id"), "taken")


RELEVANT = (
    "asked AS (SELECT DISTINCT pull_id, unnest(['fn' || pull_id * 3 % 40, 'y' || pull_id % 23, 'call', 'z' || pull_id % 7]) AS term, generate_subscripts([1, 2, 3, 4], 1) AS i, 'src/f' || pull_id || '.ts' AS changed FROM v_code), "
    "hits AS (SELECT c.pull_id, c.file_id, c.path, sum(CASE WHEN regexp_matches(c.path || chr(10) || c.content, '(^|[^a-z0-9_$])' || term || '($|[^a-z0-9_$])', 'i') THEN CASE WHEN i <= 3 THEN 2.0::double ELSE 1.0::double END ELSE 0 END) + max(CASE WHEN regexp_matches(c.path, '(^|[^a-z0-9_$])f' || c.pull_id || '($|[^a-z0-9_$])', 'i') THEN 0.25::double ELSE 0 END) AS score "
    "FROM v_code c JOIN asked a ON a.pull_id = c.pull_id AND a.changed <> c.path GROUP BY 1, 2, 3), "
    "rel AS (SELECT *, row_number() OVER (PARTITION BY pull_id ORDER BY score DESC, file_id) AS place FROM hits WHERE score > 0)"
)


def relevant(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    files = code(spark, sf_dir)
    p = F.col("pull_id")
    word = lambda name, n: F.concat(F.lit(name), n.cast("string"))
    wanted = files.select("pull_id").distinct().select(p.alias("query_id"), F.array(word("fn", p * 3 % 40), word("y", p % 23), F.lit("call"), word("z", p % 7)).alias("terms"), F.concat(F.lit("src/f"), p.cast("string"), F.lit(".ts")).alias("changed_path"))
    chunks = files.select(p.alias("query_id"), F.col("file_id").alias("ordinal"), F.col("file_id").alias("chunk_id"), "path", "content")
    return ops.relevant_chunks(chunks, wanted, limit)


@query("o146_relevant_chunks", over("v_code", f"WITH {RELEVANT} SELECT pull_id AS query_id, file_id AS chunk_id, score, place FROM rel WHERE place <= 8"))
def relevant_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevant(spark, sf_dir, 8).select("query_id", "chunk_id", "score", F.col("place").cast("long").alias("place"))


@query("o147_test_slot", over("v_code", f"WITH {RELEVANT}, t AS (SELECT *, min(CASE WHEN starts_with(path, 'tests/') THEN place END) OVER (PARTITION BY pull_id) AS ft FROM rel) SELECT pull_id AS query_id, file_id AS chunk_id, least(place, 3) AS place FROM t WHERE place < 3 OR (place = 3 AND coalesce(ft <= 3, true)) OR (ft > 3 AND place = ft)"))
def test_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_test_slot(relevant(spark, sf_dir, 1 << 30), 3).select("query_id", "chunk_id", F.col("place").cast("long").alias("place"))


@query("o160_ordered_union", over("v_findings", "WITH r AS (SELECT review_id AS query_id, ordinal % 3 AS part, ordinal AS rank, line % 4 AS chunk_id, cast(ordinal * 2 AS double) AS score FROM v_findings), u AS (SELECT query_id, chunk_id, min(part * 1000 + rank) AS first, arg_max(score, part * 1000 + rank) AS score FROM r GROUP BY 1, 2) SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM u"))
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    results = FINDINGS.frame(spark, sf_dir).select(c("review_id").alias("query_id"), (c("ordinal") % 3).alias("part"), c("ordinal").alias("rank"), (c("line") % 4).alias("chunk_id"), (c("ordinal") * 2).cast("double").alias("score"))
    return ops.ordered_union(results).withColumn("place", c("place").cast("long"))


@query("o161_half_and_half", over("v_code", "WITH o AS (SELECT pull_id, file_id, path, row_number() OVER (PARTITION BY pull_id ORDER BY file_id) AS pos FROM v_code WHERE file_id % 3 > 0), f AS (SELECT pull_id, file_id, path, row_number() OVER (PARTITION BY pull_id ORDER BY file_id DESC) AS pos FROM v_code WHERE file_id % 3 < 2), "
    "e AS (SELECT *, 0 AS part, CASE WHEN pos > 2 THEN 2 ELSE 0 END AS turn FROM o UNION ALL SELECT *, 1, 1 FROM f), g AS (SELECT pull_id, file_id, path, min(turn * 100000000 + pos) AS first, min(part * 100000000 + pos) AS seen FROM e GROUP BY 1, 2, 3), "
    "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pull_id ORDER BY first) AS place FROM g WHERE first < 200000000) WHERE place <= 4), t AS (SELECT pull_id, arg_min(file_id, seen) AS test FROM g WHERE starts_with(path, 'tests/') GROUP BY 1), "
    "n AS (SELECT pull_id, max(place) AS n FROM p GROUP BY 1) SELECT p.pull_id AS query_id, CASE WHEN t.test IS NOT NULL AND p.place = n.n AND NOT EXISTS (SELECT 1 FROM p AS h WHERE h.pull_id = p.pull_id AND h.file_id = t.test) THEN t.test ELSE p.file_id END AS chunk_id, p.place FROM p JOIN n ON n.pull_id = p.pull_id LEFT JOIN t ON t.pull_id = p.pull_id"))  # fmt: skip
def half_and_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code(spark, sf_dir).select(F.col("pull_id").alias("query_id"), F.col("file_id").alias("chunk_id"), "path")
    w = Window.partitionBy("query_id")
    original = files.where("chunk_id % 3 > 0").withColumn("place", F.row_number().over(w.orderBy("chunk_id")))
    focused = files.where("chunk_id % 3 < 2").withColumn("place", F.row_number().over(w.orderBy(F.desc("chunk_id"))))
    return ops.half_and_half(original, focused, 4).select("query_id", "chunk_id", F.col("place").cast("long").alias("place"))


@query("o150_relevant_first", over("v_findings", "WITH f AS (SELECT review_id % 20 AS review_id, review_id * 10 + ordinal AS ordinal, path, severity FROM v_findings), k AS (SELECT DISTINCT review_id, path FROM f WHERE severity = 'critical'), r AS (SELECT f.review_id, f.ordinal, row_number() OVER (PARTITION BY f.review_id ORDER BY CASE WHEN k.path IS NULL THEN 1 ELSE 0 END, f.ordinal) AS place FROM f LEFT JOIN k ON k.review_id = f.review_id AND k.path = f.path) SELECT * FROM r WHERE place <= 80"))
def relevant_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    facts = FINDINGS.frame(spark, sf_dir).select((c("review_id") % 20).alias("review_id"), (c("review_id") * 10 + c("ordinal")).alias("ordinal"), "path", "severity")
    return ops.relevant_first(facts, facts.where("severity = 'critical'")).select("review_id", "ordinal", c("place").cast("long").alias("place"))


@query("o084_anchor_lines", over("v_findings", "WITH e AS (SELECT review_id AS owner, path, unnest([line, line + ordinal]) AS line FROM v_findings) SELECT owner, path, string_agg(DISTINCT line, ',' ORDER BY line) AS lines FROM e GROUP BY 1, 2"))
def anchor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = FINDINGS.frame(spark, sf_dir).select(F.col("review_id").alias("owner"), "path", F.col("line").alias("start_line"), (F.col("line") + F.col("ordinal")).alias("end_line"))
    return ops.anchor_lines(chunks).withColumn("lines", F.array_join("lines", ","))


# ---- diffs: one file and hunk a review, a line for each finding: critical ones added, warnings removed, nits as context

SIGNED = "CASE severity WHEN 'critical' THEN '+' WHEN 'warning' THEN '-' ELSE ' ' END"
LINES = f"dl AS (SELECT review_id, ordinal, {SIGNED} AS sign, title, cast(10 + count(*) FILTER (WHERE severity <> 'critical') OVER (PARTITION BY review_id ORDER BY ordinal) AS bigint) AS o, cast(20 + count(*) FILTER (WHERE severity <> 'warning') OVER (PARTITION BY review_id ORDER BY ordinal) AS bigint) AS n FROM v_findings)"


def diff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """diff_id, text: a unified diff of each review's findings."""
    sign = F.when(F.col("severity") == "critical", "+").when(F.col("severity") == "warning", "-").otherwise(" ")
    made = FINDINGS.frame(spark, sf_dir).groupBy("review_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", F.concat(sign, "title").alias("t")))).alias("rows"),
        F.count_if(F.col("severity") != "critical").cast("string").alias("old"), F.count_if(F.col("severity") != "warning").cast("string").alias("new"), F.col("review_id").cast("string").alias("id"),
    )
    path = F.concat(F.lit("src/d"), "id", F.lit(".ts"))
    gone = F.col("review_id") % 5 == 0
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.when(gone, "\ndeleted file mode 100644").otherwise(""), F.lit("\n--- a/"), path, F.lit("\n+++ "), F.when(gone, "/dev/null").otherwise(F.concat(F.lit("b/"), path)))
    hunk = F.concat(F.lit("\n@@ -11,"), "old", F.lit(" +21,"), "new", F.lit(" @@ f()\n"))
    body = F.array_join(F.transform("rows", lambda r: r["t"]), "\n")
    return made.select(F.col("review_id").alias("diff_id"), F.concat(head, hunk, body, F.lit("\n")).alias("text"))


@query("o223_diff_lines", over("v_findings", f"WITH {LINES} SELECT review_id AS diff_id, ordinal, CASE sign WHEN '+' THEN 'add' WHEN '-' THEN 'del' ELSE 'ctx' END AS type, CASE WHEN sign <> '+' THEN o END AS old_line, CASE WHEN sign <> '-' THEN n END AS new_line, title AS content FROM dl"))
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = diffs.diff_lines(diff_texts(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("diff_id").orderBy("at")).cast("long")
    return lines.select("diff_id", place.alias("ordinal"), "type", F.col("old_line").cast("long").alias("old_line"), F.col("new_line").cast("long").alias("new_line"), "content")


@query("o224_commentable_lines", over("v_findings", f"WITH {LINES} SELECT review_id AS diff_id, coalesce(string_agg(n, ',' ORDER BY n) FILTER (WHERE sign = '+'), '') AS added, coalesce(string_agg(n, ',' ORDER BY n) FILTER (WHERE sign <> '-'), '') AS commentable FROM dl GROUP BY 1"))
def commentable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diffs.commentable(diffs.diff_lines(diff_texts(spark, sf_dir)))
    return found.select("diff_id", F.array_join("added", ",").alias("added"), F.array_join("commentable", ",").alias("commentable"))


@query("o051_allowed_lines", over("v_findings", f"WITH {LINES}, a AS (SELECT review_id, coalesce(string_agg(n, ',' ORDER BY n) FILTER (WHERE sign = '+'), '') AS added, coalesce(string_agg(o, ',' ORDER BY o) FILTER (WHERE sign <> '+'), '') AS old FROM dl GROUP BY 1) SELECT review_id AS diff_id, CASE WHEN review_id % 5 = 0 OR added = '' THEN old ELSE added END AS lines, review_id % 5 = 0 OR added = '' AS body_only FROM a"))
def allowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = diff_texts(spark, sf_dir)
    found = diffs.allowed_lines(diffs.diff_lines(texts), diffs.diff_files(texts))
    return found.select("diff_id", F.array_join("lines", ",").alias("lines"), "body_only")


@query("o203_numbered_hunks", over("v_findings", f"WITH {LINES}, h AS (SELECT review_id, 0 AS pos, '@@ -11,' || count(*) FILTER (WHERE sign <> '+') || ' +21,' || count(*) FILTER (WHERE sign <> '-') || ' @@ f()' AS row FROM dl GROUP BY 1 UNION ALL SELECT review_id, ordinal, lpad(cast(CASE WHEN sign = '-' THEN o ELSE n END AS string), 5, ' ') || ' ' || sign || ' ' || title FROM dl), u AS (SELECT *, sum(length(row) + 1) OVER (PARTITION BY review_id ORDER BY pos) AS used FROM h) SELECT review_id AS diff_id, string_agg(row, chr(10) ORDER BY pos) FILTER (WHERE used <= 70) || CASE WHEN max(used) > 70 THEN chr(10) || '... (truncated)' ELSE '' END AS text FROM u GROUP BY 1"))
def numbered_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.numbered_hunks(diff_texts(spark, sf_dir), 70).select("diff_id", "text")


@query("o202_unquoted_paths", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'dir/\"q\" ' || o_orderkey WHEN 1 THEN 'src/f' || o_orderkey || '.ts' WHEN 2 THEN NULL ELSE 'c/plain' END AS path FROM orders")
def unquoted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat('\"b/dir/\\\\\"q\\\\\" ', o_orderkey, '\"') WHEN 1 THEN concat('  a/src/f', o_orderkey, '.ts ') WHEN 2 THEN '/dev/null' ELSE 'c/plain' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", diffs.stripped_path(raw).alias("path"))


@query("o225_static_evidence", "SELECT concat('src/e', l_orderkey, '_', l_linenumber, '_', l_suppkey, '.ts') AS path, f.* FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_suppkey % 3 AS k FROM lineitem), (SELECT unnest([1, 2, 3]) AS p) AS x, LATERAL (SELECT cast(p AS bigint) AS place, cast(CASE p WHEN 1 THEN 1 ELSE 3 END AS bigint) AS line, CASE p WHEN 1 THEN 'declared-parameters' WHEN 2 THEN 'awaited-call' ELSE 'local-api-arity' END AS kind, CASE p WHEN 1 THEN 'g declares 1-2 parameters' WHEN 2 THEN CASE k WHEN 0 THEN 'g()' WHEN 1 THEN 'g(1)' ELSE 'g(1, [2, 3], \"    \")' END ELSE 'g expects 1-2 arguments but receives ' || CASE k WHEN 0 THEN 0 ELSE 3 END END AS detail) AS f WHERE NOT (p = 3 AND k = 1)")
def static_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('src/e', l_orderkey, '_', l_linenumber, '_', l_suppkey, '.ts') AS path",
        "concat('function g(a, b = 1) {', chr(10), '// h(1) \"', chr(10), 'await g(', CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '1' ELSE '1, [2, 3], \"f(x)\"' END, ')') AS content",
    ).distinct()
    return evidence.static_evidence(files)


@query("o234_compact_context", over("v_findings", "WITH f AS (SELECT review_id, path, line, title FROM v_findings WHERE ordinal % 2 = 1), sh AS (SELECT review_id, path AS file, path, ordinal, line + ordinal * 7 AS line, title AS text FROM v_findings UNION ALL SELECT review_id, path, 'lib/' || ordinal || '.ts', ordinal + 10, ordinal, CASE WHEN line % 2 = 0 THEN 'call(Name' || title || ')' ELSE 'see loadOne!' END FROM v_findings), "
    "own AS (SELECT s.* FROM sh s WHERE s.file = s.path AND EXISTS (SELECT 1 FROM f WHERE f.review_id = s.review_id AND f.path = s.path AND abs(f.line - s.line) <= 10)), rel AS (SELECT s.* FROM sh s WHERE s.file <> s.path AND EXISTS (SELECT 1 FROM f WHERE f.review_id = s.review_id AND f.path = s.file) AND s.text = 'see loadOne!'), "
    "k AS (SELECT review_id, file, path, min(ordinal) AS first, string_agg(DISTINCT line, ',' ORDER BY line) AS lines, sum(length(text) + length(cast(line AS string)) + 4) AS n FROM (SELECT * FROM own UNION ALL SELECT * FROM rel) GROUP BY 1, 2, 3), i AS (SELECT review_id AS k, file || '>' || path AS id, n, row_number() OVER (PARTITION BY review_id ORDER BY file, CASE WHEN file = path THEN 0 ELSE 1 END, first, path) AS pos, file, path, lines FROM k), "
    f"{FILL.format(b=60, s=0)} SELECT r.k AS review_id, i.file, i.path, i.lines, cast(i.n AS bigint) AS size, r.taken FROM r JOIN i ON i.k = r.k AND i.pos = r.pos").replace("WITH ", "WITH RECURSIVE ", 1))  # fmt: skip
def compact_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, rows = F.col, FINDINGS.frame(spark, sf_dir)
    findings = rows.where("ordinal % 2 = 1").select("review_id", "path", "line", "title", F.lit("calls loadOne").alias("body"))
    own = rows.select("review_id", c("path").alias("file"), "path", "ordinal", (c("line") + c("ordinal") * 7).alias("line"), c("title").alias("text"))
    text = F.when(c("line") % 2 == 0, F.concat(F.lit("call(Name"), "title", F.lit(")"))).otherwise("see loadOne!")
    other = rows.select("review_id", c("path").alias("file"), F.concat(F.lit("lib/"), c("ordinal").cast("string"), F.lit(".ts")).alias("path"), (c("ordinal") + 10).alias("ordinal"), c("ordinal").alias("line"), text.alias("text"))
    found = ops.compact_context(findings, own.unionByName(other), budget=60)
    return found.select("review_id", "file", "path", F.array_join("lines", ",").alias("lines"), "size", "taken")
