"""Queries from model output to a published review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import publishing as ops
from gristmill.plans.registry import query
from gristmill.sources.tables import FINDINGS, over, table

CAUSE = "substr(sha256(lower(regexp_replace(coalesce(nullif(regexp_replace(root_cause, '^\\s+|\\s+$', '', 'g'), ''), path || ':' || line || ':' || title), '\\s+', ' ', 'g'))), 1, 16)"
C = F.col


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FINDINGS.frame(spark, sf_dir)


@query("o189_extracted_json", "SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 4 THEN '[1, ' || event_id || ']' ELSE '{\"id\": ' || event_id || ', \"s\": \"} {\"}' END AS json FROM events")
def extracted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(F.lit('{"id": '), C("event_id").cast("string"), F.lit(', "s": "} {"}'))
    kind = C("event_id") % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit(" "), whole, F.lit("\n"))).when(kind == 1, F.concat(F.lit("Here {it} is:\n```json\n"), whole, F.lit("\n```\n[2]"))).when(kind == 2, F.concat(F.lit("See {this: "), whole, F.lit("} {}")))
        .when(kind == 3, F.concat(F.lit("{broken ] then "), whole)).when(kind == 4, F.concat(F.lit("ids [1, "), C("event_id").cast("string"), F.lit("] end"))).otherwise("nothing { here")
    )
    return ops.extracted_json(table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))).select("event_id", "json")


@query("o226_parsed_findings", over("v_findings", "SELECT review_id, path, ordinal, CASE WHEN (review_id + ordinal) % 11 = 10 THEN 'malformed' WHEN (review_id + ordinal) % 11 = 0 THEN 'line' WHEN (review_id + ordinal) % 11 = 1 THEN 'empty' WHEN (review_id + ordinal) % 11 = 2 THEN 'severity' WHEN (review_id + ordinal) % 11 = 3 THEN 'category' WHEN (review_id + ordinal) % 11 = 4 THEN 'confidence' WHEN (review_id + ordinal) % 11 = 5 THEN 'evidence line' WHEN (review_id + ordinal) % 11 = 6 THEN 'trigger' WHEN (review_id + ordinal) % 11 = 7 THEN 'rule quote' END AS error FROM v_findings"))
def parsed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir).withColumn("k", (C("review_id") + C("ordinal")) % 11)
    is_ = lambda n, bad, good: F.when(C("k") == n, bad).otherwise(good)
    evidence = F.struct(
        C("path"), is_(5, "7.5", C("line").cast("string")).alias("line"), is_(6, "  ", F.lit("when called")).alias("trigger"), F.lit("it fails").alias("consequence"),
        F.struct(F.lit("AGENTS.md").alias("path"), F.lit(3).alias("line"), is_(7, "", F.lit("be kind")).alias("quote")).alias("rule"),
    )
    one = F.struct(
        is_(0, F.lit(99_999).cast("long"), C("line")).alias("line"), is_(1, " ", C("title")).alias("title"), F.lit("").alias("body"), is_(2, "loud", F.lit(" High")).alias("severity"),
        is_(3, "style", is_(7, "repository_rule", F.lit("security"))).alias("category"), is_(4, "sure", F.lit("HIGH ")).alias("confidence"), F.lit("cause").alias("rootCause"), evidence.alias("evidence"),
    )
    said = F.when(C("k") == 10, "null").otherwise(F.to_json(one))
    outputs = rows.select("review_id", C("path").alias("of"), "ordinal", F.concat(F.lit('{"findings": ['), said, F.lit("]}")).alias("json"))
    allowed = rows.select("review_id", "path", "line", "ordinal")
    keyed = outputs.select(F.concat_ws("/", "review_id", "ordinal").alias("review_id"), C("of").alias("path"), "json")
    lines = allowed.select(F.concat_ws("/", "review_id", "ordinal").alias("review_id"), "path", F.array("line").alias("lines"), F.lit(False).alias("body_only"))
    parsed = ops.parsed_findings(keyed, lines)
    at = F.split("review_id", "/")
    return parsed.select(at[0].cast("long").alias("review_id"), "path", at[1].cast("long").alias("ordinal"), "error")


@query("o235_valid_requests", "SELECT event_id AS review_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'src/r' || event_id || '.ts' END AS path, CASE WHEN event_id % 2 = 0 THEN 'Foo.bar!' ELSE 'call_it' END AS symbol, 'why so' AS question FROM events WHERE event_id % 7 IN (0, 1, 6)")
def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = C("event_id") % 7, C("event_id").cast("string")
    path = F.when(k == 0, None).when(k == 2, F.concat(F.lit("/src/r"), n)).when(k == 3, F.concat(F.lit("src/../r"), n)).otherwise(F.concat(F.lit("src/r"), n, F.lit(".ts")))
    symbol = F.when(k == 4, "1x").otherwise(F.when(C("event_id") % 2 == 0, "Foo.bar!").otherwise("call_it"))
    extra = F.when(k == 5, F.lit("yes"))
    rows = table(spark, sf_dir, "events").select(C("event_id").alias("review_id"), F.lit(0).alias("ordinal"), F.to_json(F.struct(path.alias("path"), symbol.alias("symbol"), F.lit(" why \n so ").alias("question"), extra.alias("extra"))).alias("json"))
    changed = rows.select("review_id", F.lit("src/other.ts").alias("path"))
    return ops.valid_requests(rows, changed).select("review_id", "path", "symbol", "question")


@query("o083_acquired_evidence", over("v_code", "WITH asked AS (SELECT pull_id, p, w FROM (SELECT DISTINCT pull_id FROM v_code), (SELECT unnest([NULL, 'x']) AS p, unnest(['fn', 'y']) AS w)), met AS (SELECT c.pull_id, c.path, c.file_id, string_agg(DISTINCT a.w || (a.pull_id % 5), ',' ORDER BY a.w || (a.pull_id % 5)) AS symbols FROM v_code c JOIN asked a ON a.pull_id = c.pull_id AND regexp_matches(c.content, '(^|[^A-Za-z0-9_$?!])' || a.w || (a.pull_id % 5) || '($|[^A-Za-z0-9_$?!])') AND (a.p IS NULL OR c.path = 'src/f' || (a.pull_id + 23 * 20) || '.ts') WHERE c.file_id % 4 > 0 GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY pull_id ORDER BY file_id, path) AS k FROM met) SELECT pull_id AS review_id, path, symbols FROM r WHERE k <= 4"))
def acquired_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.sources.tables import CODE

    files = CODE.frame(spark, sf_dir).select(C("pull_id").alias("review_id"), "path", C("file_id").alias("ordinal"), "content")
    reviews, n = files.select("review_id").distinct(), (C("review_id") % 5).cast("string")
    one = reviews.select("review_id", F.lit(None).cast("string").alias("path"), F.concat(F.lit("fn"), n).alias("symbol"))
    two = reviews.select("review_id", F.concat(F.lit("src/f"), (C("review_id") + 460).cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("y"), n).alias("symbol"))
    found = ops.acquired_evidence(one.unionByName(two), files, files.where("ordinal % 4 = 0"))
    return found.select("review_id", "path", F.array_join("symbols", ",").alias("symbols"))


@query("o074_cited_rules", over("v_findings", "SELECT review_id, ordinal, CASE WHEN ordinal % 4 = 3 THEN NULL WHEN ordinal % 4 = 0 AND line % 7 <> review_id % 7 THEN 'unsupported' WHEN line > 3 OR line % 2 = 0 THEN 'mismatch' END AS fault FROM v_findings"))
def cited_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    place = F.concat(F.lit("//src//n"), (C("review_id") % 7).cast("string"), F.lit("/AGENTS.md"))
    cite = rows.select(
        "review_id", "ordinal", F.concat(F.lit("src/n"), (C("line") % 7).cast("string"), F.lit("/in/x.ts")).alias("path"),
        F.when(C("ordinal") % 4 == 3, None).when(C("ordinal") % 4 == 0, F.substr(place, F.lit(3))).otherwise("CLAUDE.md").alias("rule_path"), C("line").alias("rule_line"),
        F.when(C("line") % 2 == 0, "no such rule").otherwise(F.concat(F.lit(" rule "), C("line").cast("string"))).alias("rule_quote"),
    )
    content = F.lit("rule 1\r\n  rule 2 \nrule 3")
    ids = rows.select("review_id").distinct()
    rules = ids.select("review_id", F.explode(F.array(F.lit("CLAUDE.md"), F.concat(F.lit("src/n"), (C("review_id") % 7).cast("string"), F.lit("/AGENTS.md")))).alias("path"), content.alias("content"))
    return ops.cited_rules(cite, rules).select("review_id", "ordinal", "fault")


@query("o073_not_yet_commented", over("v_findings", f"WITH k AS (SELECT *, {CAUSE} AS cause FROM v_findings), marks AS (SELECT DISTINCT review_id + 1 AS review_id, cause FROM k WHERE ordinal % 3 = 0), said AS (SELECT review_id + 1 AS review_id, path, line, title FROM k WHERE ordinal % 3 = 1), gone AS (SELECT review_id, cause FROM marks UNION SELECT k.review_id, k.cause FROM k JOIN said s ON s.review_id = k.review_id AND s.path = k.path AND s.line = k.line AND contains('About ' || s.title || '0!', k.title)) SELECT review_id, ordinal FROM k WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.review_id = k.review_id AND g.cause = k.cause)"))
def not_yet_commented(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.operators.reviews import with_cause

    rows = findings(spark, sf_dir)
    body = F.when(C("ordinal") % 3 == 0, F.concat(F.lit("<!-- root-cause:"), "cause", F.lit(" -->"))).otherwise(F.concat(F.lit("About "), "title", F.lit("0!")))
    comments = with_cause(rows).where("ordinal % 3 < 2").select((C("review_id") + 1).alias("review_id"), F.when(C("ordinal") % 3 == 1, C("path")).alias("path"), "line", body.alias("body"))
    return ops.not_yet_commented(rows, comments).select("review_id", "ordinal")


FOLLOW = (
    "cur AS (SELECT review_id, ordinal AS id, path, title, trim(root_cause) AS cause FROM v_findings WHERE ordinal % 2 = 1), "
    "d AS (SELECT review_id, ordinal AS id, path, line, title, trim(root_cause) AS cause, CASE (review_id + ordinal) % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'retracted' WHEN 2 THEN 'remaining' ELSE CASE WHEN ordinal % 5 = 4 THEN 'unconfirmed' ELSE 'remaining' END END AS status, CASE WHEN (review_id + ordinal) % 4 >= 2 THEN CASE WHEN ordinal % 3 = 0 THEN NULL ELSE ordinal - (ordinal + 1) % 2 END WHEN (review_id + ordinal) % 8 = 0 THEN 1 END AS fi FROM v_findings), "
    "m AS (SELECT d.*, EXISTS (SELECT 1 FROM cur c WHERE c.review_id = d.review_id AND c.path = d.path AND (c.title = d.title OR (c.cause <> '' AND c.cause = d.cause))) AS matched, EXISTS (SELECT 1 FROM cur c WHERE c.review_id = d.review_id AND c.id = d.fi AND c.path = d.path AND (c.title = d.title OR (c.cause <> '' AND c.cause = d.cause))) AS fits, EXISTS (SELECT 1 FROM v_findings v WHERE v.review_id = d.review_id AND v.path = d.path AND v.line = d.line AND v.severity = 'critical') AS in_delta, EXISTS (SELECT 1 FROM v_findings v WHERE v.review_id = d.review_id AND v.path = d.path AND v.line = d.line AND v.severity <> 'nit') AS in_head, row_number() OVER (PARTITION BY review_id, status, fi ORDER BY id) AS uses FROM d), "
    "j AS (SELECT *, CASE WHEN status = 'unconfirmed' THEN 'status' WHEN status = 'remaining' AND fi IS NULL THEN 'no finding' WHEN status = 'remaining' AND NOT fits THEN 'no match' WHEN status <> 'remaining' AND matched THEN 'match remains' WHEN status = 'resolved' AND NOT in_delta THEN 'not in delta' WHEN status <> 'resolved' AND NOT in_head THEN 'not in head' WHEN status = 'remaining' AND uses > 1 THEN 'finding used twice' WHEN status <> 'remaining' AND fi IS NOT NULL THEN 'finding named' END AS error FROM m)"
)


def followup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = findings(spark, sf_dir).select("review_id", C("ordinal").alias("id"), "path", "line", "title", F.trim("root_cause").alias("root_cause"), "severity")
    current, turn = rows.where("id % 2 = 1"), (C("review_id") + C("id")) % 4
    status = F.when(turn == 0, "resolved").when(turn == 1, "retracted").when((turn == 3) & (C("id") % 5 == 4), "unconfirmed").otherwise("remaining")
    index = F.when(turn >= 2, F.when(C("id") % 3 != 0, C("id") - (C("id") + 1) % 2)).when((C("review_id") + C("id")) % 8 == 0, F.lit(1).cast("long"))
    decisions = rows.select("review_id", "id", status.alias("status"), index.alias("finding_index"), F.lit("new").alias("side"), "path", "line")
    delta = rows.where("severity = 'critical'").select("review_id", F.lit("new").alias("side"), "path", "line")
    return current, ops.reconciled(rows, current, decisions, delta, rows.where("severity <> 'nit'"))


@query("o229_followup", over("v_findings", f"WITH {FOLLOW} SELECT review_id, id, status, error FROM j"))
def followup_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followup(spark, sf_dir)[1].select("review_id", "id", "status", "error")


@query("o229_followup_kept", over("v_findings", f"WITH {FOLLOW} SELECT review_id, id FROM cur c WHERE id % 4 = 3 OR EXISTS (SELECT 1 FROM j WHERE j.review_id = c.review_id AND j.fi = c.id AND j.status = 'remaining' AND j.error IS NULL)"))
def followup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, judged = followup(spark, sf_dir)
    return ops.kept_of_followup(current, judged, current.where("id % 4 = 3")).select("review_id", "id")


@query("o072_history", over("v_findings", "WITH t AS (SELECT review_id, min(ordinal) AS place, path FROM v_findings GROUP BY 1, 3), no AS (SELECT DISTINCT path, cast(regexp_extract(path, '[0-9]+', 0) AS bigint) AS p FROM v_findings), cm AS (SELECT path, turn, (p * 3 + turn) % 90 AS sha FROM no, (SELECT unnest([1, 2, 3, 4, 5]) AS turn)), pl AS (SELECT sha, turn, (sha * 2 + turn) % 60 AS pull FROM (SELECT DISTINCT sha FROM cm), (SELECT unnest([1, 2]) AS turn)), "
    "seen AS (SELECT t.review_id, t.place, t.path, cm.turn AS ct, cm.sha FROM t JOIN cm ON cm.path = t.path WHERE t.place <= 8 AND cm.turn <= 3), looked AS (SELECT review_id, sha, row_number() OVER (PARTITION BY review_id ORDER BY pos) AS nth FROM (SELECT review_id, sha, min(place * 100 + ct) AS pos FROM seen GROUP BY 1, 2)), "
    "held AS (SELECT s.review_id, s.path, l.nth, pl.turn AS pt, pl.pull FROM seen s JOIN looked l ON l.review_id = s.review_id AND l.sha = s.sha JOIN pl ON pl.sha = s.sha WHERE l.nth <= 12 AND pl.pull % 4 <> 0 AND pl.pull <> s.review_id % 60 AND pl.pull % 3 = s.review_id % 3), taken AS (SELECT review_id, pull, row_number() OVER (PARTITION BY review_id ORDER BY pos) AS k FROM (SELECT review_id, pull, min(nth * 100 + pt) AS pos FROM held GROUP BY 1, 2)), "
    "pairs AS (SELECT DISTINCT h.review_id, h.path, h.pull FROM held h JOIN taken t ON t.review_id = h.review_id AND t.pull = h.pull WHERE t.k <= 3), f AS (SELECT review_id % 60 AS pull, review_id * 10 + ordinal AS ordinal, path, title FROM v_findings), r AS (SELECT p.review_id, p.path, p.pull, f.ordinal, f.title, row_number() OVER (PARTITION BY p.review_id, p.path, p.pull ORDER BY f.ordinal) AS k FROM pairs p JOIN f ON f.pull = p.pull AND f.path = p.path) SELECT review_id, path, pull, ordinal, title FROM r WHERE k <= 8"))  # fmt: skip
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    repo = F.concat(F.lit("Repo"), (C("review_id") % 3).cast("string"))
    touched = rows.groupBy("review_id", "path").agg(F.min("ordinal").alias("place")).withColumns({"own_pull": C("review_id") % 60, "repo": repo})
    # the paths are told without a finding's place, so for them the table needn't be dealt out by review
    paths = table(spark, sf_dir, FINDINGS.source).selectExpr(f"{FINDINGS.columns['path']} AS path").distinct()
    numbered = paths.withColumn("p", F.regexp_extract("path", "[0-9]+", 0).cast("long"))
    commits = numbered.withColumn("turn", F.explode(F.array(*map(F.lit, range(1, 6))))).select("path", "turn", ((C("p") * 3 + C("turn")) % 90).alias("sha"))
    pulls = commits.select("sha").distinct().withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("pull", (C("sha") * 2 + C("turn")) % 60)
    pulls = pulls.withColumns({"merged": C("pull") % 4 != 0, "repo": F.concat(F.lit("repo"), (C("pull") % 3).cast("string"))})
    said = rows.select((C("review_id") % 60).alias("pull"), (C("review_id") * 10 + C("ordinal")).alias("ordinal"), "path", "title")
    # 50 paths and 90 commits, however long the table is
    return ops.history(touched, F.broadcast(commits), F.broadcast(pulls), said).select("review_id", "path", "pull", "ordinal", "title")


BODY_ROWS = "b AS (SELECT *, CASE WHEN ordinal % 3 = 0 THEN 0 ELSE line END AS pos, CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS s FROM v_findings)"


@query("o218_review_bodies", over("v_findings v_reviews", f"WITH {BODY_ROWS}, g AS (SELECT review_id, count(*) AS n, count(*) FILTER (WHERE s = 1) AS c, count(*) FILTER (WHERE s = 2) AS w, count(*) FILTER (WHERE s = 3) AS i, string_agg('| ' || severity || ' | ' || path || ':' || pos || ' | a\\|' || title || ' |', chr(10) ORDER BY s, path, pos, ordinal) AS rows, string_agg('- **[' || severity || '] a\\|' || title || '** (' || path || ')' || chr(10) || chr(10) || 'text', chr(10) ORDER BY s, path, pos, ordinal) FILTER (WHERE pos = 0) AS loose FROM b GROUP BY 1) "
    "SELECT r.review_id, sha256(concat_ws(chr(10), CASE WHEN r.review_id % 2 = 0 THEN '## Follow-up review' ELSE '## Review' END || chr(10) || chr(10) || CASE WHEN r.review_id % 2 = 0 THEN 'Follow-up review 2' ELSE 'Sum' END || chr(10), '**Verdict:** comment · **Findings:** ' || coalesce(n, 0) || ' (' || coalesce(c, 0) || ' critical, ' || coalesce(w, 0) || ' warnings, ' || coalesce(i, 0) || ' nits)', "
    "CASE WHEN n > 0 THEN chr(10) || '| Severity | File | Title |' || chr(10) || '| --- | --- | --- |' || chr(10) || rows END, CASE WHEN loose IS NOT NULL THEN chr(10) || '### Findings without an inline location' || chr(10) || loose END, '', CASE WHEN r.review_id % 3 = 0 THEN 'Skipped files (not reviewed): a.lock, b.png' || chr(10) END, "
    "CASE WHEN r.review_id % 2 = 0 THEN '<sub>Review 2 of this pull request; ' || (r.review_id % 3) || CASE WHEN r.review_id % 3 = 1 THEN ' commit' ELSE ' commits' END || ' since abcdef0.</sub>' || chr(10) END, '<sub>Generated by m1</sub>')) AS digest FROM v_reviews r LEFT JOIN g ON g.review_id = r.review_id"))  # fmt: skip
def review_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.sources.tables import REVIEWS

    even = C("review_id") % 2 == 0
    none = F.array().cast("array<string>")
    reviews = REVIEWS.frame(spark, sf_dir).select(
        "review_id", F.when(even, " Follow-up review 2".strip()).otherwise("Sum ").alias("summary"), F.lit("comment").alias("verdict"), F.lit("m1").alias("model"),
        F.when(C("review_id") % 3 == 0, F.array(F.lit("a.lock"), F.lit("b.png"))).otherwise(none).alias("skipped"), F.lit(2).alias("number"), F.when(even, C("review_id") % 3).alias("since"), F.lit("abcdef0123").alias("head_sha"),
    )
    rows = findings(spark, sf_dir).select("review_id", "ordinal", "path", F.when(C("ordinal") % 3 == 0, F.lit(0).cast("long")).otherwise(C("line")).alias("line"), "severity", F.concat(F.lit("a|"), "title", F.lit("\n")).alias("title"), F.lit("text").alias("body"))
    return ops.review_bodies(reviews, rows).select("review_id", F.sha2("body", 256).alias("digest"))


@query("o214_delta_texts", over("v_reviews", "SELECT review_id, CASE WHEN review_id % 3 = 0 THEN 'Delta unavailable: ' || substr(head_sha, 1, 7) || ' could not be compared with the current head. Treat the previous findings as possibly stale.' WHEN review_id % 3 = 1 THEN 'This file is unchanged since the previous review at ' || substr(head_sha, 1, 7) || '.' ELSE 'Diff of this file from ' || substr(head_sha, 1, 7) || ' to the current head, with new-file line numbers:' || chr(10) || chr(10) || '@@ hunk' END AS delta FROM v_reviews"))
def delta_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.sources.tables import REVIEWS

    turn = C("review_id") % 3
    return REVIEWS.frame(spark, sf_dir).select("review_id", ops.delta_text(turn != 0, C("head_sha"), F.when(turn == 2, "@@ hunk")).alias("delta"))


@query("o215_prompts", over("v_findings", "SELECT review_id, ordinal, '## Pull request' || chr(10) || chr(10) || title || chr(10) || chr(10) || CASE WHEN root_cause IS NULL THEN '' ELSE '## Rules' || chr(10) || chr(10) || regexp_replace(root_cause, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) END || '## File under review: ' || path || chr(10) || chr(10) || 'Diff:' || chr(10) || chr(10) || line || chr(10) || chr(10) || 'Report findings as JSON.' AS prompt FROM v_findings"))
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("Pull request", C("title")), ("Blank", F.lit(" \n ")), ("Rules", C("root_cause")), (F.concat(F.lit("File under review: "), "path"), F.concat(F.lit("Diff:\n\n"), C("line").cast("string")))]
    return findings(spark, sf_dir).select("review_id", "ordinal", ops.prompt(parts, "Report findings as JSON.").alias("prompt"))


@query("o009_stream_answers", "SELECT event_id AS stream_id, CASE WHEN event_id % 4 < 2 THEN 'a \"' || event_id || 'b' END AS answer, cast(CASE event_id % 4 WHEN 0 THEN 2 WHEN 3 THEN 3 ELSE 3 END AS bigint) AS frames, CASE event_id % 4 WHEN 2 THEN 'unfinished' WHEN 3 THEN 'malformed' END AS fault FROM events")
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("event_id") % 4
    delta = lambda said: F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), said, F.lit('"}}]}\n'))
    two = F.concat(F.lit(": keep-alive\n\nevent: x\n"), delta(F.lit("a ")), F.lit("\r\n"), delta(F.concat(F.lit('\\"'), C("event_id").cast("string"), F.lit("b"))))
    tail = (
        F.when(k == 0, "data: [DONE]\ndata: {never read").when(k == 1, 'data:{"choices":[{"finish_reason":"stop"}]}').when(k == 2, 'data: {"usage":{}}').otherwise("data: {cut")
    )
    return ops.stream_answers(table(spark, sf_dir, "events").select(C("event_id").alias("stream_id"), F.concat(two, tail).alias("text")))


@query("o227_embedding_batches", "WITH e AS (SELECT event_id, event_id % 5 AS k FROM events) SELECT event_id AS batch_id, cast(NULL AS bigint) AS position, cast(NULL AS string) AS vector, CASE k WHEN 0 THEN 'count' ELSE 'not numeric' END AS fault FROM e WHERE k < 2 UNION ALL SELECT event_id, p, CASE p WHEN 0 THEN '1.5,-2.0' ELSE event_id || '.0,0.25' END, NULL FROM e, (SELECT unnest([0, 1]) AS p) WHERE k >= 2")
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("event_id") % 5
    second = F.concat(F.lit('{"index":1,"embedding":['), C("event_id").cast("string"), F.when(k == 1, ',"x"]}').otherwise(",0.25]}"))
    data = F.concat(F.lit('{"data":['), second, F.when(k == 0, "").otherwise(',{"index":0,"embedding":[1.5,-2]}'), F.lit("]}"))
    found = ops.embedding_batches(table(spark, sf_dir, "events").select(C("event_id").alias("batch_id"), F.lit(2).alias("expected"), data.alias("json")))
    return found.select("batch_id", "position", F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",").alias("vector"), "fault")


@query("o198_formats", "SELECT event_id, CASE WHEN value / 10000 > 0 AND value / 10000 < 0.0001 THEN '<$0.0001' ELSE '$' || CASE WHEN value / 10000 < 1 THEN printf('%.4f', value / 10000) ELSE printf('%.2f', value / 10000) END END AS usd, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 2592000 THEN s // 86400 || 'd ago' WHEN s < 31104000 THEN s // 2592000 || 'mo ago' ELSE s // 31536000 || 'y ago' END AS ago FROM (SELECT event_id, value, event_id * event_id * 7 AS s FROM events)")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ago = ops.seconds_ago(C("event_id") * C("event_id") * 7)
    return table(spark, sf_dir, "events").select("event_id", ops.usd(C("value") / 10_000).alias("usd"), ago.alias("ago"))


def _pads(secret: bytes) -> tuple[str, str]:
    key = secret.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


SECRET = b"secret of the query"


@query("o205_signatures", f"SELECT event_id, 'sha256=' || sha256(unhex('{_pads(SECRET)[1]}') || unhex(sha256(unhex('{_pads(SECRET)[0]}') || encode(props)))) AS signature, event_id % 3 = 0 AS verified FROM events")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ops.signed(C("props"), SECRET)
    header = F.when(C("event_id") % 3 == 0, made).when(C("event_id") % 3 == 1, F.lit("sha256=00"))
    return table(spark, sf_dir, "events").select("event_id", made.alias("signature"), ops.verified_signature(C("props"), header, SECRET).alias("verified"))
