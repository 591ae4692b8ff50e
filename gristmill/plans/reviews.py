"""Queries of review findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import reviews as ops
from gristmill.plans.registry import query
from gristmill.sources.tables import FINDINGS, REVIEWS, over, table

RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END"
CAUSE = "substr(sha256(lower(regexp_replace(coalesce(nullif(regexp_replace(root_cause, '^\\s+|\\s+$', '', 'g'), ''), path || ':' || line || ':' || title), '\\s+', ' ', 'g'))), 1, 16)"
COUNTS = "cnt AS (SELECT review_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'nit') AS nit, count(*) AS total FROM v_findings GROUP BY 1)"
KEYED = f"k AS (SELECT *, {CAUSE} || ':' || path || ':' || line AS key FROM v_findings), n AS (SELECT *, row_number() OVER (PARTITION BY review_id, key ORDER BY ordinal) AS nth FROM k)"
# decisions on findings: what a verifier would say, from the data itself
DECISIONS = "d AS (SELECT review_id, ordinal, CASE (line + ordinal) % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'uncertain' ELSE 'supported' END AS decision, CASE WHEN ordinal > 1 AND (line + ordinal) % 8 = 2 THEN 1 END AS duplicate_of FROM v_findings)"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FINDINGS.frame(spark, sf_dir)


def decisions(rows: DataFrame) -> DataFrame:
    turn = (F.col("line") + F.col("ordinal")) % 4
    decided = F.when(turn == 0, "rejected").when(turn == 1, "uncertain").otherwise("supported")
    duplicate = F.when((F.col("ordinal") > 1) & ((F.col("line") + F.col("ordinal")) % 8 == 2), F.lit(1))
    return rows.select("review_id", "ordinal", decided.alias("decision"), duplicate.alias("duplicate_of"))


@query("o095_severity_histogram", over("v_findings", f"WITH {COUNTS} SELECT * FROM cnt"))
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.severity_counts(findings(spark, sf_dir))


@query("o096_verdicts", over("v_findings v_reviews", f"WITH {COUNTS} SELECT r.review_id, CASE WHEN critical > 0 THEN 'request_changes' WHEN total > 0 THEN 'comment' ELSE 'approve' END AS verdict FROM v_reviews r LEFT JOIN cnt ON cnt.review_id = r.review_id"))
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ops.severity_counts(findings(spark, sf_dir))
    return REVIEWS.frame(spark, sf_dir).join(counts, "review_id", "left").select("review_id", ops.verdict(F.col("critical"), F.col("total")).alias("verdict"))


@query("o097_status", over("v_findings", f"WITH {COUNTS}, s AS (SELECT *, concat_ws(', ', CASE WHEN critical > 0 THEN critical || ' critical' END, CASE WHEN warning > 0 THEN warning || ' warning' || CASE WHEN warning = 1 THEN '' ELSE 's' END END, CASE WHEN nit > 0 THEN nit || ' nit' || CASE WHEN nit = 1 THEN '' ELSE 's' END END) AS said FROM cnt) SELECT review_id, CASE WHEN critical > 0 THEN 'failure' ELSE 'success' END AS state, CASE WHEN said = '' THEN 'No blocking findings' ELSE said END AS description FROM s"))
def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.status(ops.severity_counts(findings(spark, sf_dir))).select("review_id", "state", "description")


@query("o101_cause_groups", over("v_findings", f"SELECT review_id, {CAUSE} AS cause, count(*) AS n FROM v_findings WHERE category <> 'test_gap' GROUP BY 1, 2"))
def cause_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ops.with_cause(findings(spark, sf_dir).where("category <> 'test_gap'"))
    return held.groupBy("review_id", "cause").agg(F.count(F.lit(1)).alias("n"))


@query("o104_lines_by_type", over("v_findings", "SELECT review_id, count(*) FILTER (WHERE severity = 'critical') AS added, count(*) FILTER (WHERE severity = 'warning') AS removed, count(*) FILTER (WHERE severity = 'nit') AS context FROM v_findings GROUP BY 1"))
def lines_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [F.count_if(F.col("severity") == s).alias(n) for s, n in (("critical", "added"), ("warning", "removed"), ("nit", "context"))]
    return findings(spark, sf_dir).groupBy("review_id").agg(*kinds)


@query("o108_summaries", over("v_findings", "WITH g AS (SELECT review_id, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'warning') AS w, count(*) FILTER (WHERE severity = 'nit') AS i, string_agg(title || ' (' || path || ':' || CASE WHEN line = 0 THEN 'body' ELSE cast(line AS string) END || ')', '; ' ORDER BY ordinal) AS details FROM v_findings GROUP BY 1) SELECT review_id, 'The review found ' || CASE WHEN n = 1 THEN '1 actionable issue' ELSE n || ' actionable issues' END || ' (' || concat_ws(', ', CASE WHEN c > 0 THEN c || ' critical' END, CASE WHEN w > 0 THEN w || ' warning' END, CASE WHEN i > 0 THEN i || ' nit' END) || '): ' || details || '.' AS summary FROM g"))
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(findings(spark, sf_dir))


@query("o123_representatives", over("v_findings", f"WITH k AS (SELECT *, {CAUSE} AS cause FROM v_findings WHERE category <> 'test_gap'), p AS (SELECT *, row_number() OVER (PARTITION BY review_id, cause ORDER BY {RANK}, path, line, title, ordinal) AS place FROM k), o AS (SELECT review_id, cause, string_agg(path || ':' || line, ', ' ORDER BY ordinal) AS related FROM p WHERE place > 1 AND line > 0 GROUP BY 1, 2) SELECT p.review_id, p.cause, p.ordinal, p.severity, p.path, p.line, p.title, coalesce(o.related, '') AS related FROM p LEFT JOIN o ON o.review_id = p.review_id AND o.cause = p.cause WHERE place = 1"))
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.representatives(findings(spark, sf_dir))


@query("o124_first_of_each", over("v_findings", f"WITH {KEYED} SELECT review_id, ordinal, key FROM n WHERE nth = 1"))
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.occurrences(findings(spark, sf_dir)).where("nth = 1").select("review_id", "ordinal", "key")


@query("o125_occurrence_ids", over("v_findings", f"WITH {KEYED} SELECT review_id, ordinal, CASE WHEN nth = 1 THEN key ELSE key || ':' || (nth - 1) END AS id FROM n"))
def occurrence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.occurrences(findings(spark, sf_dir)).select("review_id", "ordinal", "id")


@query("o144_finding_order", over("v_findings", f"SELECT review_id, ordinal, row_number() OVER (PARTITION BY review_id ORDER BY {RANK}, path, line, ordinal) AS place FROM v_findings"))
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ordered(findings(spark, sf_dir)).select("review_id", "ordinal", "place")


@query("o166_arbitration", over("v_findings", f"WITH {DECISIONS} SELECT f.review_id, f.ordinal, f.path FROM v_findings f JOIN d ON d.review_id = f.review_id AND d.ordinal = f.ordinal WHERE decision <> 'supported' AND duplicate_of IS NULL"))
def arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    return ops.arbitrated(rows, decisions(rows)).select("review_id", "ordinal", "path")


@query("o082_verified", over("v_findings", f"WITH {DECISIONS} SELECT f.review_id, f.ordinal, CASE severity WHEN 'nit' THEN 'warning' ELSE severity END AS severity FROM v_findings f JOIN d ON d.review_id = f.review_id AND d.ordinal = f.ordinal WHERE decision = 'supported' AND duplicate_of IS NULL"))
def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    return ops.verified(rows, decisions(rows)).select("review_id", "ordinal", "severity")


@query("o081_escalated", over("v_findings", f"WITH {DECISIONS}, bad AS (SELECT f.review_id, f.path, f.line FROM v_findings f JOIN d ON d.review_id = f.review_id AND d.ordinal = f.ordinal WHERE decision = 'rejected') SELECT f.review_id, f.ordinal FROM v_findings f JOIN d ON d.review_id = f.review_id AND d.ordinal = f.ordinal WHERE decision <> 'rejected' AND NOT (decision = 'uncertain' AND EXISTS (SELECT 1 FROM bad b WHERE b.review_id = f.review_id AND b.path = f.path AND b.line = f.line))"))
def escalated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    return ops.escalated(rows, decisions(rows)).select("review_id", "ordinal")


@query("o228_duplicate_roots", "WITH RECURSIVE l AS (SELECT p_partkey AS id, p_partkey // 3 AS target FROM part WHERE p_partkey > 2), r AS (SELECT id, target AS root FROM l UNION ALL SELECT r.id, l.target FROM r JOIN l ON l.id = r.root) SELECT id, root FROM r WHERE root NOT IN (SELECT id FROM l)")
def duplicate_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "part").where("p_partkey > 2").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("target"))
    return ops.roots(links)


@query("o076_near_evidence", over("v_findings", "SELECT DISTINCT e.review_id, e.path, e.line FROM v_findings e JOIN v_findings f ON f.review_id = e.review_id AND f.path = e.path AND abs(f.line - e.line) <= 10 WHERE f.severity = 'critical'"))
def near_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    return ops.near_evidence(rows.select("review_id", "path", "line"), rows.where("severity = 'critical'"), within=10)


@query("o075_allowed_citations", over("v_findings", "SELECT review_id, ordinal FROM v_findings f WHERE EXISTS (SELECT 1 FROM v_findings a WHERE a.severity = 'warning' AND a.review_id = f.review_id AND a.path = f.path AND a.line = f.line)"))
def allowed_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    return ops.allowed_citations(rows, rows.where("severity = 'warning'")).select("review_id", "ordinal")


@query("o077_lines_in_hunks", over("v_findings", "WITH h AS (SELECT review_id, path, min(line) AS a, max(line) AS b FROM v_findings WHERE severity <> 'nit' GROUP BY 1, 2) SELECT f.review_id, f.ordinal FROM v_findings f JOIN h ON h.review_id = f.review_id AND h.path = f.path WHERE f.line BETWEEN a AND b"))
def lines_in_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    hunks = ops.hunk_bounds(rows.where("severity <> 'nit'"), F.lit(True))
    return ops.lines_in_hunks(rows, hunks).select("review_id", "ordinal")


@query("o078_matched_findings", over("v_findings", "SELECT DISTINCT p.review_id, p.ordinal FROM v_findings p JOIN v_findings c ON c.review_id = p.review_id + 1 AND c.path = p.path AND (c.title = p.title OR c.root_cause = p.root_cause)"))
def matched_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    return ops.matched_findings(rows, rows.withColumn("review_id", F.col("review_id") - 1)).select("review_id", "ordinal")


@query("o109_hunk_bounds", over("v_findings", "SELECT review_id, path, coalesce(min(CASE WHEN severity <> 'nit' THEN line END), greatest(1, min(line))) AS first_line, coalesce(max(CASE WHEN severity <> 'nit' THEN line END), greatest(1, min(line))) AS last_line FROM v_findings GROUP BY 1, 2"))
def hunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.hunk_bounds(findings(spark, sf_dir), F.col("severity") != "nit")


@query("o110_distinct_lines", over("v_findings", "SELECT review_id, path, string_agg(DISTINCT line, ',' ORDER BY line) AS lines FROM v_findings GROUP BY 1, 2"))
@query("o111_citation_lines", over("v_findings", "SELECT review_id, path, string_agg(DISTINCT line, ',' ORDER BY line) AS lines FROM v_findings GROUP BY 1, 2"))
def distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_lines(findings(spark, sf_dir)).withColumn("lines", F.array_join("lines", ","))


@query("o102_reservations", "WITH a AS (SELECT o_custkey AS review_id, o_orderkey AS ordinal, o_totalprice / 1000000 AS cost FROM orders), s AS (SELECT *, sum(cost) OVER (PARTITION BY review_id ORDER BY ordinal) AS total FROM a) SELECT review_id, ordinal, round(total, 6) <= 0.495::double AS accepted FROM s")
def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("review_id"), F.col("o_orderkey").alias("ordinal"), (F.col("o_totalprice") / 1_000_000).alias("cost"))
    return ops.reserved(attempts, 0.495).select("review_id", "ordinal", "accepted")


@query("o199_severities", "SELECT event_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'view' THEN NULL ELSE CASE event_type WHEN 'click' THEN 'warning' WHEN 'purchase' THEN 'nit' END END AS severity FROM events")
def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "click", " Medium ").when(F.col("event_type") == "purchase", "INFO").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", ops.normal_severity(raw).alias("severity"))


@query("o200_cause_keys", over("v_findings", f"SELECT review_id, ordinal, {CAUSE} AS cause FROM v_findings"))
def cause_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_cause(findings(spark, sf_dir)).select("review_id", "ordinal", "cause")


@query("o164_kept_findings", over("v_findings", f"WITH {DECISIONS} SELECT review_id, ordinal FROM d WHERE decision = 'supported' UNION SELECT review_id, ordinal FROM v_findings WHERE severity = 'critical'"))
def kept_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    remaining = decisions(rows).where("decision = 'supported'").select("review_id", "ordinal")
    return remaining.union(rows.where("severity = 'critical'").select("review_id", "ordinal")).distinct()


@query("o167_merged_history", over("v_findings", "WITH u AS (SELECT review_id, path, line, title, ordinal, 0 AS side FROM v_findings UNION ALL SELECT review_id, path, line, title, ordinal, 1 FROM v_findings WHERE severity = 'critical'), r AS (SELECT *, row_number() OVER (PARTITION BY review_id, path, line, title ORDER BY side, ordinal) AS k FROM u) SELECT review_id, path, line, title FROM r WHERE k = 1"))
def merged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    return ops.merged_history(rows, rows.where("severity = 'critical'"), ["review_id", "path", "line", "title"]).drop("first")


@query("o055_exact_ids", over("v_findings", "SELECT review_id, count(*) = max(ordinal) AND count(DISTINCT ordinal) = count(*) AS exact FROM v_findings WHERE severity <> 'nit' GROUP BY 1"))
def exact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.exact_ids(findings(spark, sf_dir).where("severity <> 'nit'"))
