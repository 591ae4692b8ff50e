"""Algebra of review findings: causes, representatives, duplicates, verdicts, arbitration, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators.steps import settled

# Severities by rank, and other names for them.
SEVERITIES = ["critical", "warning", "nit"]
SEVERITY_NAMES = {"blocker": "critical", "error": "critical", "high": "critical", "medium": "warning", "moderate": "warning", "low": "nit", "info": "nit", "informational": "nit"}
NO_FINDINGS = "The review found no actionable issues in the supplied changes."


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def normal_severity(raw: Column) -> Column:
    """One of the three severities; null for unknown names."""
    low = text.stripped(F.lower(raw))
    known = F.create_map(*[F.lit(x) for pair in SEVERITY_NAMES.items() for x in pair])
    return F.when(low.isin(SEVERITIES), low).otherwise(F.try_element_at(known, low))


def with_cause(findings: DataFrame) -> DataFrame:
    return findings.withColumn("cause", text.root_cause_key(F.col("root_cause"), F.col("path"), F.col("line"), F.col("title")))


def representatives(findings: DataFrame) -> DataFrame:
    """One finding for each cause of a review, test gaps left out: the most severe, then by path, line and title; with the
    places of the others as ``related``."""
    held = with_cause(findings.where("category <> 'test_gap'"))
    order = [severity_rank(F.col("severity")), "path", "line", "title", "ordinal"]
    placed = held.withColumn("place", F.row_number().over(Window.partitionBy("review_id", "cause").orderBy(*order)))
    others = F.sort_array(F.collect_list(F.when((F.col("place") > 1) & (F.col("line") > 0), F.struct("ordinal", F.concat_ws(":", "path", F.col("line").cast("string")).alias("at")))))
    first = F.min_by(F.struct("ordinal", "severity", "path", "line", "title"), "place")
    grouped = placed.groupBy("review_id", "cause").agg(first.alias("f"), others.alias("o"))
    return grouped.select("review_id", "cause", "f.*", F.array_join(F.transform("o", lambda x: x["at"]), ", ").alias("related"))


def occurrences(findings: DataFrame) -> DataFrame:
    """``key`` (cause, path and line of a finding), ``nth`` (from 1, in the order of the input) and ``id``, the key with a
    suffix for repeats."""
    keyed = with_cause(findings).withColumn("key", F.concat_ws(":", "cause", "path", F.col("line").cast("string")))
    nth = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("review_id", "key").orderBy("ordinal")).cast("long"))
    return nth.withColumn("id", F.when(F.col("nth") == 1, F.col("key")).otherwise(F.concat_ws(":", "key", (F.col("nth") - 1).cast("string"))))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("review_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count(F.lit(1)).alias("total"))


def verdict(critical: Column, total: Column) -> Column:
    return F.when(critical > 0, "request_changes").when(total > 0, "comment").otherwise("approve")


def _plural(n: Column, word: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s")))


def status(counts: DataFrame, fail_on: str = "critical") -> DataFrame:
    """``state`` and ``description`` of each review's counts; ``fail_on`` is critical, warning or never."""
    c = F.col
    blocking = {"critical": c("critical") > 0, "warning": c("critical") + c("warning") > 0}.get(fail_on, F.lit(False))
    said = F.concat_ws(", ", F.when(c("critical") > 0, F.concat(c("critical").cast("string"), F.lit(" critical"))), _plural(c("warning"), "warning"), _plural(c("nit"), "nit"))
    return counts.withColumn("state", F.when(blocking, "failure").otherwise("success")).withColumn("description", F.when(said == "", "No blocking findings").otherwise(said))


def summary(findings: DataFrame) -> DataFrame:
    """review_id, summary: a sentence of how many findings there are and what they say, in the order of the input."""
    c = F.col
    said = F.concat("title", F.lit(" ("), "path", F.lit(":"), F.when(c("line") == 0, "body").otherwise(c("line").cast("string")), F.lit(")"))
    grouped = findings.groupBy("review_id").agg(*[F.count_if(c("severity") == s).alias(s) for s in SEVERITIES], F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("ordinal", said.alias("s")))).alias("all"))
    by_severity = F.concat_ws(", ", *[F.when(c(s) > 0, F.concat(c(s).cast("string"), F.lit(f" {s}"))) for s in SEVERITIES])
    count = F.when(c("n") == 1, "1 actionable issue").otherwise(F.concat(c("n").cast("string"), F.lit(" actionable issues")))
    details = F.array_join(F.transform("all", lambda x: x["s"]), "; ")
    return grouped.select("review_id", F.concat(F.lit("The review found "), count, F.lit(" ("), by_severity, F.lit("): "), details, F.lit(".")).alias("summary"))


def arbitrated(findings: DataFrame, decisions: DataFrame, *, everything: bool = False) -> DataFrame:
    """Findings that go to arbitration: those not supported (or all), without duplicates. decisions: review_id, ordinal, decision, duplicate_of."""
    chosen = decisions.where(F.col("duplicate_of").isNull() & ((F.col("decision") != "supported") | F.lit(everything)))
    return findings.join(chosen.select("review_id", "ordinal"), ["review_id", "ordinal"], "left_semi")


def verified(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Supported findings without duplicates; a nit that was verified counts as a warning."""
    kept = decisions.where((F.col("decision") == "supported") & F.col("duplicate_of").isNull())
    held = findings.join(kept.select("review_id", "ordinal"), ["review_id", "ordinal"], "left_semi")
    return held.withColumn("severity", F.when(F.col("severity") == "nit", "warning").otherwise(F.col("severity")))


def roots(links: DataFrame) -> DataFrame:
    """id, root: where the chain of links (id, target) from each id ends; ids that lead to a cycle have a null root.

    Each round doubles the length of the chains followed and is settled before the next. Rounds end when nothing changes, or when
    they have followed chains as long as there are links: what still moves then is on a cycle.
    """
    jump, followed = settled(links.select("id", F.col("target").alias("root"))), 1
    n = jump.count()
    while followed < n:
        onward = jump.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        jump = settled(jump.join(onward, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), (F.col("beyond") != F.col("root")).alias("moved")))
        followed *= 2
        if not jump.where("moved").limit(1).count():
            break
    return jump.join(links.select(F.col("id").alias("root"), F.lit(True).alias("cycle")), "root", "left").select("id", F.when(F.col("cycle").isNull(), F.col("root")).alias("root"))


def near_evidence(evidence: DataFrame, findings: DataFrame, within: int = 10) -> DataFrame:
    """Evidence lines (review_id, path, line) at most ``within`` lines from a finding of the same review and path.

    Lines meet by blocks of ``within`` + 1 lines, each finding in three, so that a long file's rows don't all meet.
    """
    size = within + 1
    near = findings.select("review_id", "path", F.col("line").alias("at")).distinct().withColumn("block", F.explode(F.array(*[F.floor(F.col("at") / size) + d for d in (-1, 0, 1)])))
    mine = evidence.withColumn("block", F.floor(F.col("line") / size))
    met = mine.join(near, ["review_id", "path", "block"]).where(F.abs(F.col("line") - F.col("at")) <= within)
    return met.select("review_id", "path", "line").distinct()


def allowed_citations(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings that stand on a line of ``evidence`` (review_id, path, line)."""
    return findings.join(evidence.select("review_id", "path", "line"), ["review_id", "path", "line"], "left_semi")


def hunk_bounds(lines: DataFrame, is_new: Column) -> DataFrame:
    """review_id, path, first_line, last_line of the hunk that ``lines`` (review_id, path, line) make: of the lines of the new side, or without any the least line, 1 at least."""
    new, anchor = F.when(is_new, F.col("line")), F.greatest(F.lit(1), F.min("line"))
    return lines.groupBy("review_id", "path").agg(F.coalesce(F.min(new), anchor).alias("first_line"), F.coalesce(F.max(new), anchor).alias("last_line"))


def lines_in_hunks(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Findings within a hunk (review_id, path, first_line, last_line) of their path, once each."""
    met = findings.join(hunks, ["review_id", "path"]).where(F.col("line").between(F.col("first_line"), F.col("last_line")))
    return met.select(*findings.columns).dropDuplicates(["review_id", "ordinal"])


def distinct_lines(rows: DataFrame) -> DataFrame:
    """review_id, path, lines: ascending distinct lines."""
    return rows.groupBy("review_id", "path").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def matched_findings(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Findings of ``previous`` that one of ``current`` (same review_id and path) equals by title or by cause, once each."""
    now = current.select("review_id", "path", F.col("title").alias("title_now"), F.col("root_cause").alias("cause_now"))
    met = previous.join(now, ["review_id", "path"]).where((F.col("title") == F.col("title_now")) | (F.col("root_cause") == F.col("cause_now")))
    return met.select(*previous.columns).dropDuplicates(["review_id", "ordinal"])


def escalated(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings that go on: supported ones, and uncertain ones unless a finding of the same place was rejected."""
    judged = findings.join(decisions.select("review_id", "ordinal", "decision"), ["review_id", "ordinal"])
    bad = judged.where("decision = 'rejected'").select("review_id", "path", "line")
    kept, open_ = judged.where("decision = 'supported'"), judged.where("decision = 'uncertain'").join(bad, ["review_id", "path", "line"], "left_anti")
    return kept.select(*findings.columns).unionByName(open_.select(*findings.columns))


def merged_history(older: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct ``keys`` of both lists, with ``first``: in which (0, 1) and at which ordinal each first stands."""
    both = older.withColumn("side", F.lit(0)).unionByName(newer.withColumn("side", F.lit(1)))
    return both.groupBy(*keys).agg(F.min(F.struct("side", "ordinal")).alias("first"))


def exact_ids(rows: DataFrame) -> DataFrame:
    """review_id, exact: whether the ordinals of a review are 1, 2, ... without gap or repeat."""
    n = F.count(F.lit(1))
    return rows.groupBy("review_id").agg(((F.min("ordinal") == 1) & (F.max("ordinal") == n) & (F.count_distinct("ordinal") == n)).alias("exact"))


def ordered(findings: DataFrame) -> DataFrame:
    """``place`` of each finding of a review: by severity, path (binary order), line."""
    w = Window.partitionBy("review_id").orderBy(severity_rank(F.col("severity")), "path", "line", "ordinal")
    return findings.withColumn("place", F.row_number().over(w).cast("long"))


def reserved(attempts: DataFrame, ceiling: float) -> DataFrame:
    """``accepted``: whether the sum of a review's costs up to this attempt stays within ``ceiling``. attempts: review_id, ordinal, cost."""
    w = Window.partitionBy("review_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return attempts.withColumn("accepted", F.round(F.sum("cost").over(w), 6) <= ceiling)
