"""From model output to a published review: parsing with quarantine, citations, suppression, follow-ups, history, bodies and prompts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import paths, text
from gristmill.operators.reviews import SEVERITIES, normal_severity, severity_rank, with_cause

# What a finding may be, names of rule files, grammar of a symbol, bounds of requests and of history.
CATEGORIES = ["correctness", "edge_case", "security", "test_gap", "repository_rule"]
CONFIDENCES = ["high", "medium", "low"]
RULE_FILES = ["CLAUDE.md", "AGENTS.md"]
SYMBOL = r"^[A-Za-z_$][\w$?!]*(?:[./][A-Za-z_$][\w$?!]*)*$"
REQUESTS, REQUEST_FILES, REQUEST_CHARS = 4, 4, 180
HISTORY_PATHS, PATH_COMMITS, HISTORY_COMMITS, HISTORY_PULLS, HISTORY_FINDINGS = 8, 3, 12, 3, 8
FENCED = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.IGNORECASE)
FINDING = (
    "array<struct<line: string, title: string, body: string, severity: string, category: string, confidence: string, rootCause: string, "
    "evidence: struct<path: string, line: string, trigger: string, consequence: string, rule: struct<path: string, line: string, quote: string>>>>"
)


# ---- JSON in model output

_OPENERS = re.compile(r"[{\[]")
_DECODER = json.JSONDecoder(parse_constant=lambda name: (_ for _ in ()).throw(ValueError(name)))


def _first_value(said: str) -> str | None:
    """The first object or array in ``said`` that is JSON, as it stands there."""
    for opener in _OPENERS.finditer(said):
        try:
            _, end = _DECODER.raw_decode(said, opener.start())
            return said[opener.start() : end]
        except (ValueError, RecursionError):
            continue
    return None


def extracted_json(outputs: DataFrame, column: str = "raw") -> DataFrame:
    """``outputs`` with ``json``: the object or array that the text is, or else the first one in its first fenced block, or else in the text; null without one.

    Texts that are JSON as a whole are told by a built-in function; only the others are searched.
    """
    whole = F.col(column).rlike(r"^\s*[{\[]") & F.try_parse_json(F.col(column)).isNotNull()
    marked = outputs.withColumn("json", F.when(whole, text.stripped(F.col(column))))
    at = outputs.columns.index(column)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for said in batch.column(at).to_pylist():
                fence = FENCED.search(said) if said else None
                found.append((_first_value(fence.group(1)) if fence else None) or (_first_value(said) if said else None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], batch.schema.names)

    return marked.where("json IS NOT NULL").unionByName(marked.where("json IS NULL").mapInArrow(search, marked.schema))


def _trimmed(value: Column) -> Column:
    """``value`` without white space at its ends, told without a pattern."""
    return F.btrim(value, F.lit(" \t\n\x0b\f\r"))


def _integer(raw: Column) -> Column:
    return F.when(_trimmed(raw).rlike(r"^[+-]?\d+(\.0+)?$"), F.try_to_number(F.regexp_replace(_trimmed(raw), r"^\+|\.0+$", ""), F.lit("S999999999999999999")).cast("long"))


def _said(value: Column) -> Column:
    return F.coalesce(_trimmed(value), F.lit(""))


def parsed_findings(outputs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Findings of outputs (review_id, path, json) one a row, with ``error``: the first rule that a finding breaks, or null.

    json: an array of findings, or an object with one under ``findings``. allowed: review_id, path, lines (array of long), body_only. A
    faulty finding is a row of its own, so that it can be set aside without losing the others.
    """
    listed = F.from_json(F.when(F.col("json").rlike(r"^\s*\["), F.col("json")).otherwise(F.get_json_object("json", "$.findings")), FINDING)
    rows = outputs.select("review_id", "path", F.posexplode_outer(listed).alias("ordinal", "f")).join(allowed, ["review_id", "path"], "left")
    c, e = (lambda n: F.col(f"f.{n}")), (lambda n: F.col(f"f.evidence.{n}"))
    # what is asked more than once is read once
    read = rows.select(
        "review_id", "path", "ordinal", "lines", "body_only", "f", _integer(c("line")).alias("at"), normal_severity(c("severity")).alias("severity"), _said(c("category")).alias("category"),
        F.lower(_said(c("confidence"))).alias("confidence"), _said(c("title")).alias("title"), _said(c("body")).alias("body"), _said(c("rootCause")).alias("root_cause"),
    )
    line, title, body, rule = F.col("at"), F.col("title"), F.col("body"), F.col("category") == "repository_rule"
    error = (
        F.when(F.col("f").isNull(), "malformed").when(line.isNull() | ~F.coalesce(F.array_contains("lines", line), F.lit(False)), "line").when((title == "") & (body == ""), "empty")
        .when(F.col("severity").isNull(), "severity").when(~F.col("category").isin(CATEGORIES), "category").when(~F.col("confidence").isin(CONFIDENCES), "confidence").when(F.col("root_cause") == "", "root cause")
        .when(c("evidence").isNull(), "evidence").when(_said(e("path")) != F.col("path"), "evidence path").when(~F.coalesce(_integer(e("line")) == line, F.lit(False)), "evidence line")
        .when(_said(e("trigger")) == "", "trigger").when(_said(e("consequence")) == "", "consequence")
        .when(rule & (_said(e("rule.path")) == ""), "rule path").when(rule & ~F.coalesce(_integer(e("rule.line")) >= 1, F.lit(False)), "rule line").when(rule & (_said(e("rule.quote")) == ""), "rule quote")
    )
    return read.select(
        "review_id", "path", "ordinal", F.when(F.col("body_only"), F.lit(0).cast("long")).otherwise(line).alias("line"), "severity",
        F.when(title != "", title).otherwise(F.substr(body, F.lit(1), F.lit(60))).alias("title"), F.when(body != "", body).otherwise(title).alias("body"),
        "category", "confidence", "root_cause", c("evidence").alias("evidence"), error.alias("error"),
    )


def valid_requests(requests: DataFrame, changed: DataFrame) -> DataFrame:
    """Requests for evidence (review_id, ordinal, json) that are well formed: review_id, ordinal, path, symbol, question; of the first four only.

    Other keys, long strings, unsafe or changed paths (changed: review_id, path) and symbols out of grammar drop a request.
    """
    keys = F.json_object_keys("json")
    got = lambda k: F.get_json_object("json", f"$.{k}")
    read = requests.where((F.col("ordinal") < REQUESTS) & keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, ("path", "symbol", "question"))))) == 0))
    read = read.select("review_id", "ordinal", text.stripped(got("path")).alias("path"), text.stripped(got("symbol")).alias("symbol"), text.squeezed(got("question")).alias("question"))
    path = F.col("path")
    unsafe = (F.length(path) > REQUEST_CHARS) | path.startswith("/") | path.rlike(r"[\\:\x00]") | (path != paths.normalised(path)) | ~paths.reviewable(path)
    fit = (F.length("symbol").between(1, REQUEST_CHARS)) & F.col("symbol").rlike(SYMBOL) & F.length("question").between(1, REQUEST_CHARS) & (path.isNull() | ~unsafe)
    return read.where(fit).join(changed.select("review_id", "path"), ["review_id", "path"], "left_anti").select("review_id", "ordinal", "path", "symbol", "question")


def acquired_evidence(requests: DataFrame, indexed: DataFrame, changed: DataFrame) -> DataFrame:
    """review_id, path, symbols: at most four unchanged indexed files (review_id, path, ordinal, content) that hold a requested symbol as a whole word.

    A request with a path takes that file alone. Words meet by equality.
    """
    open_ = indexed.join(changed.select("review_id", "path"), ["review_id", "path"], "left_anti")
    words = open_.select("review_id", F.col("path").alias("file"), F.col("ordinal").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9_$?!]+"), F.lit(0)))).alias("word"))
    asked = requests.select("review_id", "path", "symbol", F.element_at(F.split("symbol", "[./]"), -1).alias("word"))
    met = words.join(asked, ["review_id", "word"]).where("path IS NULL OR path = file")
    held = met.groupBy("review_id", "file", "at").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))
    place = F.row_number().over(Window.partitionBy("review_id").orderBy("at", "file"))
    return held.withColumn("place", place).where(F.col("place") <= REQUEST_FILES).select("review_id", F.col("file").alias("path"), "symbols")


# ---- citations and suppression

def cited_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``findings`` (review_id, path, rule_path, rule_line, rule_quote, ...) with ``fault``: null, ``unsupported`` (no rule file above the path), or ``mismatch`` (the quote isn't that line).

    rules: review_id, path, content of the rule files. A finding without rule path has no fault.
    """
    place = F.regexp_replace(F.regexp_replace("rule_path", r"^/+|/{2,}", "/"), "/$", "")
    at_root = place.isin(RULE_FILES)
    folder = F.regexp_replace(place, "/[^/]*$", "")
    own = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    below = place.rlike("/(?:" + "|".join(re.escape(f) for f in RULE_FILES) + ")$") & ((own == folder) | own.startswith(F.concat(folder, F.lit("/"))))
    supported = (at_root | below) & (F.col("rule_line") >= 1) & (text.stripped(F.col("rule_quote")) != "")
    lines = rules.select("review_id", F.col("path").alias("rule_place"), F.posexplode(F.split("content", r"\r?\n", -1)).alias("at", "rule_text")).withColumn("rule_line", (F.col("at") + 1).cast("long"))
    held = findings.withColumns({"rule_place": place, "supported": F.coalesce(supported, F.lit(False)), "rule_line": F.col("rule_line").cast("long")})
    met = held.join(lines.drop("at"), ["review_id", "rule_place", "rule_line"], "left")
    same = F.coalesce((text.stripped(F.col("rule_text")) == text.stripped(F.col("rule_quote"))) & (text.stripped(F.col("rule_text")) != ""), F.lit(False))
    fault = F.when(F.col("rule_path").isNull(), None).when(~F.col("supported"), "unsupported").when(~same, "mismatch")
    return met.withColumn("fault", fault).drop("rule_place", "supported", "rule_text")


def not_yet_commented(findings: DataFrame, comments: DataFrame, marker: str = "root-cause") -> DataFrame:
    """Findings of causes that no comment (review_id, path, line, body) covers yet.

    A comment covers a cause if it holds its marker, or stands where a finding of the cause does and names its title. Markers and
    places meet by equality; only comments of the same place are searched for the title.
    """
    keyed = with_cause(findings)
    marks = comments.select("review_id", F.explode(F.regexp_extract_all("body", F.lit(marker + ":([a-f0-9]{16})"), F.lit(1))).alias("cause"))
    named = keyed.join(comments.select("review_id", "path", "line", "body"), ["review_id", "path", "line"]).where(F.contains("body", "title")).select("review_id", "cause")
    return keyed.join(marks.unionByName(named).distinct(), ["review_id", "cause"], "left_anti")


# ---- follow-ups and history

def reconciled(previous: DataFrame, current: DataFrame, decisions: DataFrame, delta: DataFrame, head: DataFrame) -> DataFrame:
    """decisions (review_id, id, status, finding_index, side, path, line) on previous findings, with ``error``: the first rule that one breaks, or null.

    previous and current: review_id, id, path, title, root_cause. delta: review_id, side (new: added, old: removed), path, line. head: review_id, path,
    line. ``remaining`` names a current finding of the same path with equal title or cause, once; the others name none and no such
    finding is left; ``resolved`` cites a line of the delta, the rest a line of the head.
    """
    c = F.col
    fault = ["path", "title", "root_cause"]
    rows = decisions.select("review_id", F.lit("decision").alias("kind"), c("id").alias("own"), c("finding_index").cast("long").alias("ref"), "status", "finding_index", "side", "path", "line")
    for more in (
        previous.select("review_id", F.lit("previous").alias("kind"), c("id").alias("own"), *fault), current.select("review_id", F.lit("current").alias("kind"), c("id").cast("long").alias("ref"), *fault),
        delta.select("review_id", F.lit("delta").alias("kind"), "side", "path", "line"), head.select("review_id", F.lit("head").alias("kind"), F.lit("new").alias("side"), "path", "line"),
    ):
        rows = rows.unionByName(more, allowMissingColumns=True)
    # all that follows is asked within a review: the rows are dealt out by it once, here, where reviews without a decision go, or lie so already
    of = lambda *keys: Window.partitionBy("review_id", *keys)
    is_, any_ = lambda *kinds: c("kind").isin(*kinds), lambda held, *keys: F.coalesce(F.max(held).over(of(*keys)), F.lit(False))
    rows = rows.where("review_id IS NOT NULL OR kind = 'decision'").withColumn("asked", any_(is_("decision"))).where("asked").drop("asked")
    rows = rows.withColumn("titled", any_(is_("current"), "path", "title") & c("path").isNotNull() & c("title").isNotNull()).withColumn("caused", any_(is_("current"), "path", "root_cause") & c("path").isNotNull() & (c("root_cause") != ""))
    rows = rows.withColumn("named", F.collect_list(F.when(is_("current"), F.struct(*fault))).over(of("ref"))).where(~is_("current"))
    stood = F.struct(*fault, (F.coalesce("titled", F.lit(False)) | F.coalesce("caused", F.lit(False))).alias("matched"))
    rows = rows.withColumns({"stood": F.collect_list(F.when(is_("previous"), stood)).over(of("own")), "copies": F.sum(is_("decision").cast("int")).over(of("own"))}).where(~is_("previous"))
    cite, known = ["side", "path", "line"], c("side").isNotNull() & c("path").isNotNull() & c("line").isNotNull()
    rows = rows.withColumns({"in_delta": F.when(any_(is_("delta"), *cite) & known, True), "in_head": F.when(any_(is_("head"), *cite) & known, True)}).where(is_("decision"))
    same = lambda p, q: (p["path"] == q["path"]) & ((p["title"] == q["title"]) | ((p["root_cause"] != "") & (p["root_cause"] == q["root_cause"])))
    there = c("review_id").isNotNull() & c("own").isNotNull()
    fits = there & c("ref").isNotNull() & F.exists("stood", lambda p: F.exists("named", lambda q: F.coalesce(same(p, q), F.lit(False))))
    uses = F.row_number().over(of("status", "finding_index").orderBy("own"))
    cited = rows.withColumns({"uses": uses, "fits": fits, "matched": there & F.exists("stood", lambda p: p["matched"])}).withColumnRenamed("own", "id")
    stays = c("status") == "remaining"
    error = (
        F.when(c("copies") > 1, "id").when(~c("status").isin("remaining", "resolved", "retracted"), "status").when(stays & c("finding_index").isNull(), "no finding")
        .when(stays & ~c("fits"), "no match").when(~stays & c("matched"), "match remains")
        .when((c("status") == "resolved") & c("in_delta").isNull(), "not in delta").when((c("status") != "resolved") & c("in_head").isNull(), "not in head")
        .when(stays & (c("uses") > 1), "finding used twice").when(~stays & c("finding_index").isNotNull(), "finding named")
    )
    return cited.select("review_id", "id", "status", "finding_index", error.alias("error"))


def kept_of_followup(current: DataFrame, judged: DataFrame, introduced: DataFrame) -> DataFrame:
    """Current findings (review_id, id, ...) that a faultless decision calls remaining, or that were introduced (review_id, id)."""
    remaining = judged.where("status = 'remaining' AND error IS NULL").select("review_id", F.col("finding_index").alias("id"))
    return current.join(remaining.unionByName(introduced.select("review_id", "id")).distinct(), ["review_id", "id"], "left_semi")


def history(touched: DataFrame, commits: DataFrame, pulls: DataFrame, findings: DataFrame) -> DataFrame:
    """review_id, path, pull, ordinal, title: findings that merged pulls left on the paths under review, bounded in the order of consumption.

    touched: review_id, place, path. commits: path, turn, sha. pulls: sha, turn, pull, repo, merged, with the review's own pull and repo in touched (own_pull, repo).
    findings: pull, ordinal, path, title of each pull's latest review. At most 8 paths, 3 commits of each, 12 different commits, 3 different
    pulls in the order in which they are met, and 8 findings a path and pull.
    """
    c, of = F.col, lambda *keys: Window.partitionBy("review_id", *keys)
    nth = lambda *order: F.dense_rank().over(of().orderBy(*order))
    # all is asked within a review, by windows: rows that lie by review already, as they do beside few commits and pulls, are not dealt out again
    first = touched.where((c("place") <= HISTORY_PATHS) & c("review_id").isNotNull())
    seen = first.join(commits.where(c("turn") <= PATH_COMMITS).select("path", c("turn").alias("commit_turn"), "sha"), "path")
    looked = seen.withColumn("at", F.min(F.struct("place", "commit_turn")).over(of("sha"))).withColumn("nth", nth("at", "sha")).where(c("nth") <= HISTORY_COMMITS)
    held = looked.select("review_id", "path", "own_pull", "repo", "sha", "nth").join(pulls.withColumnRenamed("turn", "pull_turn").withColumnRenamed("repo", "pull_repo"), "sha")
    held = held.where(c("merged") & (c("pull") != c("own_pull")) & (F.lower("pull_repo") == F.lower("repo"))).select("review_id", "path", "pull", "nth", "pull_turn")
    taken = held.withColumn("at", F.min(F.struct("nth", "pull_turn")).over(of("pull"))).withColumn("k", nth("at", "pull")).where(c("k") <= HISTORY_PULLS)
    pairs = taken.select("review_id", "path", "pull").distinct()
    # the first findings of a pull's path are the same for every review that comes to it
    k = F.row_number().over(Window.partitionBy("pull", "path").orderBy("ordinal"))
    said = findings.withColumn("k", k).where(c("k") <= HISTORY_FINDINGS).drop("k")
    return pairs.join(said, ["pull", "path"])


# ---- texts

def cell(value: Column) -> Column:
    """``value`` in one cell of a table."""
    return text.stripped(F.regexp_replace(F.replace(value, F.lit("|"), F.lit("\\|")), r"\n+", " "))


def review_bodies(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """review_id, body: the published text of each review (review_id, summary, verdict, model, skipped, number, since, head_sha).

    A verdict line with counts, a table of the findings by severity, path and line, the findings without a line in full, skipped files, a note on the
    review before (where ``since`` isn't null), and who made it.
    """
    c = F.col
    bold = F.concat(F.lit("- **["), "severity", F.lit("] "), cell(c("title")), F.lit("** ("), "path", F.lit(")\n\n"), "body")
    row = F.concat(F.lit("| "), "severity", F.lit(" | "), "path", F.lit(":"), c("line").cast("string"), F.lit(" | "), cell(c("title")), F.lit(" |"))
    order = F.struct(severity_rank(c("severity")).alias("s"), "path", "line", "ordinal")
    listed = lambda what, when: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct(order.alias("o"), what.alias("t"))))), lambda x: x["t"]), "\n")
    made = findings.groupBy("review_id").agg(*[F.count_if(c("severity") == s).alias(s) for s in SEVERITIES], F.count(F.lit(1)).alias("n"), listed(row, F.lit(True)).alias("rows"), listed(bold, c("line") == 0).alias("loose"))
    n = lambda name: F.coalesce(c(name), F.lit(0)).cast("string")
    follow = c("summary").startswith("Follow-up review ")
    head = F.concat(F.when(follow, "## Follow-up review").otherwise("## Review"), F.lit("\n\n"), text.stripped(c("summary")), F.lit("\n"))
    counts = F.concat(F.lit("**Verdict:** "), "verdict", F.lit(" · **Findings:** "), n("n"), F.lit(" ("), n("critical"), F.lit(" critical, "), n("warning"), F.lit(" warnings, "), n("nit"), F.lit(" nits)"))
    table = F.when(c("n") > 0, F.concat(F.lit("\n| Severity | File | Title |\n| --- | --- | --- |\n"), "rows"))
    loose = F.when(c("loose") != "", F.concat(F.lit("\n### Findings without an inline location\n"), "loose"))
    skipped = F.when(F.size("skipped") > 0, F.concat(F.lit("Skipped files (not reviewed): "), F.array_join("skipped", ", "), F.lit("\n")))
    since = F.concat(F.lit("<sub>Review "), c("number").cast("string"), F.lit(" of this pull request; "), c("since").cast("string"), F.when(c("since") == 1, " commit").otherwise(" commits"), F.lit(" since "), F.substr("head_sha", F.lit(1), F.lit(7)), F.lit(".</sub>\n"))
    body = F.concat_ws("\n", head, counts, table, loose, F.lit(""), skipped, since, F.concat(F.lit("<sub>Generated by "), "model", F.lit("</sub>")))
    return reviews.join(made, "review_id", "left").select("review_id", body.alias("body"))


def delta_text(compared: Column, head_sha: Column, hunks: Column) -> Column:
    """What is said of a file since the review before: that nothing could be compared, that the file is unchanged (no hunks), or its hunks."""
    short = F.substr(head_sha, F.lit(1), F.lit(7))
    return (
        F.when(~compared, F.concat(F.lit("Delta unavailable: "), short, F.lit(" could not be compared with the current head. Treat the previous findings as possibly stale.")))
        .when(hunks.isNull(), F.concat(F.lit("This file is unchanged since the previous review at "), short, F.lit(".")))
        .otherwise(F.concat(F.lit("Diff of this file from "), short, F.lit(" to the current head, with new-file line numbers:\n\n"), hunks))
    )


def section(title: str | Column, body: Column) -> Column:
    """A titled section; null for a null or blank body, so that it can be left out."""
    name = F.lit(title) if isinstance(title, str) else title
    return F.when(F.coalesce(body.rlike(r"\S"), F.lit(False)), F.concat(F.lit("## "), name, F.lit("\n\n"), text.stripped(body), F.lit("\n")))


def prompt(sections: list[tuple[str | Column, Column]], closing: str) -> Column:
    """The sections that have a body, in order, and a closing line."""
    return F.concat_ws("\n", *[section(title, body) for title, body in sections], F.lit(closing))


def stream_answers(streams: DataFrame) -> DataFrame:
    """stream_id, answer, frames, fault of event streams (stream_id, text): the deltas joined in order.

    Blank lines, comments and other fields are passed over; what follows ``[DONE]`` isn't read. fault: ``malformed`` if a frame isn't JSON,
    ``unfinished`` without ``[DONE]`` or a finish reason. An answer with a fault is null.
    """
    line = lambda raw: text.stripped(raw)
    data = F.filter(F.transform(F.split("text", "\n", -1), line), lambda t: t.startswith("data:"))
    held = streams.select("stream_id", F.transform(data, lambda t: line(F.substr(t, F.lit(6)))).alias("data"))
    held = held.withColumn("end", F.array_position("data", "[DONE]"))
    held = held.withColumn("read", F.when(F.col("end") > 0, F.slice("data", F.lit(1), F.col("end").cast("int") - 1)).otherwise(F.col("data")))
    bad = F.exists("read", lambda d: F.try_parse_json(d).isNull())
    closed = F.exists("read", lambda d: F.coalesce(F.get_json_object(d, "$.choices[0].finish_reason"), F.lit("")) != "")
    answer = F.array_join(F.transform("read", lambda d: F.coalesce(F.get_json_object(d, "$.choices[0].delta.content"), F.lit(""))), "")
    fault = F.when(bad, "malformed").when((F.col("end") == 0) & ~closed, "unfinished")
    return held.select("stream_id", F.when(fault.isNull(), answer).alias("answer"), F.size("read").cast("long").alias("frames"), fault.alias("fault"))


def embedding_batches(responses: DataFrame) -> DataFrame:
    """batch_id, position, embedding, fault of responses (batch_id, expected, json): vectors in the order of their index.

    fault: ``count`` if there aren't as many as expected, ``not numeric`` if a component is no number; such a batch is one row without a vector.
    """
    kind = "struct<data: array<struct<index: int, embedding: array<string>>>>"
    read = responses.select("batch_id", "expected", F.from_json("json", kind)["data"].alias("data"))
    numeric = lambda v: v.isNotNull() & F.forall(v, lambda x: F.coalesce(x.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.lit(False)))
    fault = F.when(F.coalesce(F.size("data"), F.lit(0)) != F.col("expected"), "count").when(~F.forall("data", lambda r: numeric(r["embedding"])), "not numeric")
    ordered = F.array_sort(F.transform("data", lambda r, i: F.struct(F.coalesce(r["index"], F.lit(0)).alias("index"), i.alias("i"), F.transform(r["embedding"], lambda x: x.cast("double")).alias("embedding"))))
    rows = read.select("batch_id", fault.alias("fault"), F.posexplode_outer(F.when(fault.isNull(), ordered)).alias("position", "r"))
    return rows.select("batch_id", F.col("position").cast("long").alias("position"), F.col("r.embedding").alias("embedding"), "fault")


# ---- formats

def usd(value: Column) -> Column:
    """Dollars with four decimals below one, else two; a cost below a hundredth of a cent is said to be that."""
    return F.when((value > 0) & (value < 0.0001), "<$0.0001").otherwise(F.concat(F.lit("$"), F.replace(F.when(value < 1, F.format_number(value, 4)).otherwise(F.format_number(value, 2)), F.lit(","), F.lit(""))))


def ago(at: Column, now: Column) -> Column:
    """How long before ``now``, in the largest whole unit; ``unknown`` for null."""
    return seconds_ago(F.round(now.cast("double") - at.cast("double")).cast("long"))


def seconds_ago(secs: Column) -> Column:
    """``secs`` whole seconds in the past, in the largest whole unit; ``unknown`` for null. Times too far back for a timestamp have an age all the same."""
    unit = lambda seconds, mark: F.concat(F.floor(secs / seconds).cast("string"), F.lit(f"{mark} ago"))
    day = 86_400
    return (
        F.when(secs.isNull(), "unknown").when(secs < 60, "just now").when(secs < 3_600, unit(60, "m")).when(secs < day, unit(3_600, "h"))
        .when(secs < 30 * day, unit(day, "d")).when(secs < 360 * day, unit(30 * day, "mo")).otherwise(unit(365 * day, "y"))
    )


def signed(body: Column, secret: bytes) -> Column:
    """``sha256=`` and the HMAC of ``body`` under ``secret``, by two built-in digests."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, digest), 256))


def verified_signature(body: Column, header: Column, secret: bytes) -> Column:
    """Whether ``header`` signs ``body``; false for null. Digests of both sides are compared, so that the comparison tells nothing of the signature."""
    return F.coalesce(F.sha2(header, 256) == F.sha2(signed(body, secret), 256), F.lit(False))
