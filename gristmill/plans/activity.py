"""Queries of reviews of pull requests, triggers, metrics and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import activity as ops
from gristmill.plans.registry import query
from gristmill.sources.tables import MESSAGES, REVIEWS, USAGE, over, table

KEYS = ["repo_id", "pr_number"]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REVIEWS.frame(spark, sf_dir)


@query("o120_latest_reviews", over("v_reviews", "SELECT repo_id, pr_number, max(review_id) AS review_id, arg_max(head_sha, review_id) AS head_sha FROM v_reviews WHERE status = 'done' GROUP BY 1, 2"))
def latest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest(reviews(spark, sf_dir).where("status = 'done'"), KEYS, F.col("review_id").desc()).select(*KEYS, "review_id", "head_sha")


@query("o121_first_pending", over("v_reviews", "SELECT repo_id, pr_number, min(review_id) AS review_id FROM v_reviews WHERE status = 'queued' GROUP BY 1, 2"))
def first_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest(reviews(spark, sf_dir).where("status = 'queued'"), KEYS, F.col("review_id").asc()).select(*KEYS, "review_id")


@query("o131_review_numbers", over("v_reviews", "SELECT review_id, row_number() OVER (PARTITION BY repo_id, pr_number ORDER BY review_id) AS number FROM v_reviews WHERE status = 'done'"))
def review_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(*KEYS).orderBy("review_id"))
    return reviews(spark, sf_dir).where("status = 'done'").select("review_id", number.cast("long").alias("number"))


@query("o143_review_page", over("v_reviews", "SELECT review_id, repo_id, status, (SELECT count(*) FROM v_reviews) AS total FROM v_reviews ORDER BY review_id DESC LIMIT 20 OFFSET 40"))
def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    return rows.orderBy(F.col("review_id").desc()).offset(40).limit(20).select("review_id", "repo_id", "status", rows.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total"))


@query("o094_review_counts", over("v_reviews", "SELECT repo_id, pr_number, count(*) AS n, count(*) FILTER (WHERE status = 'done') AS done FROM v_reviews GROUP BY 1, 2"))
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("done"))


@query("o054_open_reviews", over("v_reviews", "SELECT review_id FROM v_reviews WHERE status IN ('queued', 'running')"))
def open_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).where(F.col("status").isin(ops.PENDING)).select("review_id")


PULLS = "pulls AS (SELECT concat('repo', cast(c_custkey % 20 AS string)) AS repo_id, c_custkey % 50 AS pr_number, concat('sha', cast(max(c_custkey) % 7 AS string)) AS head_sha, max(c_custkey) % 5 = 0 AS draft FROM customer GROUP BY 1, 2)"
STATUSES = f"{PULLS}, j AS (SELECT repo_id, pr_number, max(CASE WHEN status IN ('queued', 'running') THEN review_id END) AS pending_job, arg_max(status, review_id) AS last_status FROM v_reviews WHERE status <> 'done' AND review_id % 9 = 0 GROUP BY 1, 2), h AS (SELECT repo_id, pr_number, head_sha, max(review_id) AS review_id FROM v_reviews WHERE status = 'done' GROUP BY 1, 2, 3), st AS (SELECT p.*, CASE WHEN pending_job IS NOT NULL THEN 'pending' WHEN h.review_id IS NOT NULL THEN 'reviewed' WHEN last_status = 'error' THEN 'error' ELSE 'none' END AS review_status FROM pulls p LEFT JOIN j ON j.repo_id = p.repo_id AND j.pr_number = p.pr_number LEFT JOIN h ON h.repo_id = p.repo_id AND h.pr_number = p.pr_number AND h.head_sha = p.head_sha)"
STATUSES = STATUSES.replace(" AND review_id % 9 = 0", "")


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    grouped = c.groupBy(F.concat(F.lit("repo"), (F.col("c_custkey") % 20).cast("string")).alias("repo_id"), (F.col("c_custkey") % 50).alias("pr_number")).agg(F.max("c_custkey").alias("m"))
    return grouped.select(*KEYS, F.concat(F.lit("sha"), (F.col("m") % 7).cast("string")).alias("head_sha"), (F.col("m") % 5 == 0).alias("draft"))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    jobs = rows.where("status <> 'done'").select(*KEYS, F.col("review_id").alias("job_id"), "status")
    return ops.pull_statuses(pulls(spark, sf_dir), jobs, rows.where("status = 'done'").select(*KEYS, "head_sha", "review_id"))


@query("o067_pull_statuses", over("v_reviews", f"WITH {STATUSES} SELECT repo_id, pr_number, review_status FROM st"))
def pull_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuses(spark, sf_dir).select(*KEYS, "review_status")


@query("o059_pull_selection", over("v_reviews", f"WITH {STATUSES} SELECT repo_id, pr_number, CASE WHEN review_status = 'pending' THEN 'already queued' WHEN draft THEN 'draft' WHEN review_status = 'reviewed' THEN 'already reviewed' ELSE 'review' END AS decision FROM st"))
def pull_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.selection(statuses(spark, sf_dir)).select(*KEYS, "decision")


@query("o068_unreviewed_pulls", over("v_reviews", f"WITH {PULLS} SELECT repo_id, pr_number FROM pulls p WHERE NOT draft AND NOT EXISTS (SELECT 1 FROM v_reviews r WHERE r.posted = 1 AND r.status = 'done' AND r.repo_id = p.repo_id AND r.pr_number = p.pr_number AND r.head_sha = p.head_sha)"))
def unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = reviews(spark, sf_dir).where("posted = 1 AND status = 'done'").select(*KEYS, "head_sha")
    return pulls(spark, sf_dir).where("NOT draft").join(posted, [*KEYS, "head_sha"], "left_anti").select(*KEYS)


HEADS = "r AS (SELECT repo_id, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE arg_max(head_sha, review_id) END AS last_commit, arg_min(status, review_id) AS status, concat('sha', cast(max(review_id) % 5 AS string)) AS head FROM v_reviews GROUP BY 1)"


@query("o069_moved_branches", over("v_reviews", f"WITH {HEADS} SELECT repo_id FROM r WHERE head IS DISTINCT FROM last_commit AND status NOT IN ('queued', 'indexing')"))
def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = reviews(spark, sf_dir).groupBy("repo_id").agg(
        F.when(F.count(F.lit(1)) % 3 == 0, None).otherwise(F.max_by("head_sha", "review_id")).alias("last_commit"), F.min_by("status", "review_id").alias("status"),
        F.concat(F.lit("sha"), (F.max("review_id") % 5).cast("string")).alias("head"),
    )
    return ops.moved_branches(grouped.select("repo_id", "last_commit", "status"), grouped.select("repo_id", "head")).select("repo_id")


@query("o259_superseded", over("v_reviews", f"WITH {PULLS} SELECT r.review_id FROM v_reviews r JOIN pulls p ON p.repo_id = r.repo_id AND p.pr_number = r.pr_number WHERE r.head_sha <> p.head_sha"))
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = pulls(spark, sf_dir).select(*KEYS, F.col("head_sha").alias("current"))
    return reviews(spark, sf_dir).join(now, KEYS).where("head_sha <> current").select("review_id")


@query("o250_debounce", "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id AS key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS fire_at, count(*) AS n FROM s GROUP BY user_id, run")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ops.debounced(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts"), "6 hours")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return runs.select("key", stamp("first_at"), stamp("fire_at"), "n")


@query("o252_delivery_dedup", "WITH RECURSIVE e AS (SELECT user_id AS key, cast(floor(epoch(ts)) AS bigint) AS t FROM events), r AS (SELECT key, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT r.key, min(e.t) AS t FROM r JOIN e ON e.key = r.key AND e.t > r.t + 3600 GROUP BY r.key, r.t) SELECT key, t AS at FROM r".replace("AS at FROM r", 'AS "at" FROM r'))
def delivery_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.unix_micros("ts") / 1_000_000)
    return ops.accepted_deliveries(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), at.alias("at")), 3600)


RATES = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS name, count(*) AS n, round(count(*) / 3600::double, 9) AS per_second, round(avg(value), 6) AS average FROM events GROUP BY 1, 2"


@query("o256_counter_rates", RATES)
def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ops.rates(table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("name"), "value"), "1 hour", 3600)
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "name", "n", F.round("per_second", 9).alias("per_second"), F.round("average", 6).alias("average"))


@query("o258_usage_series", over("v_usage", "SELECT id, kind, tokens FROM (UNPIVOT (SELECT id, input_tokens, cached_input_tokens, cache_write_tokens, output_tokens FROM v_usage) ON input_tokens, cached_input_tokens, cache_write_tokens, output_tokens INTO NAME kind VALUE tokens) WHERE tokens > 0"))
def usage_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.operators.usage import TOKENS

    return USAGE.frame(spark, sf_dir).select("id", *TOKENS).unpivot(["id"], TOKENS, "kind", "tokens").where("tokens > 0")


@query("o262_usage_journal", over("v_usage", "WITH k AS (SELECT output_tokens AS attempt, id // 20 AS seq, bool_or(id % 3 = 0) AS held FROM v_usage GROUP BY 1, 2) SELECT attempt, seq, CASE WHEN held THEN 'journal' ELSE 'new' END AS origin FROM k"))
def usage_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.operators.writes import insert_new

    rows = USAGE.frame(spark, sf_dir).select(F.col("output_tokens").alias("attempt"), F.floor(F.col("id") / 20).alias("seq"), "id")
    journal = rows.where("id % 3 = 0").select("attempt", "seq").distinct().withColumn("origin", F.lit("journal"))
    return insert_new(journal, rows.select("attempt", "seq", F.lit("new").alias("origin")), ["attempt", "seq"])


@query("o260_price_refresh", "SELECT event_id, CASE WHEN event_id % 30 < 24 THEN 'fresh' WHEN event_type = 'error' AND event_id % 10 < 5 THEN 'stale' ELSE 'refresh' END AS decision FROM events")
def price_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.operators.usage import price_decision

    now = F.lit("2024-01-02 03:04:05").cast("timestamp")
    fetched = now - F.make_dt_interval(hours=(F.col("event_id") % 30).cast("int"))
    failed = F.when(F.col("event_type") == "error", now - F.make_dt_interval(mins=(F.col("event_id") % 10).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", price_decision(fetched, failed, now).alias("decision"))


@query("o261_resume_stage", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'reconciliation' WHEN event_id % 3 = 0 THEN 'verification' WHEN event_id % 2 = 0 THEN 'discovery' END AS stage FROM events")
def resume_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, stages = F.col("event_id"), ["discovery", "verification", "reconciliation"]
    valid = F.array(*[F.struct(F.lit(s).alias("stage"), (i % n == 0).alias("valid")) for s, n in zip(stages, (2, 3, 5), strict=True)])
    checkpoints = table(spark, sf_dir, "events").select(i.alias("job_id"), F.explode(valid).alias("c")).select("job_id", "c.*")
    return ops.resume_stages(checkpoints, stages).withColumnRenamed("job_id", "event_id")


@query("o053_retryable", "SELECT event_id, event_id % 600 IN (408, 429) OR event_id % 600 >= 500 AS retryable FROM events")
def retryable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.operators.usage import retryable as may_retry

    return table(spark, sf_dir, "events").select("event_id", may_retry(F.col("event_id") % 600).alias("retryable"))


@query("o005_json_props", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("o236_valid_progress", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS bigint) BETWEEN 0 AND 90, false) AS valid FROM events")
def valid_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json("props", "k long")["k"].between(0, 90), F.lit(False)).alias("valid"))


@query("o050_webhook_outcomes", "WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'pull_request' WHEN 'view' THEN 'push' WHEN 'purchase' THEN 'issue_comment' ELSE 'ping' END AS event, user_id AS u, event_id AS i FROM events), r AS (SELECT event_id, CASE event WHEN 'pull_request' THEN CASE WHEN i % 4 = 0 THEN 'action' WHEN i % 5 = 0 THEN 'draft' WHEN u % 7 = 0 THEN 'not indexed' END WHEN 'push' THEN CASE WHEN u % 7 = 0 THEN 'not indexed' WHEN i % 11 = 0 THEN 'branch deleted' WHEN i % 2 = 0 THEN 'other branch' WHEN i % 3 = 0 THEN 'already indexed' WHEN i % 13 = 0 THEN 'index in progress' END WHEN 'issue_comment' THEN CASE WHEN i % 4 = 0 THEN 'action' WHEN i % 3 = 0 THEN 'not a pull request' WHEN i % 17 = 0 THEN 'bot' WHEN u % 2 = 0 THEN 'not a collaborator' WHEN i % 19 = 0 THEN 'own comment' WHEN i % 5 = 0 THEN 'not mentioned' WHEN u % 7 = 0 THEN 'not indexed' END ELSE 'event' END AS reason, event FROM e) SELECT event_id, CASE WHEN reason IS NOT NULL THEN 'ignored' WHEN event = 'pull_request' THEN 'review' WHEN event = 'push' THEN 'index' ELSE 'chat' END AS outcome, reason FROM r")
def webhook_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    kind = F.when(F.col("event_type") == "click", "pull_request").when(F.col("event_type") == "view", "push").when(F.col("event_type") == "purchase", "issue_comment").otherwise("ping")
    made = table(spark, sf_dir, "events").select(
        "event_id", kind.alias("event"), F.when(i % 4 == 0, "edited").when(kind == "issue_comment", "created").otherwise("opened").alias("action"), (i % 5 == 0).alias("draft"), (u % 7 != 0).alias("known"),
        F.when(u % 2 == 0, "NONE").otherwise("MEMBER").alias("association"), (i % 17 == 0).alias("is_bot"), (i % 19 == 0).alias("own_marker"), (i % 5 != 0).alias("mentioned"), (i % 3 != 0).alias("on_pull"),
        (i % 11 == 0).alias("deleted"), F.when(i % 2 == 0, "dev").otherwise("main").alias("branch"), F.lit("main").alias("tracked"), F.lit("a").alias("after"), F.when(i % 3 == 0, "a").otherwise("b").alias("last_commit"),
        F.when(i % 13 == 0, "indexing").otherwise("ready").alias("status"),
    )
    return ops.classified_events(made).select("event_id", "outcome", "reason")


@query("o207_transcripts", over("v_messages", "WITH g AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS answers, max(CASE WHEN role = 'user' THEN content END) AS lone, string_agg('### ' || CASE role WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE 'User' END || ':' || chr(10) || content, chr(10) || chr(10) ORDER BY turn, '### ' || CASE role WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE 'User' END || ':' || chr(10) || content) AS t FROM v_messages GROUP BY 1) SELECT conv_id, sha256(CASE WHEN users = 1 AND answers = 0 THEN lone ELSE t || chr(10) || chr(10) || '### Assistant:' END) AS digest FROM g"))
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.transcript(MESSAGES.frame(spark, sf_dir)).select("conv_id", F.sha2("prompt", 256).alias("digest"))


def _widened_sql() -> str:
    from gristmill.plans.retrieval import TOKENS

    cites = r"regexp_extract_all(answer, '[\w./-]+\.[A-Za-z0-9]+:\d+(?:-\d+)?')"
    names = f"regexp_extract_all(answer, '{text.IDENTIFIER}')"
    keywords = "(" + ", ".join(f"'{k}'" for k in text.KEYWORDS) + ")"
    return over("v_messages", f"""WITH m AS (SELECT conv_id, turn, role, content, coalesce(last_value(CASE WHEN role = 'assistant' THEN content END IGNORE NULLS) OVER w, '') AS answer, coalesce(last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER w, '') AS question
  FROM v_messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), a AS (SELECT * FROM m WHERE role = 'user'),
v_queries AS (SELECT {{'c': conv_id, 't': turn, 'q': 0}} AS query_id, content AS query FROM a UNION ALL SELECT {{'c': conv_id, 't': turn, 'q': 1}}, question FROM a), {TOKENS},
seen AS (SELECT query_id.c AS conv_id, query_id.t AS turn, lower(t) AS low FROM first WHERE query_id.q = 0),
i AS (SELECT conv_id, turn, unnest({names}) AS term, generate_subscripts({names}, 1) AS ip FROM a),
n AS (SELECT conv_id, turn, term, row_number() OVER (PARTITION BY conv_id, turn ORDER BY count(*) DESC, min(ip)) AS p FROM i WHERE length(term) >= 3 AND lower(term) NOT IN {keywords} GROUP BY 1, 2, 3 QUALIFY p <= 40),
c AS (SELECT conv_id, turn, 0 AS source, generate_subscripts({cites}, 1) AS p, split_part(unnest({cites}), ':', 1) AS term FROM a UNION ALL SELECT conv_id, turn, 1, p, term FROM n),
k AS (SELECT * FROM c WHERE term <> '' AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.conv_id = c.conv_id AND seen.turn = c.turn AND seen.low = lower(c.term)) QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(term) ORDER BY source, p) = 1),
told AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY source, p) <= 15),
q AS (SELECT query_id.c AS conv_id, query_id.t AS turn, 2 AS source, pos AS p, t AS term FROM first WHERE query_id.q = 1),
r AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.conv_id = q.conv_id AND seen.turn = q.turn AND seen.low = lower(q.term)) AND NOT EXISTS (SELECT 1 FROM told WHERE told.conv_id = q.conv_id AND told.turn = q.turn AND lower(told.term) = lower(q.term)) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY p) <= 10),
e AS (SELECT conv_id, turn, string_agg(term, ' ' ORDER BY source, p) AS extra FROM (SELECT * FROM told UNION ALL SELECT * FROM r) GROUP BY 1, 2)
SELECT a.conv_id, a.turn, CASE WHEN extra IS NULL THEN content ELSE content || ' ' || extra END AS query FROM a LEFT JOIN e ON e.conv_id = a.conv_id AND e.turn = a.turn""")


@query("o190_widened_questions", _widened_sql())
def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.widened_questions(MESSAGES.frame(spark, sf_dir))


@query("o191_citations", over("v_messages", "SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(content, '[\\w./-]+\\.[A-Za-z0-9]+:\\d+(?:-\\d+)?'), lambda c: split_part(c, ':', 1)), ' ') AS cited FROM v_messages"))
def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MESSAGES.frame(spark, sf_dir).select("conv_id", "turn", F.array_join(ops.citations(F.col("content")), " ").alias("cited"))


@query("o130_turns_since", over("v_messages", "SELECT conv_id, coalesce(max(turn) - max(CASE WHEN role = 'user' THEN turn END), 0) AS since FROM v_messages GROUP BY 1"))
def turns_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.since_last(MESSAGES.frame(spark, sf_dir), "conv_id", "turn", F.col("role") == "user")


@query("o010_reassembled_lines", "SELECT conv_id, cast(sum(len(list_filter(string_split(t, chr(10)), lambda l: trim(l) <> ''))) AS bigint) AS n_lines FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS t FROM conversations GROUP BY 1) GROUP BY 1")
def reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.operators.corpus import joined_text

    held = joined_text(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return held.select("conv_id", F.size(F.filter(text.lines(F.col("whole")), lambda line: F.trim(line) != "")).cast("long").alias("n_lines"))


@query("o204_repo_references", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN lower(regexp_extract(url, '^https?://([^/]+)/([^/?#]+)', 1)) || ':' || lower(regexp_extract(url, '^https?://([^/]+)/([^/?#]+)', 2)) END AS reference FROM pages")
def repo_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ops.repo_reference(F.col("url")).alias("reference"))


@query("o206_redacted_urls", "SELECT page_id, url AS redacted FROM pages")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.regexp_replace("url", "^(https?://)", "$1me:secret@")
    return table(spark, sf_dir, "pages").select("page_id", F.replace(ops.redacted(given), F.lit("***:***@"), F.lit("")).alias("redacted"))


@query("o251_scheduled_once", "WITH RECURSIVE e AS (SELECT event_type AS key, cast(floor(epoch(ts)) AS bigint) AS t FROM events), r AS (SELECT key, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT r.key, min(e.t) AS t FROM r JOIN e ON e.key = r.key AND e.t > r.t + 30 * 3600 GROUP BY r.key, r.t) SELECT key, t AS \"at\" FROM r")
def scheduled_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.unix_micros("ts") / 1_000_000)
    return ops.scheduled_once(table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), at.alias("at")), 30 * 3600)


@query("o030_histogram", "SELECT event_type AS name, CASE WHEN value <= 10 THEN 10.0::double WHEN value <= 50 THEN 50.0::double WHEN value <= 90.5 THEN 90.5::double END AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value")
    return ops.histogram(facts, [10, 50, 90.5]).withColumn("total", F.round("total", 4))
