"""Activity around repositories: latest rows per key, pull requests and their reviews, triggers, conversations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text

PENDING = ["queued", "running"]
CITATION = r"[\w./-]+\.[A-Za-z0-9]+:\d+(?:-\d+)?"
ANSWER_TERMS, QUESTION_TERMS, NAMED_TERMS = 15, 10, 40


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key that comes first in ``order``; give one without ties."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def pull_statuses(pulls: DataFrame, jobs: DataFrame, reviews: DataFrame) -> DataFrame:
    """``review_status`` of each pull (repo_id, pr_number, head_sha): a pending job, else a review of its head, else the error
    of its latest job, else none. jobs: repo_id, pr_number, job_id, status; reviews: repo_id, pr_number, head_sha, review_id."""
    key = ["repo_id", "pr_number"]
    job = jobs.groupBy(*key).agg(F.max(F.when(F.col("status").isin(PENDING), F.col("job_id"))).alias("pending_job"), F.max_by("status", "job_id").alias("last_status"))
    head = reviews.groupBy(*key, "head_sha").agg(F.max("review_id").alias("review_id"))
    met = pulls.join(job, key, "left").join(head, [*key, "head_sha"], "left")
    c = F.col
    status = F.when(c("pending_job").isNotNull(), "pending").when(c("review_id").isNotNull(), "reviewed").when(c("last_status") == "error", "error").otherwise("none")
    return met.withColumn("review_status", status)


def selection(statuses: DataFrame, *, force: bool = False, explicit: bool = False) -> DataFrame:
    """``decision`` for each pull (review_status, draft): review, or why it is skipped."""
    c, forced = F.col, F.lit(force)
    queued = (c("review_status") == "pending") & ~(forced & F.lit(explicit))
    return statuses.withColumn(
        "decision",
        F.when(queued, "already queued").when(c("draft") & ~F.lit(explicit), "draft").when((c("review_status") == "reviewed") & ~forced, "already reviewed").otherwise("review"),
    )


def moved_branches(repos: DataFrame, heads: DataFrame) -> DataFrame:
    """Repositories (repo_id, last_commit, status) whose head is another commit and that aren't being indexed; no last commit counts as moved."""
    met = repos.join(heads.select("repo_id", "head"), "repo_id")
    return met.where(F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("last_commit")) & ~F.col("status").isin("queued", "indexing"))


def debounced(triggers: DataFrame, delay: str, key: str = "key") -> DataFrame:
    """key, first_at, fire_at, n: one row for each run of triggers (key, ts) without a gap of ``delay``; it fires that long after
    the last. The same expression serves a stream with a watermark, which emits closed runs."""
    runs = triggers.groupBy(key, F.session_window("ts", delay).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return runs.select(key, F.col("w.start").alias("first_at"), F.col("w.end").alias("fire_at"), "n")


def rates(events: DataFrame, width: str, seconds: int) -> DataFrame:
    """window_start, name, n, per_second, average of events (ts, name, value) in tumbling windows."""
    w = events.groupBy(F.window("ts", width).alias("w"), "name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("average"))
    return w.select(F.col("w.start").alias("window_start"), "name", "n", (F.col("n") / F.lit(float(seconds))).alias("per_second"), "average")


#: Times to live that a part of a key's time line spans.
PART_LIVES = 256


def _bursts(deliveries: DataFrame, ttl_seconds: int) -> DataFrame:
    """``deliveries`` (key, at) with ``burst``: when the run of deliveries without a gap of more than the time to live began that each belongs to.

    Gaps are found within parts of a key's time line; only a row for each part meets its neighbours.
    """
    parted = deliveries.withColumn("part", F.floor(F.col("at") / F.lit(PART_LIVES * max(1, ttl_seconds))))
    ends = parted.groupBy("key", "part").agg(F.max("at").alias("end"))
    ends = ends.select(F.col("key").alias("__k"), F.col("part").alias("__p"), F.lag("end").over(Window.partitionBy("key").orderBy("part")).alias("carried"))
    alike = F.col("key").eqNullSafe(F.col("__k")) & (F.col("part") == F.col("__p"))
    inner = Window.partitionBy("key", "part").orderBy("at")
    met = parted.withColumn("before", F.lag("at").over(inner)).join(ends, alike).drop("__k", "__p")
    before = F.coalesce("before", "carried")
    begun = met.withColumn("begins", F.when(before.isNull() | (F.col("at") - before > ttl_seconds), F.col("at")))
    begun = begun.select("key", "part", "at", F.max("begins").over(inner.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("own"))
    lasts = begun.groupBy("key", "part").agg(F.max("own").alias("last"))
    open_ = F.max("last").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    lasts = lasts.select(F.col("key").alias("__k"), F.col("part").alias("__p"), open_.alias("open"))
    return begun.join(lasts, alike).select("key", "at", F.coalesce("own", "open").alias("burst"))


def accepted_deliveries(deliveries: DataFrame, ttl_seconds: int) -> DataFrame:
    """key, at of the deliveries (key, at in whole seconds) that aren't repeats within the time to live of the last accepted one.

    After a gap of more than the time to live a delivery is accepted whatever came before, so the bursts between gaps are dealt out, not whole
    keys. A pass over the sorted rows of a burst holds the last accepted time; a key whose deliveries never pause is one burst, and one task passes over it.
    """
    kind = deliveries.schema["key"].dataType.simpleString()
    rows = deliveries.where("at IS NOT NULL").select("key", F.col("at").cast("long").alias("at"))
    dealt = _bursts(rows, ttl_seconds).select("key", "at", "burst").repartition("key", "burst").sortWithinPartitions("key", "burst", "at")

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, of, last = False, None, 0
        for batch in batches:
            kept = []
            for key, at, burst in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                kept.append(not begun or (key, burst) != of or at - last > ttl_seconds)
                if kept[-1]:
                    begun, of, last = True, (key, burst), at
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return dealt.mapInArrow(accept, f"key {kind}, at long")


class Remembered:
    """Keys accepted within a time to live, at most ``capacity`` of them: the one accepted longest ago makes way."""

    def __init__(self, ttl: int, capacity: int, held: list[tuple] = ()):
        self.ttl, self.capacity, self.held = ttl, capacity, dict(held)

    def accepts(self, key, at: int) -> bool:
        """Whether a delivery is new; accepted ones are remembered, in their order."""
        while self.held and at - next(iter(self.held.values())) > self.ttl:
            del self.held[next(iter(self.held))]
        if key in self.held:
            return False
        if len(self.held) >= self.capacity:
            del self.held[next(iter(self.held))]
        self.held[key] = at
        return True


def remembered_deliveries(deliveries: DataFrame, ttl_seconds: int = 3600, capacity: int = 1_000) -> DataFrame:
    """scope, key, at of the deliveries (scope, key, at in whole seconds) that their scope doesn't remember.

    A scope remembers the keys it accepted in the ``ttl_seconds`` before, and no more than ``capacity``: the oldest makes way, so that a repeat
    of it is taken again. Order: time, then key; rows without key or time go. What a scope forgets depends on all its deliveries, so
    those are one pass of a task over sorted rows, which holds ``capacity`` keys; scopes are dealt out. A stream of the same:
    :func:`gristmill.streaming.deliveries.dedupe_remembered`.
    """
    rows = deliveries.where("key IS NOT NULL AND at IS NOT NULL").select("scope", "key", F.col("at").cast("long").alias("at"))
    kinds = rows.schema.simpleString()[7:-1].replace(":", " ")

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, memory = None, None
        for batch in batches:
            kept = []
            for scope, key, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if memory is None or scope != of:
                    of, memory = scope, Remembered(ttl_seconds, capacity)
                kept.append(memory.accepts(key, at))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return rows.repartition("scope").sortWithinPartitions("scope", "at", "key").mapInArrow(pass_over, kinds)


def polled(polls: DataFrame, repos: DataFrame, reviews: DataFrame) -> DataFrame:
    """repo_id, outcome, pr_number, detail of one round of ``polls`` (repo_id, head, pulls, fault): ``index`` for a moved head, ``review`` for each pull without a posted
    review of its head, ``fault`` where a repository couldn't be asked.

    repos: repo_id, last_commit, status. reviews: repo_id, pr_number, head_sha (posted ones). ``pulls`` is JSON text, a list of objects with number, head_sha and draft. A fault,
    or pulls that can't be read, stay with their repository: the others go on. Heads of repositories that are being indexed wait; drafts and
    pulls without a head are left.
    """
    c, shape = F.col, "array<struct<number: bigint, head_sha: string, draft: boolean>>"
    known = polls.join(repos.select("repo_id", "last_commit", "status"), "repo_id").withColumn("listed", F.from_json("pulls", shape, {"mode": "PERMISSIVE"}))
    fault = F.coalesce(c("fault"), F.when(c("pulls").isNotNull() & (F.try_parse_json("pulls").isNull() | ~F.coalesce(F.schema_of_variant(F.try_parse_json("pulls")).startswith("ARRAY"), F.lit(False))), F.lit("pulls can't be read")))
    known = known.withColumn("wrong", fault)
    right = known.where("wrong IS NULL")
    row = lambda rows, outcome, number, detail: rows.select("repo_id", F.lit(outcome).alias("outcome"), number.cast("long").alias("pr_number"), detail.alias("detail"))
    pulls = right.select("repo_id", F.explode("listed").alias("p")).where(~F.coalesce(c("p.draft"), F.lit(False)) & (F.coalesce(c("p.head_sha"), F.lit("")) != "")).select("repo_id", c("p.number").alias("pr_number"), c("p.head_sha").alias("head_sha"))
    open_ = pulls.join(reviews.select("repo_id", "pr_number", "head_sha"), ["repo_id", "pr_number", "head_sha"], "left_anti")
    return (
        row(moved_branches(right.select("repo_id", "last_commit", "status"), right.select("repo_id", F.nullif("head", F.lit("")).alias("head"))), "index", F.lit(None), c("head"))
        .unionByName(row(open_, "review", c("pr_number"), c("head_sha")))
        .unionByName(row(known.where("wrong IS NOT NULL"), "fault", F.lit(None), c("wrong")))
    )


def transcript(messages: DataFrame) -> DataFrame:
    """conv_id, prompt: a lone user turn as it is; anything else with a label for each turn and a cue at the end."""
    label = F.when(F.col("role") == "assistant", "Assistant").when(F.col("role") == "system", "System").otherwise("User")
    turn = F.concat(F.lit("### "), label, F.lit(":\n"), "content")
    user = F.col("role") == "user"
    held = messages.groupBy("conv_id").agg(
        F.count_if(user).alias("users"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max(F.when(user, F.col("content"))).alias("lone"),
        F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts"),
    )
    whole = F.concat(F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n"), F.lit("\n\n### Assistant:"))
    return held.select("conv_id", F.when((F.col("users") == 1) & (F.col("answers") == 0), F.col("lone")).otherwise(whole).alias("prompt"))


def citations(body: Column) -> Column:
    """Paths that a text cites as ``path.ext:line``, in order, repeats included."""
    return F.transform(F.regexp_extract_all(body, F.lit(CITATION), F.lit(0)), lambda c: F.element_at(F.split(c, ":"), 1))


def _fresh(terms: DataFrame, key: list[str], seen: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` of ``terms`` (key, source, place, term) of each key that aren't among its ``seen`` (key, low), whatever their case; equal ones once."""
    low = terms.where("term <> ''").withColumn("low", F.lower("term"))
    once = low.groupBy(*key, "low").agg(F.min(F.struct("source", "place", "term")).alias("t")).join(seen, [*key, "low"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("t.source", "t.place"))
    return once.withColumn("__n", place).where(F.col("__n") <= budget).select(*key, "low", "t.source", "t.place", "t.term")


def widened_questions(messages: DataFrame) -> DataFrame:
    """conv_id, turn, query of every user turn: the question, widened by what the answer and question before it name.

    Names of an answer are counted and ranked as rows: citations first, then identifiers by how often they occur, then tokens of the question before.
    """
    w, key = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1), ["conv_id", "turn"]
    before = lambda role: F.coalesce(F.last(F.when(F.col("role") == role, F.col("content")), ignorenulls=True).over(w), F.lit(""))
    asked = messages.withColumn("answer", before("assistant")).withColumn("question", before("user")).where("role = 'user'").select(*key, "content", "answer", "question")
    listed = lambda terms, source: asked.select(*key, F.lit(source).alias("source"), F.posexplode(terms).alias("place", "term"))
    seen = asked.select(*key, F.explode(text.query_tokens(F.col("content"))).alias("low")).select(*key, F.lower("low").alias("low")).distinct()
    named = listed(text.identifiers(F.col("answer")), 1).groupBy(*key, "source", "term").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    named = named.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "first"))).where(F.col("place") <= NAMED_TERMS).select(*key, "source", "place", "term")
    told = _fresh(listed(citations(F.col("answer")), 0).unionByName(named), key, seen, ANSWER_TERMS)
    more = _fresh(listed(text.query_tokens(F.col("question")), 2), key, seen.unionByName(told.select(*key, "low")), QUESTION_TERMS)
    extra = told.unionByName(more).groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "place", "term"))), lambda t: t["term"]), " ").alias("extra"))
    return asked.join(extra, key, "left").select(*key, F.when(F.col("extra").isNotNull(), F.concat("content", F.lit(" "), "extra")).otherwise(F.col("content")).alias("query"))


def classified_events(events: DataFrame) -> DataFrame:
    """``action`` and ``reason`` of webhook events; the order of the checks fixes the reason.

    events: event, action, draft, known (the repository is indexed), association, is_bot, own_marker, mentioned, on_pull,
    deleted, branch, tracked, after, last_commit, status.
    """
    c = F.col

    def ignore(*checks: tuple[Column, str], otherwise: str) -> Column:
        reason = F.coalesce(*[F.when(test, why) for test, why in checks])
        return F.struct(F.when(reason.isNull(), otherwise).otherwise("ignored").alias("action"), reason.alias("reason"))

    unknown = (~c("known"), "not indexed")
    pull = ignore((~c("action").isin("opened", "synchronize", "reopened", "ready_for_review"), "action"), (c("draft"), "draft"), unknown, otherwise="review")
    push = ignore(unknown, (c("deleted"), "branch deleted"), (c("branch") != c("tracked"), "other branch"), (c("after") == c("last_commit"), "already indexed"), (c("status").isin("queued", "indexing"), "index in progress"), otherwise="index")
    comment = ignore((c("action") != "created", "action"), (~c("on_pull"), "not a pull request"), (c("is_bot"), "bot"), (~c("association").isin("OWNER", "MEMBER", "COLLABORATOR"), "not a collaborator"), (c("own_marker"), "own comment"), (~c("mentioned"), "not mentioned"), unknown, otherwise="chat")
    other = F.struct(F.lit("ignored").alias("action"), F.lit("event").alias("reason"))
    told = F.when(c("event") == "pull_request", pull).when(c("event") == "push", push).when(c("event") == "issue_comment", comment).otherwise(other)
    return events.withColumn("told", told).withColumn("outcome", F.col("told.action")).withColumn("reason", F.col("told.reason")).drop("told")


def resume_stages(checkpoints: DataFrame, stages: list[str]) -> DataFrame:
    """job_id, stage: the last of ``stages`` of which a job has a valid checkpoint (job_id, stage, valid); null where it must begin anew."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    last = checkpoints.groupBy("job_id").agg(F.max(F.when(F.col("valid") & (place > 0), place)).alias("at"))
    return last.select("job_id", F.when(F.col("at").isNotNull(), F.element_at(F.array(*map(F.lit, stages)), F.col("at").cast("int"))).alias("stage"))


def scheduled_once(triggers: DataFrame, delay_seconds: int) -> DataFrame:
    """key, at of triggers (key, at in seconds) that start a timer; those that come while one of their key runs don't restart it."""
    return accepted_deliveries(triggers, delay_seconds)


def repo_reference(url: Column) -> Column:
    """``owner:name`` in lower case of a web address; null for others."""
    part = lambda k: F.lower(F.regexp_extract(url, r"^https?://([^/]+)/([^/?#]+)", k))
    return F.when(url.rlike("^https?://"), F.concat(part(1), F.lit(":"), part(2)))


# The spellings of a remote that are understood - with or without a scheme and user, a slash or a colon before the owner - and the shorthand.
REMOTE = r"^(?:(?:https?|ssh|git)://)?(?:[^@/\s]+@)?github\.com[/:]([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+?)(?:\.git)?$"
SHORTHAND = r"^([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+?)(?:\.git)?$"
LOCAL = r"^(?:/|\.\.?/|~/)"


def remote(spelled: Column) -> Column:
    """Struct of ``reference``, ``url`` and ``fault`` of a remote's spelling: https, ssh, git or scp form, shorthand, or a local path.

    Blanks and slashes at the end go, owner and name are in lower case. A local path is ``local:name``; whether it holds a repository is for the
    caller to see. Anything else, an owner or name of one dot, and null have a fault and no reference.
    """
    said = F.regexp_replace(text.stripped(F.coalesce(spelled, F.lit(""))), "/+$", "")

    def told(s: Column) -> Column:
        part = lambda k: F.lower(F.coalesce(F.nullif(F.regexp_extract(s, REMOTE, k), F.lit("")), F.regexp_extract(s, SHORTHAND, k)))
        local = s.rlike(LOCAL)
        name = F.lower(F.regexp_replace(F.regexp_extract(s, r"([^/]+)$", 1), r"\.git$", ""))
        whole = ~local & (part(1) != "") & (part(2) != "") & (part(1) != ".") & (part(2) != ".")
        return F.struct(
            F.when(local & (name != ""), F.concat(F.lit("local:"), name)).when(whole, F.concat(F.lit("github:"), part(1), F.lit("/"), part(2))).alias("reference"),
            F.when(local & (name != ""), s).when(whole, F.concat(F.lit("https://github.com/"), part(1), F.lit("/"), part(2), F.lit(".git"))).alias("url"),
            F.when(~(local & (name != "")) & ~whole, F.concat(F.lit("Unsupported remote: "), F.coalesce(spelled, F.lit("")))).alias("fault"),
        )

    return text.once(said, told)


def redacted(text: Column) -> Column:
    """``text`` without the user and password of the addresses in it."""
    return F.regexp_replace(text, r"(https?://)[^@\s/]+:[^@\s/]+@", "$1***:***@")


def since_last(rows: DataFrame, key: str, order: str, matching: Column) -> DataFrame:
    """``key`` and ``since``: how far ``order`` went on after the last row that matches; 0 if none does."""
    return rows.groupBy(key).agg(F.coalesce(F.max(order) - F.max(F.when(matching, F.col(order))), F.lit(0).cast("long")).alias("since"))


def histogram(facts: DataFrame, bounds: list[float]) -> DataFrame:
    """name, bucket, n, total of facts (name, value): how many values lie in each bucket, the least of ``bounds`` that is no less than the value, null beyond the last."""
    bucket = F.coalesce(*[F.when(F.col("value") <= b, F.lit(float(b))) for b in sorted(bounds)])
    return facts.where("value IS NOT NULL").groupBy("name", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
