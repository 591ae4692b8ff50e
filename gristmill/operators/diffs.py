"""Unified diffs as relations: files, hunks and lines by windows over the lines of each diff, and the risk of a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import once

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
# Signals of risk with their weights.
SIGNALS = [
    ("security", r"(?i)\b(auth|authenticat\w*|authoriz\w*|permissions?|sessions?|token|secret|password|credential|crypto|encrypt|decrypt|sql|xss|csrf|eval|exec)\b", 4),
    ("control-flow", r"(?i)\b(if|else|for|while|switch|case|return|throw|catch|finally|await|async|yield)\b|&&|\|\||\?\?", 2),
    ("contracts", r"(?i)\b(export|public|private|protected|interface|type|schema|route|endpoint|api)\b", 3),
    ("dependencies", r"(?i)(^|\s)(import|export)\b|\b(require|package|dependency|dependencies)\b", 2),
    ("data", r"(?i)\b(insert|update|delete|select|query|migration|migrate|cache|transaction|filesystem|database)\b", 2),
]


def assessed(text: Column) -> Column:
    """Struct of ``score`` and ``signals`` of ``text``: the weights and names of the signals in it; 1 and ``execution`` if it has none but isn't blank.

    Each pattern is tried once.
    """
    hits = F.array(*[text.rlike(p) for _, p, _ in SIGNALS])

    def of(met: Column) -> Column:
        total = F.aggregate(F.zip_with(met, F.array(*[F.lit(w) for *_, w in SIGNALS]), lambda hit, w: F.when(hit, w).otherwise(0)), F.lit(0), lambda a, x: a + x)
        names = F.array_compact(F.zip_with(met, F.array(*[F.lit(name) for name, *_ in SIGNALS]), lambda hit, name: F.when(hit, name)))
        none = F.when(text.rlike(r"\S"), F.struct(F.lit(1).alias("score"), F.array(F.lit("execution")).alias("signals"))).otherwise(F.struct(F.lit(0).alias("score"), F.array().cast("array<string>").alias("signals")))
        return F.when(F.exists(met, lambda hit: hit), F.struct(total.alias("score"), names.alias("signals"))).otherwise(none)

    return once(hits, of)


def signals(text: Column) -> Column:
    """Names of the signals in ``text``; ``execution`` if it has none but isn't blank."""
    return assessed(text)["signals"]


def risk(text: Column) -> Column:
    return assessed(text)["score"]


def stripped_path(raw: Column) -> Column:
    """Path of a header: without its side, unquoted, null for the null device."""
    bare = F.regexp_replace(raw, r"^\s+|\s+$", "")
    plain = F.when(bare.rlike('^".*"$'), F.from_json(F.concat(F.lit('{"p":'), bare, F.lit("}")), "p string")["p"]).otherwise(bare)
    return F.when(plain == "/dev/null", None).when(plain.rlike("^[ab]/"), F.substr(plain, F.lit(3))).otherwise(plain)


def _marked(diffs: DataFrame) -> DataFrame:
    """Every line of each diff with its file and hunk, both counted from 1, and whether it is part of the hunk's body."""
    rows = diffs.select("diff_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    w = Window.partitionBy("diff_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("line").startswith("diff --git ")
    headed = rows.withColumn("file", F.count_if(begins).over(w)).withColumn("has_git", F.max(begins).over(Window.partitionBy("diff_id")))
    # without such headers, a file begins with its old path, unless a hunk still takes lines; those diffs hold one file
    headed = headed.withColumn("file", F.when(F.col("has_git"), F.col("file")).otherwise((F.count_if(F.col("line").startswith("--- ")).over(w) > 0).cast("long"))).where("file > 0")
    is_hunk = F.col("line").rlike(HUNK)
    hunked = headed.withColumn("hunk", F.count_if(is_hunk).over(Window.partitionBy("diff_id", "file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    number = lambda k: F.nullif(F.regexp_extract("line", HUNK, k), F.lit("")).cast("int")
    g = Window.partitionBy("diff_id", "file", "hunk").orderBy("at")
    first = lambda c: F.first(c).over(g.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    for name, k, other in (("old_start", 1, 0), ("old_lines", 2, 1), ("new_start", 3, 0), ("new_lines", 4, 1)):
        hunked = hunked.withColumn(name, F.when(F.col("hunk") > 0, first(F.coalesce(number(k), F.lit(other)))))
    sign = F.when(F.col("line") == "", " ").otherwise(F.substr("line", F.lit(1), F.lit(1)))
    ahead = g.rowsBetween(Window.unboundedPreceding, -1)
    body = (F.col("hunk") > 0) & ~is_hunk
    old = F.coalesce(F.count_if(body & sign.isin(" ", "-")).over(ahead), F.lit(0))
    new = F.coalesce(F.count_if(body & sign.isin(" ", "+")).over(ahead), F.lit(0))
    taken = body & sign.isin(" ", "+", "-") & ((old < F.col("old_lines")) | (new < F.col("new_lines")))
    marked = hunked.withColumns({"sign": sign, "old_at": old, "new_at": new, "taken": taken, "is_hunk": is_hunk})
    ended = F.max(body & ~F.col("taken") & (F.col("sign") != "\\")).over(g.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("inside", F.col("taken") & ~F.coalesce(ended, F.lit(False)))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, file, hunk, at, type (add, del, ctx), old_line, new_line, content of every line of hunks in ``diffs`` (diff_id, text)."""
    c = F.col
    kind = F.when(c("sign") == "+", "add").when(c("sign") == "-", "del").otherwise("ctx")
    return _marked(diffs).where("inside").select(
        "diff_id", "file", "hunk", "at", kind.alias("type"),
        F.when(c("sign") != "+", c("old_start") + c("old_at")).alias("old_line"), F.when(c("sign") != "-", c("new_start") + c("new_at")).alias("new_line"), F.substr("line", F.lit(2)).alias("content"),
    )


def diff_files(diffs: DataFrame) -> DataFrame:
    """diff_id, file, old_path, new_path, status (modified, added, deleted, renamed), binary, n_hunks of every file."""
    rows = _marked(diffs).where("NOT inside")
    line = F.col("line")
    last = lambda prefix, value: F.max_by(value, F.when(line.startswith(prefix), F.col("at")))
    has = lambda *prefixes: F.bool_or(F.exists(F.array(*map(F.lit, prefixes)), lambda p: line.startswith(p)))
    after = lambda n: stripped_path(F.substr(line, F.lit(n + 1)))
    git = F.regexp_extract(line, r"^diff --git (.*) (b/.*)$", 1)
    made = rows.groupBy("diff_id", "file").agg(
        F.max(F.when(line.startswith("diff --git "), stripped_path(git))).alias("git_old"),
        F.max(F.when(line.startswith("diff --git "), stripped_path(F.regexp_extract(line, r"^diff --git (.*) (b/.*)$", 2)))).alias("git_new"),
        has("--- ").alias("has_old"), has("+++ ").alias("has_new"), last("--- ", after(4)).alias("old_side"), last("+++ ", after(4)).alias("new_side"),
        has("rename from ", "rename to ").alias("renamed"), last("rename from ", after(12)).alias("from_path"), last("rename to ", after(10)).alias("to_path"),
        has("new file mode").alias("made"), has("deleted file mode").alias("dropped"), has("Binary files ", "GIT binary patch").alias("binary"),
        F.max("hunk").alias("n_hunks"),
    )
    c = F.col
    status = (
        F.when(c("dropped"), "deleted").when(c("made"), "added").when(c("renamed"), "renamed")
        .when(c("has_new") & c("new_side").isNull(), "deleted").when(c("has_old") & c("old_side").isNull(), "added").otherwise("modified")
    )
    old = F.coalesce(c("from_path"), F.when(c("has_old"), c("old_side")).otherwise(c("git_old")))
    new = F.coalesce(c("to_path"), F.when(c("has_new"), c("new_side")).otherwise(c("git_new")))
    out = made.withColumn("status", status)
    return out.select("diff_id", "file", F.when(c("status") != "added", old).alias("old_path"), F.when(c("status") != "deleted", new).alias("new_path"), "status", "binary", "n_hunks")


def commentable(lines: DataFrame) -> DataFrame:
    """diff_id, file, added, commentable: ascending new-file lines that were added, and those with context."""
    new = F.col("new_line")
    return lines.groupBy("diff_id", "file").agg(F.sort_array(F.collect_set(F.when(F.col("type") == "add", new))).alias("added"), F.sort_array(F.collect_set(new)).alias("commentable"))


def hunk_risks(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """diff_id, file, hunk, score, signals, rank: hunks with a changed line, the riskiest of a file first, else in order."""
    changed = lines.where("type <> 'ctx'").groupBy("diff_id", "file", "hunk").agg(F.sort_array(F.collect_list(F.struct("at", "content"))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["content"]), "\n")
    whole = changed.join(paths.select("diff_id", "file", F.coalesce("new_path", "old_path", F.lit("")).alias("path")), ["diff_id", "file"])
    text = F.concat("path", F.lit("\n"), body)
    scored = whole.select("diff_id", "file", "hunk", assessed(text).alias("a")).select("diff_id", "file", "hunk", "a.score", "a.signals")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("diff_id", "file").orderBy(F.col("score").desc(), "hunk")))


def allowed_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """diff_id, file, lines, body_only: where a finding of a file may stand - its added lines, or the old lines of a file that is deleted or has none."""
    met = lines.groupBy("diff_id", "file").agg(F.sort_array(F.collect_set(F.when(F.col("type") == "add", F.col("new_line")))).alias("added"), F.sort_array(F.collect_set("old_line")).alias("old"))
    body_only = (F.col("status") == "deleted") | (F.size("added") == 0)
    held = files.select("diff_id", "file", "status").join(met, ["diff_id", "file"], "left")
    none = F.array().cast("array<int>")
    held = held.withColumns({"added": F.coalesce("added", none), "old": F.coalesce("old", none)})
    return held.select("diff_id", "file", F.when(body_only, F.col("old")).otherwise(F.col("added")).alias("lines"), body_only.alias("body_only"))


def numbered_hunks(diffs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """diff_id, file, text: the hunks of each file with line numbers, five wide: the new one, for a removed line the old one.

    Rows are taken up to the first that overflows ``max_chars``, and a marker says that it was cut. A row costs its length and one more.
    """
    c = F.col
    number = F.when(c("sign") == "-", c("old_start") + c("old_at")).otherwise(c("new_start") + c("new_at")).cast("string")
    sign = F.when(c("sign").isin("+", "-"), c("sign")).otherwise(" ")
    shown = F.when(c("is_hunk"), c("line")).otherwise(F.concat(F.lpad(number, F.greatest(F.length(number), F.lit(5)), F.lit(" ")), F.lit(" "), sign, F.lit(" "), F.substr("line", F.lit(2))))
    rows = _marked(diffs).where("inside OR is_hunk").select("diff_id", "file", "at", shown.alias("row"))
    w = Window.partitionBy("diff_id", "file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("used", F.sum(F.length("row") + 1).over(w)).withColumn("cut", c("used") > (max_chars or (1 << 60)))
    kept = F.filter(F.sort_array(F.collect_list(F.struct("at", "cut", "row"))), lambda r: ~r["cut"])
    text = F.array_join(F.concat(F.transform(kept, lambda r: r["row"]), F.when(F.bool_or("cut"), F.array(F.lit("... (truncated)"))).otherwise(F.array().cast("array<string>"))), "\n")
    return rows.groupBy("diff_id", "file").agg(text.alias("text"))
