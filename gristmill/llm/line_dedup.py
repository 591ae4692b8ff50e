"""Near-duplicate lines across all documents by an exact set-similarity join, built-in Spark expressions only.

A line's tokens are its distinct runs of five words (hashed to 64 bits); a line of fewer words is one token, so that its
copies go too. Tokens stand in a global order of rarity: those outside a bounded table of common ones first, by hash, then the common ones by how often they were met. Two lines with Jaccard >= 0.8
share a token among the first few of each (prefix filter), are of similar size (length filter), and have enough tokens left after
the first one they share (positional filter). Pairs that share too few tokens of their prefixes go; the rest is verified on
the full sets. A line goes if an earlier line - by document id, then line number - is that similar, kept or not.

Lines with equal token sets are one class, so copies are never paired. Classes first meet two lines of each token's group, the
earliest and the one with most copies; only those that find no match there go on to meet all earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._shared import Scratch, free_name, let
from gristmill.llm.quality import words_of

#: Bits of the flag tables that thin out rows before a shuffle; broadcast, at most FLAGS / 64 rows of two longs.
FLAGS = 1 << 26
#: Rows of the table of common tokens, at most, and the count from which a token can be common.
COMMON, COMMON_COUNT = 50_000, 64
FIRST_ID = -(1 << 63)
#: What a line of few words must hold to count: a letter or digit. Bare marks (a brace, a rule of dashes) belong to the form of a text.
SAYS = r"[\p{L}\p{N}]"
LINE = ["doc_id", "line", "h1"]


def tokens_of(line: Column, span: int) -> Column:
    """Sorted distinct hashes of the runs of ``span`` words in ``line``.

    A line of fewer words has its whole word sequence as its one token if it holds a letter or digit. Lines of bare marks
    and blank ones have none.
    """

    def runs(words: Column) -> Column:
        last = F.size(words) - span
        each = lambda hashes: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(span)]))
        made = let(F.transform(words, lambda w: F.xxhash64(w)), each)
        whole = F.when((F.size(words) > 0) & line.rlike(SAYS), F.array(F.xxhash64(words)))
        return F.when(last >= 0, F.sort_array(F.array_distinct(made))).otherwise(F.coalesce(whole, F.array().cast("array<bigint>")))

    return let(words_of(line), runs)


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``line`` (from 0) and ``body`` of every line; ids that are null stand before all others."""
    body = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc_id"), F.posexplode(body).alias("line", "body"))


def flags(rows: DataFrame, *columns: str) -> DataFrame:
    """A bit for the hash of each row's ``columns``: (word, bits), at most ``FLAGS`` / 64 rows whatever the input."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(FLAGS))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(64)).cast("int"))
    return rows.select(F.shiftright(bit, 6).alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits"))


def with_flag(rows: DataFrame, table: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``rows`` and a boolean ``name``: whether its bit is set in ``table`` - true for all that were flagged, and a few others."""
    bit, at, bits = (free_name([*rows.columns, name], n) for n in ("bit", "at_word", "flag_bits"))
    probe = rows.withColumn(bit, F.pmod(F.xxhash64(*columns), F.lit(FLAGS))).withColumn(at, F.shiftright(bit, 6))
    met = probe.join(F.broadcast(table.select(F.col("word").alias(at), F.col("bits").alias(bits))), at, "left")
    known = F.coalesce(F.call_function("getbit", F.col(bits), F.pmod(bit, F.lit(64)).cast("int")) == 1, F.lit(False))
    return met.select(*rows.columns, known.alias(name))


def flagged(rows: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``rows`` whose bit is set in ``table``."""
    return with_flag(rows, table, list(columns), "flag_met").where("flag_met").drop("flag_met")


def _commonest(counts: DataFrame) -> DataFrame | None:
    """The rows of ``counts`` (token, met) that were met most, about ``COMMON`` at most; null if none was met ``COMMON_COUNT`` times.

    Whole levels of commonness as far as they fit, and of the next one the share that still does, by a hash of the token.
    """
    level, often = F.floor(F.log2("met") * 8), counts.where(F.col("met") >= COMMON_COUNT)
    sizes = sorted(((r["level"], r["n"]) for r in often.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    room = COMMON
    for at, size in sizes:
        if size >= room:
            return often.where((level > at) | ((level == at) & (F.pmod(F.xxhash64("token"), F.lit(1 << 30)) < (room << 30) // size)))
        room -= size
    return often if sizes else None


def _needed(nx: Column, ny: Column, percent: int) -> Column:
    """Least overlap of sets of these sizes with Jaccard >= percent / 100."""
    return F.ceil((nx + ny) * percent / (100 + percent) - 1e-9)


def _prefix(n: Column, percent: int) -> Column:
    return (n - F.ceil(n * percent / 100 - 1e-9) + 1).cast("int")


def line_decisions(docs: DataFrame, *, span: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``line``, and ``gone``: whether an earlier line is at least ``percent`` % similar to it.

    A line of fewer than ``span`` words is compared as a whole; blank lines and lines of bare marks stay (:func:`tokens_of`). Of
    equal lines the first stays. Texts and lines of any length are taken whole. Null and empty texts are one blank line. Rows of one doc_id with equal texts count as one document; null ids come out as null and stand before all others. Other
    columns of ``docs`` aren't read; an empty table gives an empty result.
    """
    lines, marked = _judged(docs, span, percent)
    met = lines.select("doc_id", "line", "h1", "h2", "n").hint("merge").join(marked, ["h1", "h2"], "left")
    return met.select(F.when(F.col("doc_id") != FIRST_ID, F.col("doc_id")).alias("doc_id"), "line", F.coalesce(_goes(), F.lit(False)).alias("gone"))


def gone_lines(docs: DataFrame, *, span: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id`` and ``line`` of the lines that :func:`line_decisions` calls gone, once each; null ids as ``FIRST_ID``."""
    return _gone_of(*_judged(docs, span, percent))


def _goes() -> Column:
    """Whether a line with its class's ``first`` line and verdict ``gone`` goes."""
    return (F.col("n") > 0) & F.col("first").isNotNull() & (F.col("gone") | (F.struct("doc_id", "line") != F.col("first")))


def _gone_of(lines: DataFrame, marked: DataFrame) -> DataFrame:
    """Only lines of flagged classes are dealt out by their class."""
    some = flagged(lines.select("doc_id", "line", "h1", "h2", "n").where("n > 0"), flags(marked, "h1", "h2"), "h1", "h2")
    return some.hint("merge").join(marked, ["h1", "h2"]).where(_goes()).select("doc_id", "line").distinct()


def _judged(docs: DataFrame, span: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, line, n, h1, h2), and of the classes with copies or an earlier similar line: h1, h2, their first line, gone."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    staged = scratch.put
    source = docs.select("doc_id", "text")
    token = lambda k: F.hash(k)  # noqa: E731  32 bits are enough to meet on; verification uses the full hashes
    whole = lines_of(source).withColumn("keys", tokens_of(F.col("body"), span)).drop("body").withColumn("n", F.size("keys"))
    lines = staged(
        whole.select(
            "doc_id", "line", "n", F.xxhash64("keys").alias("h1"), F.hash("keys").alias("h2"),
            F.transform(F.slice("keys", F.lit(1), F.greatest(_prefix(F.col("n"), percent), F.lit(1))), token).alias("prefix"),
        ),
        "line-sets",
    )
    first = F.min(F.struct("doc_id", "line"))
    classes = lines.where("n > 0").groupBy("h1", "h2").agg(first.alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("copies"))
    classes = staged(classes.select("h1", "h2", F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line"), "n", "prefix", "copies"), "line-classes")

    # tokens that several classes have in their prefixes, and the common ones among them; sets so small that only equal ones are similar need none
    classes_met = classes.where(F.col("n") * 100 >= (F.col("n") + 1) * percent)
    counts = staged(classes_met.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "line-tokens")
    common = _commonest(counts)

    tokens = classes_met.select(*LINE, "n", "copies", F.posexplode("prefix").alias("at", "token"))
    wanted = counts.select("token")
    if common is not None:
        # classes with a common token in the prefix: their prefixes in the order of rarity
        holding = lambda table: tokens.join(F.broadcast(table.select("token")), "token", "left_semi").select(*LINE, "copies").distinct()
        again = staged(holding(common), "line-again")
        sets = staged(_sets(source, again, span).select(*LINE, "copies", "keys"), "line-full")
        # prefixes hide most tokens of a passage that many lines share: the whole sets show how common those are
        held = sets.select(F.explode(F.transform("keys", token)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("met"))
        often = F.col("met") >= COMMON_COUNT
        known = staged(counts.where(often).unionByName(held.where(often)).groupBy("token").agg(F.max("met").alias("met")), "line-often")
        common = staged(_commonest(known), "line-common")
        more = staged(holding(common).join(again, LINE, "left_anti"), "line-more")
        sets, again = sets.unionByName(_sets(source, more, span).select(*LINE, "copies", "keys")), again.unionByName(more)
        # sets are dealt out as arrays, so that their tokens are ordered where they are, without a shuffle of single tokens
        full = sets.repartition(*LINE).select(*LINE, "copies", F.size("keys").alias("n"), F.explode("keys").alias("key")).withColumn("token", token(F.col("key")))
        ranked = full.join(F.broadcast(common), "token", "left").groupBy(*LINE, "n", "copies").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("met", F.lit(0)).alias("met"), "key", "token"))).alias("ordered"))
        renewed = ranked.select(*LINE, "n", "copies", F.posexplode(F.transform(F.slice("ordered", F.lit(1), _prefix(F.col("n"), percent)), lambda t: t["token"])).alias("at", "token"))
        renewed = staged(renewed, "line-renewed")
        wanted = wanted.unionByName(renewed.select("token"))  # others may share a token with these alone
        entries = flagged(tokens, flags(wanted, "token"), "token").hint("merge").join(again, LINE, "left_anti").unionByName(renewed)
    else:
        entries = flagged(tokens, flags(wanted, "token"), "token")
    entries = staged(entries, "line-entries")
    scratch.drop("line-tokens", "line-again", "line-full", "line-often", "line-common", "line-more", "line-renewed")

    c = F.col
    one = F.struct(*LINE, "n", "at", "before")
    # before: how many tokens that others share stand before this one in the same line
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("token")
    met = entries.hint("merge").join(shared, "token").withColumn("before", F.row_number().over(Window.partitionBy(*LINE).orderBy("at")) - 1)
    met = staged(met, "line-met")
    scratch.drop("line-entries")
    # the lines that lead a token's group: the earliest, and the one with most copies, the likely source of the others
    leads = met.groupBy("token").agg(F.array_distinct(F.array(F.min(one), F.max_by(one, F.struct("copies", F.bitwise_not("doc_id"))))).alias("leads"))
    leads = leads.select("token", F.explode("leads").alias("lead")).select("token", *[c(f"lead.{k}").alias(f"{k}_x") for k in (*LINE, "n", "at", "before")])

    def pairs_of(mine: DataFrame, earlier: DataFrame) -> DataFrame:
        """Lines of ``mine`` with those of ``earlier`` (named _x) that length and position allow."""
        ahead = F.least("before", "before_x") + F.least(c("n") - c("at"), c("n_x") - c("at_x"))
        fits = (F.least("n", "n_x") * 100 >= F.greatest("n", "n_x") * percent) & (ahead >= _needed(c("n"), c("n_x"), percent))
        return mine.hint("merge").join(earlier, "token").where((F.struct("doc_id_x", "line_x") < F.struct("doc_id", "line")) & fits)

    both = [*LINE, *[f"{k}_x" for k in LINE]]
    rest = lambda n: F.ceil(n * percent / 100) - 1  # noqa: E731  tokens beyond the prefix

    def can_be(shared: Column) -> Column:
        """Whether lines that share so many tokens of their prefixes can be similar."""
        return shared + F.greatest(rest(c("n")), rest(c("n_x"))) >= _needed(c("n"), c("n_x"), percent)

    def enough(pairs: DataFrame) -> DataFrame:
        counted = pairs.groupBy(*both).agg(F.first("n").alias("n"), F.first("n_x").alias("n_x"), F.count(F.lit(1)).alias("shared"))
        return counted.where(can_be(c("shared"))).select(*both)

    def similar(pairs: DataFrame) -> DataFrame:
        """The later lines of those pairs whose sets are similar, as a table."""
        pairs = staged(pairs, "line-pairs")
        sets = staged(_sets(source, pairs.select(*LINE).unionByName(pairs.select(*[c(f"{k}_x").alias(k) for k in LINE])).distinct(), span), "line-keys")
        mine = sets.select(*[c(k).alias(f"{k}_x") for k in LINE], c("keys").alias("keys_x"))
        other = sets.select(*LINE, c("keys").alias("keys_y"))
        held = pairs.hint("merge").join(other, LINE).hint("merge").join(mine, [f"{k}_x" for k in LINE])
        inter = F.size(F.array_intersect("keys_x", "keys_y"))
        found = staged(held.where(inter * (100 + percent) >= (F.size("keys_x") + F.size("keys_y")) * percent).select(*LINE).distinct(), "line-gone")
        scratch.drop("line-pairs", "line-keys")
        return found

    named = met.select("token", *[c(k).alias(f"{k}_x") for k in (*LINE, "n", "at", "before")])
    star = pairs_of(met, leads).select(*both).distinct()
    own = met.groupBy(*LINE).agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens"))
    own_x = own.select(*[c(k).alias(f"{k}_x") for k in (*LINE, "n", "tokens")])
    known = star.hint("merge").join(own, LINE).hint("merge").join(own_x, [f"{k}_x" for k in LINE])
    # tokens of a line with equal hashes count as shared
    shared = F.size(F.array_intersect("tokens", "tokens_x")) + F.size("tokens") - F.size(F.array_distinct("tokens"))
    gone = similar(known.where(can_be(shared)).select(*both))
    open_ = met.hint("merge").join(gone, LINE, "left_anti")
    gone = gone.unionByName(similar(enough(pairs_of(open_, named)))).distinct().withColumn("gone", F.lit(True))

    marked = classes.select(*LINE, "h2", "copies").join(gone, LINE, "left").where("copies > 1 OR gone").select("h1", "h2", F.struct("doc_id", "line").alias("first"), F.coalesce("gone", F.lit(False)).alias("gone"))
    marked = staged(marked, "line-marked")
    scratch.drop("line-met", "line-gone", "line-classes")
    return lines, marked


def _sets(source: DataFrame, lines: DataFrame, span: int) -> DataFrame:
    """All columns of ``lines`` (doc_id, line, h1, ...) with the full token set of each as ``keys``.

    The texts are read again, but only flagged documents are parted into lines and only flagged lines into tokens.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    some = flagged(source.withColumn("doc_id", own), flags(lines, "doc_id"), "doc_id")
    some = flagged(lines_of(some), flags(lines, "doc_id", "line"), "doc_id", "line")
    sets = some.withColumn("keys", tokens_of(F.col("body"), span)).select("doc_id", "line", F.xxhash64("keys").alias("h1"), "keys")
    return lines.hint("merge").join(sets, LINE).dropDuplicates(LINE)


def removed_lines(docs: DataFrame, **rules) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed`` and ``removed`` (ascending line numbers from 0) of every document."""
    lines, marked = _judged(docs, **{"span": 5, "percent": 80} | rules)
    # lines of a document are numbered without a gap
    n_lines = lines.groupBy("doc_id").agg((F.max("line") + 1).cast("long").alias("n_lines"))
    gone = _gone_of(lines, marked).groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    own = F.when(F.col("doc_id") != FIRST_ID, F.col("doc_id"))
    return n_lines.join(gone, "doc_id", "left").select(own.alias("doc_id"), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, *, drop_emptied: bool = True, **rules) -> DataFrame:
    """``docs`` with later near-duplicate lines taken out of ``text``; all columns stay, ``n_chars`` follows the text if there.

    A document that had words and keeps none is dropped if ``drop_emptied``; others, null texts too, stay as they are. No
    name of a column of ``docs`` can clash.
    """
    own = docs.columns
    lost, gone_id = free_name(own, "lost"), free_name(own, "gone_id")
    own_id = F.when(F.col("doc_id") != FIRST_ID, F.col("doc_id"))
    found = gone_lines(docs, **rules).groupBy("doc_id").agg(F.collect_list("line").alias(lost)).select(own_id.alias(gone_id), lost)
    met = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[gone_id]), "left")
    left = F.array_join(F.filter(F.transform(F.split("text", "\n", -1), lambda t, i: F.when(~F.array_contains(lost, i), t)), lambda t: t.isNotNull()), "\n")
    met = met.withColumn("text", F.when(F.col(lost).isNotNull(), left).otherwise(F.col("text")))
    if drop_emptied:
        met = met.where(F.col(lost).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in own:
        met = met.withColumn("n_chars", F.when(F.col(lost).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return met.select(*own)
