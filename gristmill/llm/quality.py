"""Quality rules, line first: clean a document line by line, then judge what is left of it.

Every line is held against three rules, in this order; the first that fails names the line's fault:

* ``boilerplate`` - it holds a stock phrase (cookie and copyright notices, script warnings, sharing links);
* ``navigation`` - separators make up a large share of its words, or it is a short run of menu words;
* ``punctuation`` - it doesn't end as a sentence does, or symbols and repeated marks make up much of it.

Failing lines are removed. A document is rejected if too little of its text is left, or too few words.
All of it is built-in Spark expressions over whole texts, without a shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import SPACE, WORD, let

BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy",
    "cookie policy", "use of cookies", "uses cookies", "enable javascript", "javascript is disabled",
    "requires javascript", "lorem ipsum", "powered by", "click here", "share this", "follow us on",
    "subscribe to our", "sign up for our newsletter", "log in to", "add to cart", "licensed under",
    "permission is hereby granted", "without warranty of any kind", "spdx-license-identifier", "copyright (c)",
    "copyright ©", "tous droits réservés", "alle rechte vorbehalten", "todos los derechos reservados",
)
MENU = (
    "home", "about", "contact", "login", "logout", "register", "search", "menu", "sitemap", "help", "faq", "next",
    "previous", "prev", "back", "top", "more", "share", "print", "email", "blog", "news", "shop", "cart", "account",
)
SEPARATORS = r"(?:^|(?<=\s))[|»«›‹>•·→/\\~*=_-]+(?=\s|$)"
SPACES, ENDS, CLOSERS = " \t\n\x0b\x0c\r", ".!?…。！？:;", "\"'”’»)]"
SYMBOLS = r"[#*$%&|<>{}=\\^~]|!!|\?\?"


def words_of(text: Column) -> Column:
    """The words of ``text``, in order. Texts with none but single blanks between words take the quicker split."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    slow = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    odd = reduce(or_, [F.contains(text, F.lit(blank)) for blank in ("  ", "\t", "\n", "\x0b", "\x0c", "\r")]) | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" ")) | (text == "")
    return F.when(odd, slow).otherwise(F.split(text, " "))


def line_fault(line: Column, *, max_menu_words: int = 12, max_separator_share: float = 0.3, max_symbol_share: float = 0.08) -> Column:
    """Name of the first rule that ``line`` fails; null if it fails none. Blank lines fail none.

    Cheap tests stand first, so that the regular expressions run only over the lines that need them.
    """
    stock = let(F.lower(line), lambda low: reduce(or_, [F.contains(low, F.lit(phrase)) for phrase in BOILERPLATE]))
    n_words = F.size(F.split(line, SPACE))
    separators = F.when(line.rlike(r"[|»«›‹>•·→/\\~*=_-]"), F.regexp_count(line, F.lit(SEPARATORS))).otherwise(0)
    menu = F.regexp_count(F.lower(line), F.lit(r"\b(?:" + "|".join(MENU) + r")\b"))
    menu_only = let(n_words, lambda n: F.when(n <= max_menu_words, menu * 2 > n).otherwise(False))
    last = F.right(F.rtrim(F.rtrim(line, F.lit(SPACES)), F.lit(CLOSERS)), F.lit(1))
    return (
        F.when(stock, F.lit("boilerplate"))
        .when((separators > 0) & (separators > n_words * max_separator_share), F.lit("navigation"))
        .when(menu_only, F.lit("navigation"))
        .when(~last.isin(list(ENDS)), F.lit("punctuation"))
        .when(F.regexp_count(line, F.lit(SYMBOLS)) > F.length(line) * max_symbol_share, F.lit("punctuation"))
    )


def repeated_words(words: Column, span: int = 5) -> Column:
    """How many of ``words`` stand in a window of ``span`` words that the array holds twice or more.

    Windows are compared by a 64-bit hash. Texts without a repeated window, the usual case, stop after a distinct
    count; only the others sort their windows to find the positions.
    """
    count = F.size(words)
    windows = F.when(
        count >= span,
        F.transform(F.sequence(F.lit(0), F.greatest(count - span, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(span)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda all_: F.filter(
            all_, lambda p, k: F.coalesce(F.get(all_, k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(all_, k + 1)["h"] == p["h"], F.lit(False))
        )
        starts = let(ordered, lambda o: F.sort_array(F.transform(twice(o), lambda p: p["i"])))
        # a window covers its words up to the start of the next one
        steps = let(starts, lambda s: F.transform(s, lambda x, k: F.least(F.lit(span), F.coalesce(F.get(s, k + 1) - x, F.lit(span)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("bigint")


def clean_lines(docs: DataFrame, text: str = "text", *, span: int = 5, min_words: int = 10, max_repeat_share: float = 0.2, min_kept_share: float = 0.5, **rules) -> DataFrame:
    """All columns of ``docs`` and one struct ``quality`` beside them.

    ``quality`` holds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``clean_text`` (the lines that pass, in order), ``lines_boilerplate``, ``lines_navigation``, ``lines_punctuation``
    (lines removed), ``kept_share`` (word characters left) and ``kept``.

    A null or empty text has no words: every count is 0, ``base_failed`` is true, ``clean_text`` is empty. Repeated
    rows and ties are judged each on their own; no other column is read or lost, whatever its name, save
    for a column ``quality``, which is replaced.
    """
    mark = "__"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    own = lambda name: f"{mark}{name}"
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn(own("text"), body)
    step = step.withColumn(own("words"), words_of(F.col(own("text")))).withColumn(
        own("lines"), F.filter(F.split(F.col(own("text")), "\n", -1), lambda line: line.rlike(WORD))
    )
    step = step.withColumn(own("n"), F.size(own("words")).cast("bigint")).withColumn(
        own("judged"), F.transform(own("lines"), lambda line: F.struct(line.alias("line"), line_fault(line, **rules).alias("fault")))
    )
    step = step.withColumn(own("repeat"), repeated_words(F.col(own("words")), span)).withColumn(
        own("passed"), F.transform(F.filter(own("judged"), lambda j: j["fault"].isNull()), lambda j: j["line"])
    )
    removed = lambda fault: F.size(F.filter(own("judged"), lambda j: j["fault"] == fault)).cast("bigint")
    letters = lambda words: F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.length(w))
    step = step.withColumns(
        {
            own("chars"): letters(F.col(own("words"))),
            own("lost"): F.aggregate(F.filter(own("judged"), lambda j: j["fault"].isNotNull()), F.lit(0).cast("bigint"), lambda n, j: n + letters(words_of(j["line"]))),
            own("clean"): F.array_join(own("passed"), "\n"),
            own("base"): (F.col(own("n")) < min_words) | (F.col(own("repeat")) * 100 > F.col(own("n")) * int(round(max_repeat_share * 100))),
        }
    )
    share = F.when(F.col(own("chars")) > 0, (F.col(own("chars")) - F.col(own("lost"))) / F.col(own("chars"))).otherwise(F.lit(0.0))
    quality = F.struct(
        F.col(own("n")).alias("n_words"),
        F.col(own("chars")).alias("word_chars"),
        F.regexp_count(F.col(own("text")), F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size(own("lines")) - F.size(F.array_distinct(own("lines")))).cast("bigint").alias("n_dup_lines"),
        F.col(own("repeat")).alias("n_repeat_words"),
        F.col(own("base")).alias("base_failed"),
        F.col(own("clean")).alias("clean_text"),
        removed("boilerplate").alias("lines_boilerplate"),
        removed("navigation").alias("lines_navigation"),
        removed("punctuation").alias("lines_punctuation"),
        share.alias("kept_share"),
        (~F.col(own("base")) & (share >= min_kept_share)).alias("kept"),
    )
    return step.withColumn("quality", quality).drop(own("text"), own("words"), own("lines"), own("n"), own("judged"), own("repeat"), own("passed"), own("chars"), own("lost"), own("clean"), own("base"))
