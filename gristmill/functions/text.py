"""Text functions of code search: identifiers, query and index tokens, lines, hashes. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without retrieval signal in a question about code.
STOPWORDS = """
a about after all also am an and any are as at be because been being between but by call called calls can code codebase
could did do does doing done each explain file files find for from function get gets give had has have here how i if in
into is it its just know let like make many may me method might more most much must my need no not of on once one only or
other our out over please repo repository same see should show so some such tell than that the their them then there
these they this those through to up us use used uses using very want was we were what when where which while who why will
with work working works would you your
""".split()

# Keywords of programming languages that don't count as identifiers.
KEYWORDS = """
abstract and any args as assert async await begin bool boolean break byte case catch char class const constexpr continue
crate def default defer del delete do double elif else elseif end endif enum except export extends extern false final
finally float fn for foreach from func function global go goto if impl implements import in include instanceof int
interface is lambda let long match mod module mut namespace native new nil none nonlocal not null nullptr operator or
package pass print private protected pub public raise range ref require return select self short signed sizeof static std
str string struct super switch synchronized template then this throw throws trait transient true try type typedef typeof
undefined union unsigned use using var void volatile where while with yield
""".split()

MIN_TOKEN, MIN_IDENTIFIER = 2, 3
WORD, IDENTIFIER, INDEX_TOKEN = r"[A-Za-z0-9_]+", r"[A-Za-z_][A-Za-z0-9_]*", r"[\p{L}\p{N}_]+"


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it, within lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeezed(text: Column) -> Column:
    """``text`` without white space at its ends, every run inside as one blank."""
    return F.regexp_replace(stripped(text), r"\s+", " ")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def in_words(word: Column, words: list[str]) -> Column:
    return word.isin(words)


def identifier_parts(word: Column) -> Column:
    """Lower-case parts of an identifier, cut at underscores and at camel-case and acronym bounds."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "_+", " "), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), " "), lambda p: p != "")


def query_tokens(question: Column) -> Column:
    """Search tokens of a question, first seen first: plain words that aren't stopwords; compound ones whole and in parts."""

    def of(word: Column) -> Column:
        def chosen(parts: Column) -> Column:
            whole = F.array(F.lower(word))
            plain = F.when(in_words(F.lower(word), STOPWORDS), F.array().cast("array<string>")).otherwise(whole)
            return F.when(F.size(parts) > 1, F.concat(whole, parts)).otherwise(plain)

        return F.element_at(F.transform(F.array(identifier_parts(word)), chosen), 1)

    every = F.flatten(F.transform(F.regexp_extract_all(question, F.lit(WORD), F.lit(0)), of))
    return F.array_distinct(F.filter(every, lambda t: F.length(t) >= MIN_TOKEN))


def match_expression(tokens: Column) -> Column:
    """Full-text match expression of ``tokens``: each quoted, joined by OR."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def index_tokens(text: Column) -> Column:
    """Tokens as the full-text index holds them: lower-case runs of letters, digits and underscores; nothing is split."""
    return F.transform(F.regexp_extract_all(text, F.lit(INDEX_TOKEN), F.lit(0)), F.lower)


def identifiers(text: Column) -> Column:
    """Identifiers of a blob of code, in order, keywords left out."""
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= MIN_IDENTIFIER) & ~in_words(F.lower(w), KEYWORDS))


def first_line(text: Column, length: int = 120) -> Column:
    """The first line that isn't blank, trimmed and cut."""
    some = F.filter(F.transform(lines(text), stripped), lambda t: t != "")
    return F.substr(F.coalesce(F.get(some, F.lit(0)), F.lit("")), F.lit(1), F.lit(length))


def truncated(text: Column, length: int = 140) -> Column:
    """One-line form of at most ``length`` characters, an ellipsis where it was cut."""
    one = squeezed(text)
    return F.when(F.length(one) <= length, one).otherwise(F.concat(F.substr(one, F.lit(1), F.lit(length - 1)), F.lit("…")))


def clipped(text: Column, length: int, marker: str = "…") -> Column:
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.substr(text, F.lit(1), F.lit(length)), F.lit(marker)))


def root_cause_key(cause: Column, path: Column, line: Column, title: Column) -> Column:
    """Short hash of a finding's cause, or of where it stands and its title if it names none."""
    named = F.nullif(stripped(cause), F.lit(""))
    text = F.coalesce(named, F.concat_ws(":", path, line.cast("string"), stripped(title)))
    return F.substr(F.sha2(F.lower(F.regexp_replace(text, r"\s+", " ")), 256), F.lit(1), F.lit(16))
