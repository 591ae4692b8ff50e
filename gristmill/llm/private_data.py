"""Private data replaced by surrogates that keep their kind, format, script and gender.

Mentions of e-mail and network addresses (IPv4 and IPv6), phone, card and identity numbers, bank accounts, secrets and names of persons are
detected in whole texts. A name is known by a title, by a label before it (``Author: Jane Roe``), by words that introduce it, or by an
e-mail address of the same text that is made of it (``jane.roe@``); then all its mentions in the text count. Each distinct entity (kind and canonical value, so that two ways to write one number meet) gets one surrogate from a
keyed hash, the same everywhere: coreference holds within and across documents. A given name has one gender over the corpus, that
of most of its mentions after a title that tells one, so "Dr Maria Clark" and "Mrs Maria Clark" are one person. A surrogate that
two entities drew, or that is a real entity of the corpus, is drawn again by all but one, until none is left: distinct
entities stay distinct, names of all kinds among each other too.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import Scratch, free_name
from gristmill.llm.line_dedup import flags, with_flag

# Titles by gender, and names to draw from, by gender.
TITLES = {"mr": "m", "mister": "m", "sir": "m", "mrs": "f", "ms": "f", "miss": "f", "lady": "f", "dr": "u", "prof": "u", "herr": "m", "frau": "f", "monsieur": "m", "madame": "f", "mme": "f", "mlle": "f", "señor": "m", "señora": "f", "sra": "f", "srta": "f", "господин": "m", "госпожа": "f"}
#: Labels, with a colon, and phrases that a person's name follows; words after which a number is none of a phone.
LABELS = ["name", "full name", "author", "contact", "contact person", "signed", "attn", "nombre", "nom", "имя"]
PHRASES = ["my name is", "signed by", "written by", "yours sincerely,", "kind regards,", "best regards,", "mein name ist", "me llamo", "je m'appelle", "меня зовут"]
NUMBERED = re.compile(r"(?i)(?<!\w)(?:order|invoice|ticket|case|ref|reference|isbn|id|part|article)[ .:#]{0,3}(?:(?:no|nr|number)[ .:#]{1,3})?$")
GIVEN = {
    "m": ["Adrian", "Bernard", "Carlos", "Daniel", "Edward", "Felix", "Gabriel", "Hugo", "Ivan", "Julian", "Karl", "Lucas", "Martin", "Nicolas", "Oscar", "Paul"],
    "f": ["Alice", "Beatrice", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nina", "Olivia", "Paula"],
    "u": ["Alex", "Andrea", "Ariel", "Charlie", "Dominique", "Eden", "Jordan", "Kim", "Lou", "Morgan", "Noa", "Quinn", "Robin", "Sascha", "Sam", "Toni"],
}
SURNAMES = ["Abel", "Berg", "Castro", "Dumas", "Ebert", "Fabre", "Garner", "Hale", "Ibanez", "Jensen", "Keller", "Lambert", "Marsh", "Navarro", "Olsen", "Perrin", "Quill", "Rossi", "Sander", "Torres", "Ullman", "Vidal", "Weber", "Young"]
SYLLABLES = ["ba", "bel", "cor", "da", "den", "el", "fa", "gar", "hal", "i", "jo", "kan", "la", "lin", "mar", "mo", "na", "nor", "o", "pel", "ra", "ros", "sa", "tan", "ter", "u", "val", "vin", "wel", "za"]
#: Attempts after which surrogates grow.
WIDER = 3

_LOWER = "".join(c for c in map(chr, range(0x80, 0x2000)) if c.islower() and c.isalpha())
_CAPITAL = r"[^\W\d_a-z" + _LOWER + r"][^\W\d_]*(?:['’-][^\W\d_]+)*"
PATTERNS = [
    ("email", re.compile(r"[^\s@<>()\[\]\"',;:]{1,64}@[\w-]+(?:\.[\w-]+)+")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")),
    ("ipv6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f]{1,4}|(?<=::))(?![\w:]|\.\d)")),
    ("id", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("phone", re.compile(r"(?<!\w)\+\d(?:[ .()-]{0,2}\d){7,14}(?!\w|[.-]\d)|(?<![\w.])(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w|[.-]\d)")),
    ("card", re.compile(r"(?<!\w)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)")),
    ("secret", re.compile(r"(?<!\w)(?=[A-Za-z_-]{0,200}\d)(?=[\d_-]{0,200}[A-Za-z])(?:[A-Fa-f0-9]{32,}|(?:sk|pk|ghp|gho|xox[abp]|AKIA|AIza|glpat)[A-Za-z0-9_-]{12,})(?!\w)")),
    ("named", re.compile(r"(?<!\w)(?:(?i:" + "|".join(LABELS) + r")[ \t]{0,4}:[ \t]{0,4}|(?i:" + "|".join(p.replace(" ", r"\s{1,4}") for p in PHRASES) + r")\s{1,4})((?:" + _CAPITAL + r"[ \t]){1,2}" + _CAPITAL + r")(?=[ \t]*(?:[.,;()<\[\r\n]|$))")),
    ("name", re.compile(r"(?<!\w)((?i:" + "|".join(TITLES) + r"))(\.?[  ]+)((?:(?!(?i:" + "|".join(TITLES) + r")(?!\w))[^\W\d_a-z" + _LOWER + r"][^\W\d_]*['’-]?[^\W\d_]*[  ]?)+)")),
]


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of the mentions in ``text``, in order, none within another.

    Names found are looked up in the rest of the text, but for words that it also writes in lower case (other than in an address).
    A number after a word such as ``order`` or ``invoice`` is no phone unless it begins with a plus.
    """
    found: list[tuple[int, int, str, str]] = []
    digits = any(c in text for c in "0123456789")
    for kind, pattern in PATTERNS:
        if kind == "email" and "@" not in text or kind in ("ip", "ipv6", "id", "iban", "phone", "card", "secret") and not digits:
            continue
        for m in pattern.finditer(text):
            if kind == "name":
                found += _names(m, 3, TITLES[m.group(1).lower()])
            elif kind == "named":
                found += _names(m, 1, "u")
            elif kind == "phone" and m.group()[0] != "+" and NUMBERED.search(text, max(0, m.start() - 30), m.start()):
                continue
            elif kind == "ipv6":
                if (value := _ipv6(m.group())) is not None:
                    found.append((*m.span(), kind, value))
            else:
                value = m.group().rstrip(".-") if kind == "email" else m.group()
                canonical = re.sub(r"\D", "", value) if kind in ("phone", "card", "id") else value.replace(" ", "") if kind == "iban" else value.lower() if kind == "email" else value
                found.append((m.start(), m.start() + len(value), kind, canonical))
    addresses = [f for f in found if f[2] == "email"]
    found += _of_addresses(text, {value for _, _, _, value in addresses})
    names = {value: kind for _, _, kind, value in reversed(found) if kind.startswith("given_") or kind == "surname"}
    found += _again(text, names, [f[:2] for f in addresses])
    out, end = [], 0
    for one in sorted(found, key=lambda x: (x[0], -x[1])):
        if one[0] >= end:
            out.append(one)
            end = one[1]
    return out


def _ipv6(text: str) -> str | None:
    """The canonical form of an IPv6 address; null if ``text`` is none, or has no digit (``a::b`` in source code)."""
    try:
        return str(ipaddress.IPv6Address(text)) if any(c.isdigit() for c in text) else None
    except ValueError:
        return None


def _names(m: re.Match, group: int, gender: str) -> list[tuple[int, int, str, str]]:
    """The capitalised words of a group of ``m``, the last one as the surname; equal names in other case are one entity."""
    at, words = m.start(group), m.group(group).split()
    out = []
    for k, word in enumerate(words):
        start = m.string.index(word, at)
        at = start + len(word)
        word = re.sub(r"['’][sS]?$|-$", "", word)
        if word:
            out.append((start, start + len(word), f"given_{gender}" if k < len(words) - 1 else "surname", word.lower()))
    return out


def _of_addresses(text: str, addresses: set[str]) -> list[tuple[int, int, str, str]]:
    """Names in ``text`` that one of the e-mail ``addresses`` is made of, as ``Jane Roe``, ``Jane Q. Roe`` or ``Roe, Jane``; one pass for all addresses."""
    known = set()
    for address in addresses:
        parts = [p for p in re.split(r"[._\d-]+", address.partition("@")[0]) if p]
        if len(parts) == 2 and all(p.isalpha() and len(p) > 1 for p in parts):
            known |= {tuple(parts), tuple(reversed(parts))}
    if not known:
        return []
    words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"(?<!\w)" + _CAPITAL + r"(?!\w)", text)]
    out = []
    for k, (start, end, word) in enumerate(words[:-1]):
        between = text[end : words[k + 1][0]]
        after = k + 1
        if between == " " and len(words[after][2]) == 1 and after + 1 < len(words) and text[words[after][1] : words[after + 1][0]] == ". ":
            after += 1  # an initial between the names
        first, last = (start, end, word), words[after]
        if (word, last[2]) in known and between in (" ", "\u00a0", ", "):
            given, family = (last, first) if between == ", " else (first, last)
            out += [(given[0], given[1], "given_u", given[2]), (family[0], family[1], "surname", family[2])]
    return out


def _again(text: str, names: dict[str, str], addresses: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """All mentions of ``names`` (in lower case, with their kinds) in ``text``, with a title or without; within ``addresses`` (spans in order) none counts."""
    if not names:
        return []
    starts = [a for a, _ in addresses]
    within = lambda at: (k := bisect.bisect_right(starts, at)) > 0 and at < addresses[k - 1][1]
    said = [(m.start(), m.end(), m.group()) for m in re.finditer(r"(?<!\w)(?i:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)", text) if not within(m.start())]
    common = {word.lower() for _, _, word in said if word[0].islower()}
    return [(start, end, names[word.lower()], word.lower()) for start, end, word in said if word.lower() in names and word.lower() not in common]


class Stream:
    """Numbers from a keyed hash of an entity and the attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed, self.n, self.raw = f"{kind}\0{value}\0{attempt}".encode("utf-8", "surrogatepass"), 0, b""
        self.key = key

    def below(self, n: int) -> int:
        if len(self.raw) < 4:
            self.raw += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        value, self.raw = int.from_bytes(self.raw[:4], "big"), self.raw[4:]
        return value % n


def _like(char: str, s: Stream) -> str:
    """A character of the same kind: a digit, or a letter of the same case and script; others stay."""
    if char.isdigit():
        return str(s.below(10)) if char.isascii() else char
    if not char.isalpha():
        return char
    if char.isascii() or unicodedata.name(char, "").startswith("LATIN"):
        return (chr(97 + s.below(26))).upper() if char.isupper() else chr(97 + s.below(26))
    for first, last in ((0x3B1, 0x3C1), (0x430, 0x44F), (0x5D0, 0x5EA), (0x4E00, 0x9FA5), (0x3041, 0x3094), (0xAC00, 0xD7A3)):
        if first - 0x20 * (first < 0x500) <= ord(char.lower()) <= last + 15:
            got = chr(first + s.below(last - first + 1))
            return got.upper() if char.isupper() else got
    return chr(97 + s.below(26))


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of an entity: of the same kind, length class and script as ``value``.

    From the attempt ``WIDER`` on it is longer by one character more every ``WIDER`` attempts, so that a free one always exists.
    """
    s = Stream(key, kind, value, attempt)
    more = attempt // WIDER
    if kind == "ip" and more:  # any address, then octets of a wider range than real ones have
        return ".".join(str(s.below(256 if more == 1 else 10 ** min(more + 2, 9))) for _ in range(4))
    if kind == "ip":
        return ".".join(str({1: lambda: s.below(10), 2: lambda: 10 + s.below(90), 3: lambda: 100 + s.below(156)}[len(o)]()) for o in value.split("."))
    if kind == "ipv6":
        groups = value.split(":") if more < 2 else ["0000"] * 8
        drawn = ["".join("0123456789abcdef"[s.below(16)] for _ in g + "0" * (more and 4 - len(g))) if g else "" for g in groups]
        return str(ipaddress.IPv6Address(":".join(drawn)))
    if kind in ("phone", "id"):
        keep = 1 if kind == "phone" and len(value) > 10 else 0  # the country code
        return value[:keep] + "".join(str(s.below(10)) for _ in value[keep:] + "0" * more)
    if kind == "card":
        made = value[0] + "".join(str(s.below(10)) for _ in value[1:] + "0" * more)
        if _luhn(value) == 0:  # a valid number gets a valid one
            made = made[:-1] + "0"
            made = made[:-1] + str(-_luhn(made) % 10)
        return made
    if kind == "email":
        local, _, domain = value.rpartition("@")
        *names, top = domain.split(".")
        return "".join(_like(c, s) for c in local + "a" * more) + "@" + ".".join("".join(_like(c, s) for c in n) for n in names) + "." + top
    if kind == "iban":
        account = "".join(_like(c, s) for c in value[4:] + "0" * more)
        valid = _mod97(value[4:] + value[:4]) == 1  # a valid number gets a valid one
        return value[:2] + (f"{98 - _mod97(account + value[:2] + '00'):02d}" if valid else "".join(_like(c, s) for c in value[2:4])) + account
    if kind == "secret" and re.fullmatch(r"[A-Fa-f0-9]+", value):
        return "".join(("ABCDEF0123456789" if value.upper() == value else "abcdef0123456789")[s.below(16)] for _ in value + "0" * more)
    if kind.startswith("given_") or kind == "surname":
        latin = all(unicodedata.name(c, "").startswith("LATIN") for c in value if c.isalpha())
        if not latin:
            return "".join(_like(c, s) for c in value + value[-1] * more)
        names = SURNAMES if kind == "surname" else GIVEN[kind[-1]]
        made = names[s.below(len(names))]
        if attempt:  # the lists are short: longer names once one is taken
            made += "".join(SYLLABLES[s.below(len(SYLLABLES))] for _ in range(1 + attempt))
        return made
    return "".join(_like(c, s) for c in value + "a" * more)


def _luhn(digits: str) -> int:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10


def _mod97(code: str) -> int:
    """The remainder of an account number whose letters stand for 10 to 35."""
    return int("".join(str(int(c, 36)) for c in code)) % 97


def _formatted(mention: str, canonical: str, kind: str) -> str:
    """``canonical`` in the writing of ``mention``: its separators, and its upper case for an address."""
    if kind in ("phone", "card", "id", "iban"):
        left = iter(canonical)
        return "".join(next(left, "") if c.isalnum() else c for c in mention) + "".join(left)
    if kind in ("email", "ipv6"):
        return canonical.upper() if mention.isupper() else canonical
    if kind.startswith("given_") or kind == "surname":
        return canonical.upper() if mention.isupper() and len(mention) > 1 else canonical[:1].upper() + canonical[1:]
    return canonical


def _one_gender(mentions: DataFrame) -> DataFrame:
    """``mentions`` with each given name under one kind: the gender that most of them have (male before female where equal), or none."""
    given = mentions.where(F.col("kind").startswith("given_")).groupBy("value").agg(F.count_if(F.col("kind") == "given_m").alias("m"), F.count_if(F.col("kind") == "given_f").alias("f"))
    one = F.when((F.col("m") == 0) & (F.col("f") == 0), "given_u").when(F.col("m") >= F.col("f"), "given_m").otherwise("given_f")
    names = given.select("value", F.lit(True).alias("given"), one.alias("one"))
    met = mentions.withColumn("given", F.col("kind").startswith("given_")).join(names, ["value", "given"], "left")
    return met.select("digest", "start", "end", F.coalesce("one", "kind").alias("kind"), "value")


def _surrogates(entities: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """kind, value, surrogate: one to one within a kind (names of all kinds count as one), and no surrogate is an entity of the corpus."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, value, attempt = (b.column(k) for k in range(3))
            made = [surrogate(key, k, v, a) for k, v, a in zip(kind.to_pylist(), value.to_pylist(), attempt.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([kind, value, attempt, pa.array(made, pa.string())], ["kind", "value", "attempt", "surrogate"])

    schema = "kind string, value string, attempt int, surrogate string"
    space = F.when(F.col("kind").startswith("given_") | (F.col("kind") == "surname"), "name").otherwise(F.col("kind")).alias("space")
    drawn, turn = scratch.put(entities.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema), "drawn0"), 0
    real = entities.select(space, F.lower("value").alias("low")).distinct().withColumn("real", F.lit(True))
    while True:
        owner = drawn.groupBy(space, F.lower("surrogate").alias("low")).agg(F.min(F.struct("attempt", "kind", "value")).alias("first"))
        judged = drawn.select("*", space, F.lower("surrogate").alias("low")).join(owner, ["space", "low"]).join(real, ["space", "low"], "left")
        judged = judged.withColumn("again", F.col("real").isNotNull() | (F.col("first.value") != F.col("value")) | (F.col("first.kind") != F.col("kind")))
        judged = scratch.put(judged.select("kind", "value", "attempt", "surrogate", "again"), f"judged{turn}")
        scratch.drop(f"drawn{turn}")
        if not judged.where("again").limit(1).count():
            break
        anew = judged.where("again").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, schema)
        drawn = scratch.put(judged.where("NOT again").drop("again").unionByName(anew), f"drawn{turn + 1}")
        scratch.drop(f"judged{turn}")
        turn += 1
    return judged.select("kind", "value", "surrogate")


def replace_private(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with surrogates in the text, and ``private_found``: how many mentions were replaced.

    ``key`` is the secret of the hash that surrogates are drawn from: who has it can link surrogates of several runs, so keep it
    as one keeps a password. Mentions that overlap: the one that begins first counts, then the longest. Texts of any length are taken whole.

    ``n_chars`` follows the text where there is one. Null and empty texts and those without a mention stay as they are, with
    0; equal texts get equal results, so repeated rows do too; an empty table stays empty. Columns of the same name
    as ``private_found`` go; no other column is read.

    Only texts with mentions are shuffled, once each by a digest, and joined back under a flag table of bounded size.
    """
    docs = docs.drop("private_found")
    own, scratch = docs.columns, Scratch(docs.sparkSession, "private-data")
    digest, met_, said_ = (free_name(own, n) for n in ("text_digest", "text_met", "text_said"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, spans = [], []
            for t in batch.column(0).to_pylist():
                if t and (found := find(t)):
                    digest.append(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest())
                    spans.append([dict(zip(("start", "end", "kind", "value"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(spans, kind)], ["digest", "spans"])

    spans = "array<struct<start: int, end: int, kind: string, value: string>>"
    found = scratch.put(docs.select(text).mapInArrow(detect, f"digest binary, spans {spans}").dropDuplicates(["digest"]), "mentions")
    mentions = _one_gender(found.select("digest", F.explode("spans").alias("m")).select("digest", "m.*"))
    names = _surrogates(scratch.put(mentions.select("kind", "value").distinct(), "entities"), key, scratch)
    said = mentions.hint("merge").join(names, ["kind", "value"]).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias("said"))
    said = scratch.put(said.select(F.col("digest").alias(digest), F.col("said").alias(said_)), "said")
    scratch.drop("mentions")

    marked = with_flag(docs.withColumn(digest, F.unhex(F.md5(F.col(text).cast("binary")))), flags(said, digest), [digest], met_)
    met = marked.where(F.col(met_)).hint("merge").join(said, digest, "left").select(*own, said_)
    at = own.index(text)
    n_chars = own.index("n_chars") if "n_chars" in own else None
    schema = docs.withColumn("private_found", F.lit(0).cast("long")).schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, count = [], []
            for t, all_said in zip(batch.column(at).to_pylist(), batch.column(len(own)).to_pylist(), strict=True):
                out, end = [], 0
                for s in all_said or ():
                    out += [t[end : s["start"]], _formatted(t[s["start"] : s["end"]], s["surrogate"], s["kind"])]
                    end = s["end"]
                made.append(t if t is None else "".join(out) + t[end:])
                count.append(len(all_said or ()))
            columns = batch.columns[: len(own)]
            columns[at] = pa.array(made, pa.string())
            if n_chars is not None:
                columns[n_chars] = pa.array([None if t is None else len(t) for t in made], columns[n_chars].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64())], [*own, "private_found"])

    return marked.where(~F.col(met_)).select(*own, F.lit(0).cast("long").alias("private_found")).unionByName(met.mapInArrow(rewrite, schema))
