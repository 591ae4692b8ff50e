"""Static evidence of source files: facts that patterns can tell, line by line, without running anything."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import text

# Bounds, extensions by how they write comments, and the patterns of the facts.
MAX_FACTS, MAX_DETAIL = 40, 240
SLASHED, HASHED = ["js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts"], ["py", "pyw", "rb", "rake"]
FUNCTION = r"\b(?:async\s+)?function\s*(?:\*\s*)?([A-Za-z_$][\w$]*)\s*\(([^)]*)\)"
ARROW = r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\(([^)]*)\)|([A-Za-z_$][\w$]*))\s*=>"
PROPERTY = r"(?i)\b(?:response|res|result|body|payload)\s*(?:\?\.)?\.\s*[A-Za-z_$][\w$]*"
CALL = r"(?<![.$?\]\w])(\b(?:await|return|void|new|function)\s+)?\b([A-Za-z_$][\w$]*)\s*\(([^()]*)\)"
NO_CALLS = ["if", "for", "while", "switch", "catch", "function"]

RUNTIME_FILES = ["dockerfile", "pyproject.toml", "package.json", ".nvmrc", ".node-version", "runtime.txt"]
BRACKETED = r"(?i)\b(?:response|res|result|body|payload)\s*\[\s*(['\"])([^'\"]+)\1\s*\]"
BEFORE_PATTERN, WORDS_BEFORE_PATTERN = "=(:,!&|?{}[;]~", ["return", "throw", "case", "delete", "void", "typeof", "instanceof", "in", "of"]

_SLASH = re.compile(r"//[^\r\n]*|/\*[\s\S]*?(?:\*/|\Z)")
_PATTERN = re.compile(r"/(?:\\(?:[\s\S]|\Z)|\[(?:\\(?:[\s\S]|\Z)|[^\]\\])*\]?|[^/\\\[])*/?")
_QUOTED = {q: re.compile(rf"{q}(?:\\(?:[\s\S]|\Z)|[^{q}\\])*({q}?)") for q in "\"'`"}
_TRIPLE = re.compile(r"(\"\"\"|\'\'\')[\s\S]*?(?:\1|\Z)")
_HASH = re.compile(r"#[^\r\n]*")
_RUBY = re.compile(r"(?<![^\r\n])=begin(?=[\r\n]|\Z)[\s\S]*?(?:(?<![^\r\n])=end(?=[\r\n]|\Z)|\Z)")
_NEXT = {False: re.compile(r"[/\"'`]"), True: re.compile(r"[/\"'`#]|(?<![^\r\n])=begin(?=[\r\n]|\Z)")}
_WORD_END, _BLANK = re.compile(r"[A-Za-z_$][\w$]*\Z"), re.compile(r"[^\r\n]")
_FREE = re.compile(r"\?\s*(?::|\Z)|(?:^|[^=!<>])=(?![=>])", re.ASCII)


def _may_open_pattern(before: str) -> bool:
    """Whether a slash after ``before`` (the masked line so far, without blanks at its end) begins a pattern and doesn't divide."""
    if not before or before.endswith("=>") or before[-1] in BEFORE_PATTERN:
        return True
    word = _WORD_END.search(before)
    return bool(word) and word.group() in WORDS_BEFORE_PATTERN


def masked(source: str, hashed: bool) -> str:
    """``source`` with comments, patterns and what stands in quotes as blanks; lines and columns stay.

    ``hashed``: comments begin with a hash as well, and three quotes or ``=begin`` hold whole blocks.
    """
    out, at, line = [], 0, ""
    while found := _NEXT[hashed].search(source, at):
        start, mark = found.start(), found.group()
        plain = source[at:start]
        line = (re.split(r"[\r\n]", plain)[-1] if re.search(r"[\r\n]", plain) else line + plain).rstrip()[-64:]
        hidden = _SLASH.match(source, start) if mark == "/" else _HASH.match(source, start) if mark == "#" else _RUBY.match(source, start) if mark == "=begin" else _TRIPLE.match(source, start) if hashed else None
        quoted = _QUOTED[mark].match(source, start) if not hidden and mark in _QUOTED else None
        hidden = hidden or quoted or (_PATTERN.match(source, start) if _may_open_pattern(line) else None)
        if not hidden:
            out.append(plain + mark)
            at, line = start + 1, line + mark
            continue
        blank = _BLANK.sub(" ", hidden.group())
        if quoted:
            blank = mark + (blank[1:-1] + mark if quoted.group(1) else blank[1:])
        out += [plain, blank]
        line = (re.split(r"[\r\n]", blank)[-1] if re.search(r"[\r\n]", blank) else line + blank).rstrip()[-64:]
        at = hidden.end()
    return "".join(out) + source[at:]


def listed(signature: str, generic: bool) -> list[str]:
    """Parts of a list at its commas outside brackets of any depth; with ``generic``, angles count as brackets before a default begins."""
    if not signature.strip():
        return []
    depth, angles, counted, part, parts = [0, 0, 0], 0, generic, "", []
    for mark in re.findall(r"[(){}\[\]<>=,]|[^(){}\[\]<>=,]+", signature):
        kind = "({[".find(mark) if mark in "({[" else ")}]".find(mark)
        if len(mark) == 1 and kind >= 0:
            depth[kind] += 1 if mark in "({[" else -1
        elif counted and mark == "<":
            angles += 1
        elif counted and mark == ">" and angles > 0:
            angles -= 1
        elif counted and mark == "=" and not any(depth):
            counted = False
        elif mark == "," and not any(depth) and not angles:
            parts.append(part.strip())
            part, counted = "", generic
            continue
        part += mark
    return [*parts, part.strip()] if part.strip() else parts


def _masked_texts(files: DataFrame) -> DataFrame:
    """content, ext, base, paths, masked of ``files`` (path, content, ext, base): equal contents of an Arrow batch are one row that names their paths, so that each is scanned once.

    ``masked`` is null where ``ext`` is empty: how comments are written there isn't known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = pa.Table.from_batches([batch]).group_by(["content", "ext", "base"]).aggregate([("path", "list")]).combine_chunks()
            contents, exts = one["content"].to_pylist(), one["ext"].to_pylist()
            made = [masked(c, e in HASHED) if e else None for c, e in zip(contents, exts, strict=True)]
            columns = [one["content"], one["ext"], one["base"], one["path_list"], pa.chunked_array([pa.array(made, pa.string())])]
            yield from pa.Table.from_arrays(columns, ["content", "ext", "base", "paths", "masked"]).to_batches(max_chunksize=1_000)

    return files.select("path", "content", "ext", "base").mapInArrow(run, "content string, ext string, base string, paths array<string>, masked string")


def parameter_bounds(signature: str) -> tuple[int, int | None] | None:
    """The least and most arguments (most: None without bound) that a parameter list takes; None if it can't be told."""
    if "(" in signature or ")" in signature:
        return None
    parts = [p for p in listed(signature, True) if p]
    rest = any(p.startswith("...") for p in parts)
    free = [p.startswith("...") or bool(_FREE.search(p)) for p in parts]
    needed = free.count(False)
    return (needed, None if rest else len(parts)) if all(free[needed:]) else None


def _asked(found: DataFrame) -> DataFrame:
    """``found`` with ``made``, those of ``declared`` whose bounds can be told, and ``wrong``, those of ``calls`` that the last of ``made`` of their name doesn't take.

    Names of a file are met by a dictionary: a pass over its declarations and one over its calls, however long the file is.
    """
    declared, calls = found.columns.index("declared"), found.columns.index("calls")

    def of(batch: pa.RecordBatch) -> Iterator[tuple[list[dict], list[dict]]]:
        for some, said in zip(batch.column(declared).to_pylist(), batch.column(calls).to_pylist(), strict=True):
            told = [(x, parameter_bounds(x["d"]["args"])) for x in some]
            made = [{"line": x["line"], "k": x["k"], "name": x["d"]["name"], "least": b[0], "most": b[1]} for x, b in told if b]
            last = {m["name"]: m for m in made}
            counted = [(x, m, len(listed(x["d"]["args"], False))) for x in said if (m := last.get(x["d"]["name"]))]
            yield made, [{**m, "line": x["line"], "k": x["k"], "n": n} for x, m, n in counted if n < m["least"] or (m["most"] is not None and n > m["most"])]

    told = pa.struct([("line", pa.int64()), ("k", pa.int32()), ("name", pa.string()), ("least", pa.int32()), ("most", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, wrong = zip(*of(batch), strict=True) if batch.num_rows else ((), ())
            columns = [*batch.columns, pa.array(made, pa.list_(told)), pa.array(wrong, pa.list_(pa.struct([*told, pa.field("n", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "made", "wrong"])

    said = "line: bigint, k: int, name: string, least: int, most: int"
    schema = T.StructType([*found.schema.fields, *T.StructType.fromDDL(f"made array<struct<{said}>>, wrong array<struct<{said}, n: int>>").fields])
    return found.mapInArrow(run, schema)


def _bounds_said(b: Column) -> Column:
    return F.when(b["most"].isNull(), F.concat(b["least"].cast("string"), F.lit("+"))).when(b["least"] == b["most"], b["most"].cast("string")).otherwise(F.concat_ws("-", b["least"].cast("string"), b["most"].cast("string")))


def _trimmed(value: Column) -> Column:
    """``value`` without white space at its ends; runs of blanks within it, as masked texts are full of, are passed once."""
    return F.btrim(value, F.lit(" \t\n\x0b\f\r"))


def _each(lines: Column, found) -> Column:
    """``found`` of every line of ``lines`` (line, code) in one array: structs of line, k (place in the line) and what was found."""
    of = lambda l: F.transform(found(l["code"]), lambda d, k: F.struct(l["line"].alias("line"), k.alias("k"), d.alias("d")))
    return F.flatten(F.transform(lines, of))


def static_evidence(files: DataFrame) -> DataFrame:
    """path, place, line, kind, detail: at most 40 facts of each of ``files`` (path, content), in order.

    Kinds: runtime-version (first, of files of the known names), declared-parameters, response-property, awaited-call and unawaited-call (of script files), local-api-arity - calls of a
    function declared in the same file with too few or too many arguments. Lines with a slash are passed over where a slash may begin a pattern. A file is one row: its facts
    are told within it, from its whole text, and nothing is shuffled.
    """
    c, base, ext = F.col, F.lower(F.element_at(F.split("path", "/"), -1)), F.lower(F.element_at(F.split("path", r"\."), -1))
    read = files.where("content IS NOT NULL").select(
        "path", "content", F.when(ext.isin(SLASHED + HASHED), ext).otherwise("").alias("ext"), F.when(base.isin(RUNTIME_FILES), base).otherwise("").alias("base"),
    )
    texts = _masked_texts(read.where("ext <> '' OR base <> ''"))
    slashed = c("ext").isin([*SLASHED, "rb", "rake"])
    both = F.arrays_zip(F.split("masked", r"\r?\n", -1).alias("code"), F.split("content", r"\r?\n", -1).alias("source"))
    lines = F.filter(F.transform(both, lambda l, at: F.struct((at + 1).cast("long").alias("line"), l["code"].alias("code"), l["source"].alias("source"))), lambda l: ~(slashed & l["source"].contains("/")))
    texts = texts.select("content", "ext", "base", "paths", F.coalesce(lines, F.array().cast("array<struct<line: bigint, code: string, source: string>>")).alias("lines"))

    every = lambda code, pattern, group: F.regexp_extract_all(code, F.lit(pattern), F.lit(group))
    zipped = lambda a, b: F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.struct(z["a"].alias("name"), z["b"].alias("args")))
    no_pairs, no_words = F.array().cast("array<struct<name: string, args: string>>"), F.array().cast("array<string>")
    functions = lambda code: F.when(code.contains("function"), zipped(every(code, FUNCTION, 1), every(code, FUNCTION, 2))).otherwise(no_pairs)
    arrows = lambda code: F.when(code.contains("=>"), zipped(every(code, ARROW, 1), F.zip_with(every(code, ARROW, 2), every(code, ARROW, 3), lambda a, b: F.when(a != "", a).otherwise(b)))).otherwise(no_pairs)
    said = lambda code: F.transform(F.arrays_zip(every(code, CALL, 1).alias("a"), every(code, CALL, 2).alias("b"), every(code, CALL, 3).alias("d")), lambda z: F.struct(_trimmed(z["a"]).alias("before"), z["b"].alias("name"), z["d"].alias("args")))
    no_calls = F.array().cast("array<struct<before: string, name: string, args: string>>")
    found = texts.select(
        "paths", "ext", _versions(c("base"), c("content")).alias("versions"),
        _each(c("lines"), lambda code: F.concat(functions(code), arrows(code))).alias("declared"),
        F.filter(_each(c("lines"), lambda code: F.when(code.contains("("), said(code)).otherwise(no_calls)), lambda x: ~x["d"]["name"].isin(NO_CALLS) & (x["d"]["before"] != "function")).alias("calls"),
        _each(c("lines"), lambda code: F.when(code.rlike("(?i)response|res|result|body|payload"), F.concat(every(code, PROPERTY, 0), every(code, BRACKETED, 0))).otherwise(no_words)).alias("properties"),
    )
    found = _asked(found)

    fact = lambda at, line, step, k, kind, detail: F.struct(F.lit(at).alias("at"), line.alias("line"), F.lit(step).alias("step"), k.alias("k"), kind.alias("kind"), detail.alias("detail"))
    shown = lambda x: F.concat(x["d"]["name"], F.lit("("), _trimmed(x["d"]["args"]), F.lit(")"))
    script = F.filter("calls", lambda x: c("ext").isin(SLASHED) & ~x["d"]["before"].isin("return", "void", "new"))
    whole = F.concat(
        F.transform("versions", lambda v: fact(-1, v["line"], -1, v["line"].cast("int"), F.lit("runtime-version"), v["detail"])),
        F.transform("made", lambda m: fact(0, m["line"], 0, m["k"], F.lit("declared-parameters"), F.concat(m["name"], F.lit(" declares "), _bounds_said(m), F.lit(" parameters")))),
        F.transform("properties", lambda x: fact(0, x["line"], 1, x["k"], F.lit("response-property"), x["d"])),
        F.transform(script, lambda x: fact(0, x["line"], 2, x["k"], F.when(x["d"]["before"] == "await", "awaited-call").otherwise("unawaited-call"), shown(x))),
        F.transform("wrong", lambda x: fact(1, x["line"], 3, x["k"], F.lit("local-api-arity"), F.concat(x["name"], F.lit(" expects "), _bounds_said(x), F.lit(" arguments but receives "), x["n"].cast("string")))),
    )
    facts = found.select("paths", F.posexplode_outer(F.slice(F.array_sort(whole), 1, MAX_FACTS)).alias("at", "f")).where("f IS NOT NULL")
    return facts.select(F.explode("paths").alias("path"), (c("at") + 1).alias("place"), c("f.line").alias("line"), c("f.kind").alias("kind"), text.clipped(c("f.detail"), MAX_DETAIL).alias("detail"))


def _versions(base: Column, content: Column) -> Column:
    """Array of line and detail: the versions of a runtime that a file of the lower-case name ``base`` asks for."""
    row = F.split(content, r"\r?\n", -1)
    first = _trimmed(F.get(row, F.lit(0)))
    engine = _trimmed(F.coalesce(F.get_json_object(content, "$.engines.node"), F.get_json_object(content, "$.volta.node")))
    rows = F.transform(row, lambda r, at: F.struct((at + 1).cast("long").alias("line"), r.alias("row")))
    image = lambda r, group: F.regexp_extract(r, r"(?i)^\s*FROM\s+(node|python|openjdk):(\S+)", group)
    docker = F.filter(F.transform(rows, lambda x: F.struct(x["line"].alias("line"), F.when(image(x["row"], 1) != "", F.concat_ws(" ", F.lower(image(x["row"], 1)), image(x["row"], 2))).alias("detail"))), lambda v: v["detail"].isNotNull())
    asks = F.transform(rows, lambda x: F.struct(x["line"].alias("line"), F.nullif(F.regexp_extract(x["row"], r"(?i)^[ \t]*requires-python[ \t]*=[ \t]*[\"']([^\"']+)[\"']", 1), F.lit("")).alias("p")))
    project = F.transform(F.slice(F.filter(asks, lambda x: x["p"].isNotNull()), 1, 1), lambda x: F.struct(x["line"].alias("line"), F.concat(F.lit("python "), x["p"]).alias("detail")))
    single = F.when(base == "package.json", F.concat(F.lit("node "), F.nullif(engine, F.lit("")))).when(base.isin(".nvmrc", ".node-version"), F.concat(F.lit("node "), F.nullif(first, F.lit("")))).when(base == "runtime.txt", F.nullif(first, F.lit("")))
    none = F.array().cast("array<struct<line: bigint, detail: string>>")
    alone = F.filter(F.array(F.struct(F.lit(1).cast("long").alias("line"), single.alias("detail"))), lambda v: v["detail"].isNotNull())
    return F.coalesce(F.when(base == "dockerfile", docker).when(base == "pyproject.toml", project).when(base.isin(RUNTIME_FILES), alone), none)


def runtime_versions(files: DataFrame) -> DataFrame:
    """path, line, detail: versions of a runtime that a file (path, content) of the known names asks for."""
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    return files.select("path", F.explode(_versions(base, F.col("content"))).alias("v")).select("path", "v.line", "v.detail")
