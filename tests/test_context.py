"""Review context, evidence and publishing operators on small fixtures, against plain reckonings where there is one."""

import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.operators import context, corpus, diffs, evidence, publishing, reviews
from gristmill.operators.steps import numbered, ranges_of


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_names_of_code(spark):
    code = "export default async function* f1() {}\n  export abstract class C2 {}\nexport { a as b, c , default as d1, 'x' };\nexport const f1 = 1;\nexported k"
    assert set(one(spark, [(code,)], "t string", context.exported_names(F.col("t")))[0]) >= {"C2", "f1", "b", "c", "d1"}
    ruby = "def go!\n  x\nend\nattributes :name, :old?\ndef self.no\n"
    got = one(spark, [("a.rb", ruby), ("a.ts", "const fn = async (x) =>\nclass Two\nasync function three ()\n")], "p string, t string", context.changed_symbols(F.col("p"), F.col("t"), 5))
    assert got[0] == ["go!", "name", "old?"] and got[1] == ["three", "Two", "fn"]


def test_context_terms_in_order(spark):
    text = "function loadItem(a) { return fetchAll(a.Name, plain) + MAX_SIZE + word }"
    terms = one(spark, [("src/items/list.ts", text)], "p string, t string", context.context_terms(F.col("p"), F.col("t")))[0]
    assert terms[0] == "loadItem" and terms.index("fetchAll") < terms.index("plain") < terms.index("items") < terms.index("Name")
    assert "return" not in terms and "word" not in terms and "src" not in terms and "MAX_SIZE" in terms


def shown_lines(content, points, max_chars):
    lines = content.split("\n")
    valid = sorted({p for p in points if 0 < p <= len(lines)})
    anchors = (valid if len(valid) <= 8 else [valid[int(i * (len(valid) - 1) / 7 + 0.5)] for i in range(8)]) or [1]
    share, out, seen = max(80, max_chars // len(anchors)), [], set()
    for a in anchors:
        took, used = {}, 0
        for k in [a, *(a + s * d for d in range(1, 21) for s in (-1, 1))]:
            if not 1 <= k <= len(lines):
                continue
            room = share - used - len(f"{k} | ") - 1
            if room < 0:
                break
            cut = min(600, room)
            value = lines[k - 1] if len(lines[k - 1]) <= cut else lines[k - 1][:cut] + " ... (line truncated)"
            if used + len(f"{k} | {value}") + 1 > share:
                break
            took[k] = value
            used += len(f"{k} | {value}") + 1
        out += [(k, took[k]) for k in sorted(took) if k not in seen]
        seen |= set(took)
    return out if content else []


def test_head_windows_against_plain_reckoning(spark):
    rng, rows = random.Random(4), [(0, "", [1]), (1, "one line", []), (2, "x" * 2_000, [1])]
    for k in range(3, 25):
        lines = ["y" * rng.choice((0, 3, 40, 700)) for _ in range(rng.randint(1, 120))]
        rows.append((k, "\n".join(lines), [rng.randint(-2, 130) for _ in range(rng.randint(0, 14))]))
    got = context.head_windows(spark.createDataFrame(rows, "k long, content string, points array<bigint>"), 3_000).collect()
    assert {r["k"]: [(s["line"], s["text"]) for s in r["shown"]] for r in got} == {k: shown_lines(c, p, 3_000) for k, c, p in rows}


def test_fills(spark):
    items = spark.createDataFrame([("a", 1, 50), ("a", 2, 60), ("a", 3, 48), ("b", 1, 101), (None, 1, 100)], "k string, n int, size long")
    got = {(r["k"], r["n"]): r["taken"] for r in context.skip_fill(items, "k", "n", "size", 100).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("b", 1): False, (None, 1): True}
    assert context.skip_fill(items.limit(0), "k", "n", "size", 100).count() == 0


def test_slots_and_merges(spark):
    ranked = spark.createDataFrame([(1, k, k, f"src/{k}.ts") for k in range(1, 5)] + [(1, 5, 5, "tests/a.ts"), (2, 1, 1, "src/a.ts")], "query_id int, place int, chunk_id int, path string")
    got = {(r["query_id"], r["place"]): r["chunk_id"] for r in context.with_test_slot(ranked, 3).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): 5, (2, 1): 1}
    focused = spark.createDataFrame([(1, 1, 2, "src/2.ts"), (1, 2, 9, "src/9.ts")], "query_id int, place int, chunk_id int, path string")
    merged = {r["place"]: r["chunk_id"] for r in context.half_and_half(ranked.where("query_id = 1"), focused, 4).collect()}
    assert merged == {1: 1, 2: 2, 3: 5}


def test_static_evidence(spark):
    source = "\n".join([
        "async function load(a, b = 2, ...rest) {", "  // fake(1)", "  const r = await fetch('x(1)');", "  return r.body;", "}", "const add = (x, y?: number) => x", "load(); add(1, 2, 3)", "if (add(1)) { obj.add(1, 2, 3, 4) }",
    ])
    files = [("src/a.ts", source), ("a.md", "f(1)"), ("b.py", '"""g(1)"""\n# g(2)\nfunction h(a)\nh(1, 2)')]
    got = {}
    for r in evidence.static_evidence(spark.createDataFrame(files, "path string, content string")).orderBy("place").collect():
        got.setdefault(r["path"], []).append((r["line"], r["kind"], r["detail"]))
    assert (1, "declared-parameters", "load declares 1+ parameters") in got["src/a.ts"] and (6, "declared-parameters", "add declares 1-2 parameters") in got["src/a.ts"]
    assert [f for f in got["src/a.ts"] if f[1] == "local-api-arity"] == [(7, "local-api-arity", "load expects 1+ arguments but receives 0"), (7, "local-api-arity", "add expects 1-2 arguments but receives 3")]
    assert (3, "awaited-call", "fetch('    ')") in got["src/a.ts"] and not any("fake" in d for _, _, d in got["src/a.ts"])
    assert got["b.py"] == [(3, "declared-parameters", "h declares 1 parameters"), (4, "local-api-arity", "h expects 1 arguments but receives 2")] and "a.md" not in got
    assert evidence.masked("a = 'x\\'y' // z\n/* q\n r */ b", False) == "a = '    '     \n    \n      b"


def test_runtime_versions(spark):
    files = [("package.json", '{"engines": {"node": " >=20 "}}'), (".nvmrc", "v18\n"), ("x/pyproject.toml", "[p]\nrequires-python = \">=3.11\"\n"), ("Dockerfile", "# a\nFROM Python:3.12-slim\nfrom node:20\n"), ("runtime.txt", ""), ("a/package.json", "{")]
    got = {(r["path"], r["line"], r["detail"]) for r in evidence.runtime_versions(spark.createDataFrame(files, "path string, content string")).collect()}
    assert got == {("package.json", 1, "node >=20"), (".nvmrc", 1, "node v18"), ("x/pyproject.toml", 2, "python >=3.11"), ("Dockerfile", 2, "python 3.12-slim"), ("Dockerfile", 3, "node 20")}


@pytest.mark.parametrize(
    "raw, want",
    [('{"a": 1}', '{"a": 1}'), (' [1]\n', "[1]"), ("7", None), (None, None), ("", None), ('x ```json\n{"a": "}"}\n``` {"b": 1}', '{"a": "}"}'), ("``` no ``` then [1, {\"k\": \"]\"}] end", '[1, {"k": "]"}]'), ("{bad} {\"ok\": true}", '{"ok": true}'), ("{[", None)],
)
def test_extracted_json(spark, raw, want):
    got = publishing.extracted_json(spark.createDataFrame([(1, raw)], "id int, raw string")).first()
    assert got["json"] == want


def test_signatures(spark):
    for secret in (b"k", b"long " * 30):
        want = "sha256=" + hmac.new(secret, "höhe".encode(), hashlib.sha256).hexdigest()
        row = spark.createDataFrame([("höhe", want), ("höhe", want[:-1] + "x"), ("höhe", None)], "b string, h string").select(publishing.signed(F.col("b"), secret), publishing.verified_signature(F.col("b"), F.col("h"), secret)).collect()
        assert row[0][0] == want and [r[1] for r in row] == [True, want[-1] == "x", False]


def test_roots_of_long_chains_and_cycles(spark):
    links = [(k, k - 1) for k in range(1, 200)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000)]
    got = {r["id"]: r["root"] for r in reviews.roots(spark.createDataFrame(links, "id long, target long")).collect()}
    assert got == {**{k: 0 for k in range(1, 200)}, 1000: None, 1001: None, 1002: None, 1003: None}
    assert reviews.roots(spark.createDataFrame([], "id long, target long")).count() == 0


def test_places_without_one_task_a_key(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", None]), k) for k in rng.sample(range(10_000), 500)]
    given = spark.createDataFrame(rows, "by string, n long")
    got = {(r["by"], r["n"]): r["place"] for r in numbered(given, "by", ranges_of(given, "n", 16), ["n"], "place").collect()}
    for by in ("a", None):
        assert [got[by, n] for n in sorted(n for b, n in rows if b == by)] == list(range(1, sum(b == by for b, _ in rows) + 1))
    assert corpus.batches(given.limit(0), 4, "by", "n").count() == 0


def test_numbered_hunks_and_allowed_lines(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n-old\n+new\n keep\n\\ No newline\ndiff --git a/y b/y\ndeleted file mode 100644\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"
    given = spark.createDataFrame([(1, text)], "diff_id int, text string")
    got = {r["file"]: r["text"] for r in diffs.numbered_hunks(given).collect()}
    assert got == {1: "@@ -1,2 +1,2 @@\n    1 - old\n    1 + new\n    2   keep", 2: "@@ -1 +0,0 @@\n    1 - gone"}
    assert diffs.numbered_hunks(given, 27).where("file = 1").first()["text"] == "@@ -1,2 +1,2 @@\n... (truncated)"
    allowed = {r["file"]: (r["lines"], r["body_only"]) for r in diffs.allowed_lines(diffs.diff_lines(given), diffs.diff_files(given)).collect()}
    assert allowed == {1: ([1], False), 2: ([1], True)}


def masked_by_steps(source, hashed):
    """A plain reckoning, one character at a time."""
    out, mode, quote, k = "", "code", "", 0
    blank = lambda c: c if c in "\r\n" else " "
    begins = lambda at: at == 0 or source[at - 1] in "\r\n"
    while k < len(source):
        c, two = source[k], source[k : k + 2]
        if mode == "code":
            line = re.split(r"[\r\n]", out)[-1].rstrip()
            word = re.search(r"[A-Za-z_$][\w$]*$", line)
            if hashed and begins(k) and re.match(r"=begin([\r\n]|$)", source[k:].split("\n")[0] + "\n"):
                mode, step = "ruby", 6
            elif two in ("//", "/*"):
                mode, step = {"//": "line", "/*": "block"}[two], 2
            elif hashed and c == "#":
                mode, step = "line", 1
            elif hashed and c in "\"'" and source[k : k + 3] == c * 3:
                mode, quote, step = "triple", c * 3, 3
            elif c in "\"'`":
                mode, quote, out, k = "quote", c, out + c, k + 1
                continue
            elif c == "/" and (not line or line.endswith("=>") or line[-1] in "=(:,!&|?{}[;]~" or (word and word.group() in "return throw case delete void typeof instanceof in of".split())):
                mode, step = "pattern", 1
            else:
                out, k = out + c, k + 1
                continue
            out, k = out + " " * step, k + step
        elif mode == "line":
            if c in "\r\n":
                mode = "code"
            out, k = out + blank(c), k + 1
        elif mode == "block" and two == "*/":
            mode, out, k = "code", out + "  ", k + 2
        elif mode == "triple" and source.startswith(quote, k):
            mode, out, k = "code", out + "   ", k + 3
        elif mode == "ruby" and begins(k) and re.match(r"=end([\r\n]|$)", source[k:].split("\n")[0] + "\n"):
            mode, out, k = "code", out + "    ", k + 4
        elif mode in ("quote", "pattern", "class") and c == "\\":
            out, k = out + " " + "".join(map(blank, source[k + 1 : k + 2])), k + 2
        elif mode == "quote" and c == quote:
            mode, out, k = "code", out + c, k + 1
        else:
            mode = {("pattern", "["): "class", ("class", "]"): "pattern", ("pattern", "/"): "code"}.get((mode, c), mode)
            out, k = out + blank(c), k + 1
    return out


def test_masks_of_random_sources():
    rng = random.Random(3)
    bits = ["/", "//", "/*", "*/", "'", '"', "`", "\\", "\n", "\r\n", " ", "a", "return", "=", "=>", "[", "]", "#", "=begin", "=end", '"""', "'''", "x(", ")", ",", "8"]
    for _ in range(6_000):
        source = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        for hashed in (False, True):
            assert evidence.masked(source, hashed) == masked_by_steps(source, hashed), repr(source)


def test_static_evidence_of_patterns_brackets_and_runtimes(spark):
    source = "\n".join(["s = s.replace(/'/g, x)", "const f = (a: Map<string, Map<number, [string, number]>>, b = { c: [1, { d: [2, 3] }] }) => a", 'use(body["name"], res.ok)', "f([[1, [2, {a: [3, 4]}]], 5], 6, 7)", "n = a / b", "late(1)"])
    files = [("src/a.ts", source), (".nvmrc", "v18\n"), ("Dockerfile", "FROM node:20\n" * 50), ("n.ts", None), ("e.ts", "")]
    got = {}
    for r in evidence.static_evidence(spark.createDataFrame(files, "path string, content string")).orderBy("path", "place").collect():
        got.setdefault(r["path"], []).append((r["line"], r["kind"], r["detail"]))
    assert got["src/a.ts"] == [
        (2, "declared-parameters", "f declares 1-2 parameters"), (3, "response-property", "res.ok"), (3, "response-property", 'body["    "]'), (3, "unawaited-call", 'use(body["    "], res.ok)'),
        (4, "unawaited-call", "f([[1, [2, {a: [3, 4]}]], 5], 6, 7)"), (6, "unawaited-call", "late(1)"), (4, "local-api-arity", "f expects 1-2 arguments but receives 3"),
    ]
    assert got[".nvmrc"] == [(1, "runtime-version", "node v18")] and len(got["Dockerfile"]) == 40 and "n.ts" not in got and "e.ts" not in got
    assert evidence.listed("a, [b, [c, {d: (e, f)}]], g<h, i>, j", False) == ["a", "[b, [c, {d: (e, f)}]]", "g<h", "i>", "j"]
    assert evidence.listed("a: M<b, N<c, d>>, e = f < g, h", True) == ["a: M<b, N<c, d>>", "e = f < g", "h"] and evidence.listed("a,,b,", True) == ["a", "", "b"] and evidence.listed(" ", True) == []


def code_like_by_patterns(term, changed):
    t = re.escape(term)
    marks = r"(?=\s*[.$({\[=,:;)]|\Z)"
    return bool(re.search("[A-Z_$]", term) or re.search(rf"\.{t}\b", changed, re.A) or re.search(rf"[.$({{\[]\s*{t}{marks}", changed, re.A) or re.search(rf"\b{t}{marks}", changed, re.A) or re.search(rf"`[^`]*\b{t}\b`", changed, re.A))


def test_names_used_as_code(spark):
    rng = random.Random(8)
    bits = ["foo", "bar", "Foo", "x1", "a_b", ".", " ", "`", "(", ")", "=", "\n", "$", "9", ",", "é", "?"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))),) for _ in range(1_500)]
    terms = ["foo", "bar", "Foo", "x1", "a_b", "foobar"]
    given = spark.createDataFrame(rows, "changed string")
    names = F.array(*map(F.lit, terms))
    got = given.select("changed", context.code_like(names, context.used_as_code(F.col("changed"))).alias("code")).collect()
    for r in got:
        for t in terms:
            assert (t in r["code"]) == code_like_by_patterns(t, r["changed"]), (t, r["changed"])


def test_whole_words_without_patterns_made_of_columns(spark):
    rng = random.Random(9)
    bits = ["foo", "Bar", "a.b", "-", " ", "\n", "$", "_", "9", "é", "."]
    terms = ["foo", "bar", "a.b", "foo-bar", "$", "é", "x"]
    chunks = [(1, k, k, f"p{k}/{rng.choice(bits)}.ts", "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for k in range(400)]
    wanted = spark.createDataFrame([(1, terms, "src/bar.ts")], "query_id int, terms array<string>, changed_path string")
    found = context.relevant_chunks(spark.createDataFrame(chunks, "query_id int, ordinal int, chunk_id int, path string, content string"), wanted, limit=1_000)
    known = [t for t in dict.fromkeys(terms) if len(t) >= 2 and t not in context.CONTEXT_KEYWORDS]
    says = lambda hay, t: bool(re.search(rf"(?:^|[^a-z0-9_$]){re.escape(t)}(?:\Z|[^a-z0-9_$])", hay.lower()))
    want = {}
    for _, _, c, path, content in chunks:
        score = sum((2.0 if i < 3 else 1.0) for i, t in enumerate(known) if says(f"{path}\n{content}", t)) + (0.25 if says(path, "bar") else 0)
        if score > 0:
            want[c] = score
    got = {r["chunk_id"]: r["score"] for r in found.collect()}
    assert [(chunks[c][3:], got.get(c), want.get(c)) for c in range(400) if got.get(c) != want.get(c)] == []


def test_fills_of_large_keys_walk_only_parts_where_something_fits(spark):
    rng = random.Random(2)
    items = [(k, n, rng.choice((1, 5, 30, 80, 200, None)) if k != "b" else 90) for k in ("a", "b", None) for n in range(700)] + [("c", n, 40) for n in range(9)]
    want, used = {}, {}
    for k, n, size in items:
        spent = used.get(k, 3)
        want[k, n] = size is not None and spent + size <= 500
        used[k] = spent + (size + 2 if want[k, n] else 0)
    rng.shuffle(items)
    given = spark.createDataFrame(items, "k string, n int, size long").withColumn("part", F.lit("x"))
    for part in (50, 10_000):
        got = context.skip_fill(given, "k", "n", "size", 500, base=3, part_items=part)
        assert set(got.columns) == {"k", "n", "size", "part", "taken"}
        assert {(r["k"], r["n"]): r["taken"] for r in got.collect()} == want
