"""Operators on inputs where keys hold many rows: what is shuffled grows with the input, and rows equal plain reckonings."""

import random
import re
import unicodedata

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.llm import line_dedup, quality
from gristmill.operators import context, corpus, evidence, imports, publishing, search, wordsearch
from gristmill.plans import records as record_plans
from gristmill.plans import registry
from gristmill.sources import tables


def shuffled(spark, build):
    """Rows of ``build()``, and how many records its stages wrote to be shuffled."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    rows = build().collect()
    return rows, sum(n for stage, n in written().items() if stage not in before)


def test_symbol_mentions_meet_few_files_of_a_word(spark):
    rng = random.Random(3)
    names = ["load", "Save", "go"]
    files = [(1, f"{'tests/t' if k % 9 == 0 else 'src/f'}{k // 2}.ts", k, "\n".join(rng.choice(["", "load(", "x save", "GO go"]) for _ in range(3))) for k in range(400)]
    changes = [(1, f[1], "\n".join(f"function {n}()" for n in rng.sample(names, 2))) for f in files[::2]]
    build = lambda: context.symbol_mentions(spark.createDataFrame(files, "pull_id int, path string, ordinal int, content string"), spark.createDataFrame(changes, "pull_id int, path string, text string"))
    rows, records = shuffled(spark, build)
    said = {}
    for _, path, text in changes:
        said.setdefault(path, set()).update(line.split()[1][:-2].lower() for line in text.split("\n"))
    want = set()
    for path, words in said.items():
        met = []
        for _, other, ordinal, content in files:
            at = [i for i, line in enumerate(content.split("\n"), 1) if words & set(line.lower().replace("(", " ").split())]
            if at and other != path:
                met.append((not other.startswith("tests/"), ordinal, other, tuple(at)))
        want |= {(path, m[2], m[3], place) for place, m in enumerate(sorted(met)[:2], 1)}
    assert {(r["path"], r["other"], tuple(r["lines"]), r["place"]) for r in rows} == want and len(rows) == len(want)
    assert records < 12 * (len(files) + len(changes))


def test_export_mentions_shuffle_no_pairs(spark):
    files = [(1, f"f{k % 290}", f"export const a{k % 3} = 1;\nexport {{ x as b{k % 2} }}") for k in range(300)]
    changes = [(1, f"f{k % 290}", f"a{k % 3} b0 b1 export") for k in range(300)]
    build = lambda: context.export_mentions(spark.createDataFrame(files, "pull_id int, path string, content string"), spark.createDataFrame(changes, "pull_id int, path string, text string"))
    rows, records = shuffled(spark, build)
    exported, said = {}, {}
    for k in range(300):
        exported.setdefault(f"f{k % 290}", set()).update((f"a{k % 3}", f"b{k % 2}"))
        said.setdefault(f"f{k % 290}", set()).update((f"a{k % 3}", "b0", "b1"))
    want = {(p, o) for p in said for o in exported if p != o and said[p] & exported[o]}
    assert sorted((r["path"], r["other"]) for r in rows) == sorted(want)
    assert records < 10 * (len(files) + len(changes)) < len(want)


def test_export_mentions_deal_out_the_pairs_of_one_name(spark, monkeypatch):
    monkeypatch.setattr(context, "SAID_PART", 15, raising=False)
    monkeypatch.setattr(context, "EXPORTED_PART", 4, raising=False)
    rng = random.Random(4)
    some = lambda: rng.sample(["b", "c", "d", "e"], rng.choice((0, 0, 0, 1, 2)))
    files = [(rng.choice((1, 1, 1, 2, None)), rng.choice([*(f"f{k % 280}" for _ in range(9)), None]), ["a", *some()] if k % 3 else some()) for k in range(300)]
    changes = [(p, f, ["a", *some()]) for p, f, _ in files]
    found = context.export_mentions(
        spark.createDataFrame([(p, f, "\n".join(f"export const {n} = 1" for n in names)) for p, f, names in files], "pull_id int, path string, content string"),
        spark.createDataFrame([(p, f, " ".join(names)) for p, f, names in changes], "pull_id int, path string, text string"),
    )
    rows = found.select("pull_id", "path", "other", F.spark_partition_id().alias("task")).collect()
    want, exported, said = set(), {}, {}
    for held, given in ((exported, files), (said, changes)):
        for p, f, names in given:
            held.setdefault((p, f), set()).update(names)
    want = {(p, f, o) for p, f in said for q, o in exported if None not in (p, f, o) and p == q and f != o and said[p, f] & exported[q, o]}
    assert sorted(tuple(r)[:3] for r in rows) == sorted(want)
    # nearly all share one name: no task makes most of their pairs
    assert max(sum(r["task"] == t for r in rows) for t in {r["task"] for r in rows}) < len(rows) / 3


def test_history_joins_the_first_findings_alone(spark):
    touched = [(r, 1, "a", 99, "o/r") for r in range(60)]
    findings = [(7, n, "a", f"t{n}") for n in range(500)]
    found = publishing.history(
        spark.createDataFrame(touched, "review_id int, place int, path string, own_pull int, repo string"), spark.createDataFrame([("a", 1, "s")], "path string, turn int, sha string"),
        spark.createDataFrame([("s", 1, 7, "O/R", True)], "sha string, turn int, pull int, repo string, merged boolean"), spark.createDataFrame(findings, "pull int, ordinal int, path string, title string"),
    )
    assert sorted((r["review_id"], r["path"], r["pull"], r["ordinal"], r["title"]) for r in found.collect()) == [(r, "a", 7, n, f"t{n}") for r in range(60) for n in range(8)]
    # findings are ranked by pull and path before any review comes to them
    assert not re.search(r"Window \[row_number\(\)[^\n]*\[review_id#\d+, path#\d+, pull#\d+\]", found._jdf.queryExecution().optimizedPlan().toString())


def test_history_is_asked_within_a_review(spark):
    rng = random.Random(6)
    paths = [f"p{k}" for k in range(14)]
    touched = [(r, place, path, r or 0, "O/r" if (r or 0) % 2 else "x/Y") for r in [None, *range(150)] for place, path in enumerate(rng.sample(paths, rng.randint(1, 11)), 1)]
    commits = [(path, turn, f"s{rng.randint(0, 20)}") for path in paths for turn in range(1, 6)]
    pulls = [(f"s{k}", turn, rng.randint(0, 12), rng.choice(["o/R", "X/y"]), rng.random() < 0.8) for k in range(21) for turn in (1, 2)]
    findings = [(rng.randint(0, 12), n, rng.choice(paths), f"t{n}") for n in range(600)]
    frame = lambda rows, names, types: spark.createDataFrame(rows, ", ".join(map(" ".join, zip(names.split(), types.split(), strict=True))))
    given = [
        frame(touched, "review_id place path own_pull repo", "int int string int string").repartition(3, "review_id"), F.broadcast(frame(commits, "path turn sha", "string int string")),
        F.broadcast(frame(pulls, "sha turn pull repo merged", "string int int string boolean")), frame(findings, "pull ordinal path title", "int int string string"),
    ]
    rows, records = shuffled(spark, lambda: publishing.history(*given))
    want = []
    for review in range(150):
        seen = [(place, turn, path, sha, own, repo) for r, place, path, own, repo in touched if r == review and place <= 8 for p, turn, sha in commits if p == path and turn <= 3]
        looked = list(dict.fromkeys(x[3] for x in sorted(seen)))[:12]
        held = [(looked.index(sha), t, pull, path) for _, _, path, sha, own, repo in seen if sha in looked for s, t, pull, other, merged in pulls if s == sha and merged and pull != own and other.lower() == repo.lower()]
        taken = list(dict.fromkeys(x[2] for x in sorted(held)))[:3]
        for path, pull in {(x[3], x[2]) for x in held if x[2] in taken}:
            want += [(review, path, pull, n, t) for n, t in sorted((n, t) for q, n, p, t in findings if (q, p) == (pull, path))[:8]]
    assert sorted((r["review_id"], r["path"], r["pull"], r["ordinal"], r["title"]) for r in rows) == sorted(want) and len(want) > 1_000
    # the touched paths, the findings, and what is found of them are dealt out once each
    assert records < 3 * (len(touched) + len(findings))


def test_formats_of_large_ids(spark, tmp_path):
    pq.write_table(pa.table({"event_id": pa.array([3, 6_000_000, 36_000_000], pa.int64()), "value": [0.5, 20_000.0, 5.0]}), str(tmp_path / "events.parquet"))
    got = {r["event_id"]: (r["usd"], r["ago"]) for r in registry.QUERIES["o198_formats"](spark, str(tmp_path)).collect()}
    assert got == {3: ("<$0.0001", "1m ago"), 6_000_000: ("$2.00", f"{6_000_000**2 * 7 // 31_536_000}y ago"), 36_000_000: ("$0.0005", f"{36_000_000**2 * 7 // 31_536_000}y ago")}


def test_similarity_searches_with_every_query(spark, sf_dir):
    got = {tuple(r) for r in registry.QUERIES["o185_vector_similarity"](spark, sf_dir).select("query_id", "chunk_id", "rank", "score").collect()}
    assert got == {tuple(r) for r in registry.QUERIES["o141_nearest"](spark, sf_dir).select("query_id", "chunk_id", "rank", "score").collect()} and len({r[0] for r in got}) > 1


def test_distinct_candidates_are_those_of_the_calls(spark, sf_dir):
    found = registry.QUERIES["o165_distinct_candidates"](spark, sf_dir)
    assert sorted(found.columns) == ["ids", "model", "provider"] and found.count() == registry.QUERIES["o195_candidate_models"](spark, sf_dir).count() > 1


def test_static_evidence_is_told_within_a_file(spark):
    content = "function g(a, b = 1) {\n// h(1)\nawait g(1, 2, 3)"
    files = [(f"src/{k}.ts", content) for k in range(50)] + [("x/Dockerfile", "FROM node:20\n"), ("none.txt", content), ("src/null.ts", None)]
    rows, records = shuffled(spark, lambda: evidence.static_evidence(spark.createDataFrame(files, "path string, content string")))
    want = [(1, 1, "declared-parameters", "g declares 1-2 parameters"), (2, 3, "awaited-call", "g(1, 2, 3)"), (3, 3, "local-api-arity", "g expects 1-2 arguments but receives 3")]
    assert sorted(tuple(r) for r in rows) == sorted([(f"src/{k}.ts", *w) for k in range(50) for w in want] + [("x/Dockerfile", 1, 1, "runtime-version", "node 20")])
    assert records == 0


def test_static_evidence_reads_texts_to_their_ends(spark):
    blank, many = "\n" * 70_000, "".join(f"function f{k}(a) {{}}\n" for k in range(20_000))
    files = [
        ("src/late.ts", f"{blank}function g(a, b) {{}}\ng(1)"), ("src/quoted.py", f"# {'x' * 70_000}\nh('{' ' * 500_000}', 2)\nfunction h(a)"), ("x/Dockerfile", f"{'# y' * 30_000}\nFROM node:20"),
        ("a/package.json", f'{{"x": "{"y" * 70_000}", "engines": {{"node": "22"}}}}'), ("src/many.py", many.replace("(a)", "()", 1) + "f19999(1)\n" * 20_000 + "f0(1)"),
    ]
    got = {}
    for r in evidence.static_evidence(spark.createDataFrame(files, "path string, content string")).orderBy("path", "place").collect():
        got.setdefault(r["path"], []).append((r["line"], r["kind"], r["detail"]))
    assert got["src/late.ts"] == [(70_001, "declared-parameters", "g declares 2 parameters"), (70_002, "unawaited-call", "g(1)"), (70_002, "local-api-arity", "g expects 2 arguments but receives 1")]
    assert got["src/quoted.py"] == [(3, "declared-parameters", "h declares 1 parameters"), (2, "local-api-arity", "h expects 1 arguments but receives 2")]
    assert got["x/Dockerfile"] == [(2, "runtime-version", "node 20")] and got["a/package.json"] == [(1, "runtime-version", "node 22")]
    assert got["src/many.py"] == [(k + 1, "declared-parameters", f"f{k} declares {min(k, 1)} parameters") for k in range(40)]


def test_compact_context_is_dealt_out_by_review_once(spark):
    findings = [(r, f"f{k}", k, f"loadName{k}", "b") for r in range(3) for k in range(20)]
    shown = [(r, f"f{k}", p, n, n, f"loadName{k} x") for r in range(3) for k in range(20) for n, p in enumerate([f"f{k}", "lib/a", "lib/b"], 1)]
    build = lambda: context.compact_context(spark.createDataFrame(findings, "review_id int, path string, line int, title string, body string"), spark.createDataFrame(shown, "review_id int, file string, path string, ordinal int, line int, text string"), 60)
    rows, records = shuffled(spark, build)
    assert {(r["file"], r["path"]) for r in rows} == {(f"f{k}", p) for k in range(20) for p in (f"f{k}", "lib/a", "lib/b") if p != f"f{k}" or k <= 11}
    assert records < 3 * (len(findings) + len(shown))


def test_findings_are_dealt_out_by_their_number(spark, sf_dir, monkeypatch):
    whole = {tuple(r) for r in tables.FINDINGS.frame(spark, sf_dir).collect()}
    monkeypatch.setattr(tables, "PART_ROWS", 100)
    dealt = tables.FINDINGS.frame(spark, sf_dir)
    n = tables.table(spark, sf_dir, "lineitem").count()
    assert dealt.rdd.getNumPartitions() == -(-n // 100) > tables.FEW_PARTS and {tuple(r) for r in dealt.collect()} == whole


def test_words_are_searched_without_shuffling_postings(spark, tmp_path):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "eps_1", "größe", "x\u0301y", "\u2167", "4", "\u212a"]
    rows = [(k, f"r{k % 3}", f"src/{rng.choice(words)}{k}.ts", " ".join(rng.choices(words, k=k % 40))) for k in range(900)] + [(k, "r", "same/path.py", "alpha beta beta") for k in range(2_000, 2_400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, repo_id string, path string, content string")
    queries = spark.createDataFrame([(q, " ".join(rng.choices(words, k=3))) for q in range(12)] + [(50, "alpha beta same path"), (51, "nowhere"), (52, None), (53, "k")], "query_id long, query string")
    found = wordsearch.WordSearch(spark, f"file://{tmp_path}/w", queries)
    assert not found.exists() and found.build(chunks).exists()
    got, records = shuffled(spark, lambda: found.top(20))
    want = search.lexical_top(chunks, queries, 20).collect()
    keyed = lambda rows: {(r["query_id"], r["rank"]): (r["chunk_id"], r["repo_id"], round(r["score"], 9)) for r in rows}
    assert keyed(got) == keyed(want) and len(got) == len(want) >= 200
    assert records < 20 * 16 * 5 < len(rows) * 5
    sums = found.parts(found.top(20)).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("s")).collect()
    assert {(r["query_id"], r["chunk_id"]): round(r["s"], 6) for r in sums} == {(r["query_id"], r["chunk_id"]): round(r["score"], 6) for r in want}
    none = wordsearch.WordSearch(spark, f"file://{tmp_path}/n", queries).build(chunks.limit(0))
    assert none.top(5).count() == 0


def test_words_are_cut_as_in_the_index(spark):
    every = [c for c in map(chr, range(0x110000)) if c.isalnum() != (unicodedata.category(c)[0] in "LN")]
    assert every == []
    texts = ["Größe İx ΑΣ a_b-c  \u0660\u2167x\u00b2 \u0e01\u0e34 日本 e\u0301", "", "  "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.index_tokens(F.col("t")).alias("k")).collect()
    assert [wordsearch._tokens(r["t"]) for r in rows] == [r["k"] for r in rows]


def test_imports_are_resolved_once_and_by_few_rows(spark):
    files = [(f"src/m{k}{['.ts', '/index.ts', '.mjs', ''][k % 4]}", f"import './m{k - 1}{['', '.js'][k % 2]}'\nimport './m{(k * 7) % 40}'") for k in range(400)]
    graph = lambda: imports.edges(spark.createDataFrame(files, "path string, content string"))
    rows, records = shuffled(spark, graph)
    at = {f: f for f, _ in files}
    want = {(f, s, next((b + x for b in (base, re.sub(imports.STRIPPED, "", base)) for x in imports.SUFFIXES if b + x in at), None)) for f, c in files for s in re.findall("'([^']+)'", c) for base in [f"{f.rsplit('/', 1)[0]}/{s[2:]}"]}
    assert {tuple(r) for r in rows} == {w for w in want if w[2]} and len(rows) > 300
    assert records < 12 * len(files)
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    changed = spark.createDataFrame([("src/m0.ts",)], "path string")
    found = imports.dependants(graph().mapInArrow(seen, "from_path string, specifier string, to_path string"), changed, depth=6)
    assert found.count() > 5 and calls.value == len(rows)


def test_identifiers_are_counted_where_their_text_lies(spark):
    docs = [(k, " ".join(["go", "load_it", "Return", "x9", "abc"][(k * j) % 5] + ("" if j % 3 else str(j % 4)) for j in range(60))) for k in range(50)] + [(99, None), (100, "")]
    rows, records = shuffled(spark, lambda: corpus.top_identifiers(spark.createDataFrame(docs, "doc_id long, text string"), 4))
    want = set()
    for k, body in docs[:50]:
        words = [w for w in re.findall(text.IDENTIFIER, body) if len(w) >= 3 and w.lower() not in text.KEYWORDS]
        best = sorted(set(words), key=lambda w: (-words.count(w), words.index(w)))[:4]
        want |= {(k, w, words.count(w), n) for n, w in enumerate(best, 1)}
    assert {(r["doc_id"], r["word"], r["n"], r["rank"]) for r in rows} == want and len(rows) == len(want)
    assert records == 0


def test_followups_are_dealt_out_by_review_once(spark):
    rng = random.Random(8)
    one = lambda: (rng.choice(["a", "b", None]), rng.choice(["t1", "t2", None]), rng.choice(["c1", "c2", "", None]))
    previous = [(r, k, *one()) for r in range(30) for k in range(6)] + [(3, 2, *one()), (None, 1, "a", "t1", "c1")]
    current = [(r, k, *one()) for r in range(32) for k in range(5)] + [(4, 1, *one())]
    decisions = [(r, k, rng.choice(["remaining", "remaining", "resolved", "retracted", "odd", None]), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["new", "old"]), rng.choice(["a", "b", None]), rng.randrange(3)) for r in range(1, 31) for k in range(6)] + [(5, 3, "resolved", None, "new", "a", 1)]
    delta = [(r, rng.choice(["new", "old"]), rng.choice(["a", "b", None]), rng.randrange(3)) for r in range(30) for _ in range(4)]
    head = [(r, rng.choice(["a", "b"]), rng.randrange(3)) for r in range(30) for _ in range(3)]
    fault = "review_id int, id int, path string, title string, root_cause string"
    given = [(previous, fault), (current, fault), (decisions, "review_id int, id int, status string, finding_index long, side string, path string, line int"), (delta, "review_id int, side string, path string, line int"), (head, "review_id int, path string, line int")]
    rows, records = shuffled(spark, lambda: publishing.reconciled(*[spark.createDataFrame(*g) for g in given]))
    want, used = [], set()
    for r, k, status, index, side, path, line in sorted(decisions, key=lambda d: d[:2]):
        matches = {q[1] for p in previous for q in current if p[:2] == (r, k) and q[0] == r and p[2] == q[2] is not None and (p[3] == q[3] is not None or (p[4] and p[4] == q[4]))}
        stays, cited = status == "remaining", path is not None and (r, side, path, line) in delta
        shown = path is not None and side == "new" and (r, path, line) in head
        rules = [
            (sum(d[:2] == (r, k) for d in decisions) > 1, "id"), (status not in ("remaining", "resolved", "retracted", None), "status"), (stays and index is None, "no finding"), (stays and index not in matches, "no match"),
            (status not in ("remaining", None) and bool(matches), "match remains"), (status == "resolved" and not cited, "not in delta"), (status not in ("resolved", None) and not shown, "not in head"),
            (stays and (r, index) in used, "finding used twice"), (status not in ("remaining", None) and index is not None, "finding named"),
        ]
        used |= {(r, index)} if stays else set()
        want.append((r, k, status, index, next((e for broken, e in rules if broken), None)))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr) and {w[4] for w in want} >= {None, "id", "status", "no finding", "no match", "match remains", "not in delta", "not in head"}
    assert records <= sum(len(g[0]) for g in given)


def test_masked_facts_are_dealt_out_by_their_number(spark, sf_dir, monkeypatch):
    build = registry.QUERIES["o225_masked_facts"]
    whole = sorted(map(tuple, build(spark, sf_dir).collect()))
    monkeypatch.setattr(record_plans, "TASK_SOURCES", 100)
    dealt, n = build(spark, sf_dir), tables.table(spark, sf_dir, "orders").count()
    assert dealt.rdd.getNumPartitions() == -(-n // 100) > 8 and sorted(map(tuple, dealt.collect())) == whole


def test_lines_without_a_copy_are_dealt_out_once(spark):
    """All lines are dealt out to find copies; only those of marked classes are, to be judged."""
    docs = [(d, "\n".join(f"d{d} l{k} x" if k else "the same line" for k in range(20))) for d in range(200)] + [(200, None), (7, "\n".join(f"d7 l{k} x" if k else "the same line" for k in range(20))), (None, "the same line\nlone one")]
    rows, records = shuffled(spark, lambda: line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in rows}
    assert got == {d: (20, 1, [0]) for d in range(200)} | {200: (1, 0, []), None: (2, 0, [])} and len(rows) == 202
    assert records < 2 * 20 * len(docs)


def test_words_of_lines_with_odd_blanks(spark):
    marks = [" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x85", "\u2028", "\xa0", "a", "é", "b c"]
    texts = ["", *marks, *[x + y for x in marks for y in marks], *[x + y + z for x in marks for y in marks for z in ("a", " ", "\n")]]
    got = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", quality.words_of(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got] == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts] + [None]
