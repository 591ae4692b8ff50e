from gristmill.operators import corpus, diffs

DIFF = """diff --git a/src/a.ts b/src/a.ts
index 1..2 100644
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,3 +1,4 @@ head
 one
-two
+TWO
+--- not a header
 three
\\ No newline at end of file
@@ -10 +11 @@
-old
+new
diff --git a/new.txt b/new.txt
new file mode 100644
--- /dev/null
+++ b/new.txt
@@ -0,0 +1,2 @@
+x
+y
diff --git a/gone.txt b/gone.txt
deleted file mode 100644
--- a/gone.txt
+++ /dev/null
@@ -1 +0,0 @@
-z
diff --git a/p.png b/p.png
Binary files a/p.png and b/p.png differ
diff --git a/was.ts b/is.ts
similarity index 100%
rename from was.ts
rename to is.ts"""


def test_uniform_lines_fall_into_windows():
    found = [(a, b) for a, b, _ in corpus.chunk_text("\n".join("  x" for _ in range(300)), "typescript")]
    assert found[0] == (1, 80) and found[1] == (73, 152) and found[-1][1] == 300


def test_definitions_stay_with_their_comment():
    body = ["import x"] * 50 + ["", "// about f", "function f() {"] + ["  y"] * 60 + ["}"]
    spans = [(a, b) for a, b, _ in corpus.chunk_text("\n".join(body), "typescript")]
    assert spans == [(1, 51), (52, len(body))]


def test_long_lines_stand_alone():
    spans = [(a, b, len(c)) for a, b, c in corpus.chunk_text("a\n" + "b" * 7000 + "\nc", None)]
    assert spans == [(1, 1, 1), (2, 2, 6000), (3, 3, 1)]


def test_blank_text_has_no_chunk():
    assert list(corpus.chunk_text(" \n\t\n", "python")) == []


def test_every_line_is_covered():
    body = "\n".join(f"line {k} " + "w" * (k * 37 % 200) for k in range(500))
    covered = {k for a, b, _ in corpus.chunk_text(body, None) for k in range(a, b + 1)}
    assert covered == set(range(1, 501))


def test_diff(spark):
    given = spark.createDataFrame([(1, DIFF)], "diff_id long, text string")
    files = {r["file"]: r for r in diffs.diff_files(given).collect()}
    assert [(files[k]["old_path"], files[k]["new_path"], files[k]["status"]) for k in sorted(files)] == [
        ("src/a.ts", "src/a.ts", "modified"), (None, "new.txt", "added"), ("gone.txt", None, "deleted"), ("p.png", "p.png", "modified"), ("was.ts", "is.ts", "renamed"),
    ]
    assert files[4]["binary"] and not files[1]["binary"]
    lines = [(r["file"], r["hunk"], r["type"], r["old_line"], r["new_line"], r["content"]) for r in diffs.diff_lines(given).orderBy("at").collect()]
    assert lines[:5] == [(1, 1, "ctx", 1, 1, "one"), (1, 1, "del", 2, None, "two"), (1, 1, "add", None, 2, "TWO"), (1, 1, "add", None, 3, "--- not a header"), (1, 1, "ctx", 3, 4, "three")]
    assert lines[5:] == [(1, 2, "del", 10, None, "old"), (1, 2, "add", None, 11, "new"), (2, 1, "add", None, 1, "x"), (2, 1, "add", None, 2, "y"), (3, 1, "del", 1, None, "z")]
    sets = {r["file"]: (r["added"], r["commentable"]) for r in diffs.commentable(diffs.diff_lines(given)).collect()}
    assert sets[1] == ([2, 3, 11], [1, 2, 3, 4, 11])


def test_diff_without_git_headers(spark):
    given = spark.createDataFrame([(1, "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b"), (2, ""), (3, None)], "diff_id long, text string")
    assert [(r["diff_id"], r["old_path"], r["new_path"]) for r in diffs.diff_files(given).collect()] == [(1, "x", "x")]
    assert diffs.diff_lines(given).count() == 2


def test_risk_orders_hunks(spark):
    body = "diff --git a/a.ts b/a.ts\n--- a/a.ts\n+++ b/a.ts\n@@ -1 +1 @@\n-a\n+b\n@@ -9 +9 @@\n-x\n+check(password)"
    given = spark.createDataFrame([(1, body)], "diff_id long, text string")
    found = diffs.hunk_risks(diffs.diff_lines(given), diffs.diff_files(given)).orderBy("rank").collect()
    assert [(r["hunk"], r["score"], r["signals"]) for r in found] == [(2, 4, ["security"]), (1, 1, ["execution"])]


def test_tree_listing(spark):
    raw = "\0".join([f"100644 blob {'a' * 40}      12\tsrc/a b.ts", f"120000 blob {'b' * 40}       3\tlink", f"160000 commit {'c' * 40}       -\tsub", "junk"]) + "\0"
    found = corpus.tree_entries(spark.createDataFrame([("r", raw)], "repo_id string, raw string")).collect()
    assert [(r["path"], r["size"]) for r in found] == [("src/a b.ts", 12)]


def test_table_functions_in_sql(spark):
    from gristmill.operators import table_functions

    table_functions.register(spark)
    code = "\n".join(["# head", "x", "", "def a():", "  1", "", "# note", "def b():", "  2", "", "", "def c():", "  3"])
    spark.createDataFrame([(1, code), (2, None), (3, " \n"), (4, "one"), (5, "\n".join(["l" * 9] * 5 + ["w" * 40, "", "z"]))], "id int, content string").createOrReplaceTempView("given")
    spans = lambda call: {(r["id"], r["start_line"], r["end_line"]) for r in spark.sql(f"SELECT id, s.* FROM given, LATERAL {call} AS s").collect()}
    assert spans("merged_segments(content, 'python', 6)") == {(1, 1, 6), (1, 7, 11), (1, 12, 13), (4, 1, 1), (5, 1, 8)}
    assert {s for s in spans("merged_segments(content, 'python', 3)") if s[0] == 1} == {(1, 1, 3), (1, 4, 6), (1, 7, 11), (1, 12, 13)}
    assert {s for s in spans("char_parts(content, 30)") if s[0] > 3} == {(4, 1, 1), (5, 1, 3), (5, 4, 5), (5, 6, 6), (5, 7, 8)}
