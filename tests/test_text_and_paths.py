import pytest
from pyspark.sql import functions as F

from gristmill.functions import paths, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "question, tokens",
    [
        ("how does getUserById work?", ["getuserbyid", "get", "user", "by", "id"]),
        ("where is user_id set", ["user_id", "user", "id", "set"]),
        ("parse the HTTPServer", ["parse", "httpserver", "http", "server"]),
        ("what is the", []),
        ("?! ...", []),
        ("token Token TOKEN x", ["token"]),
    ],
)
def test_query_tokens(spark, question, tokens):
    assert one(spark, text.query_tokens(F.lit(question))) == tokens


def test_match_expression(spark):
    assert one(spark, text.match_expression(F.array(F.lit("a"), F.lit('b"c')))) == '"a" OR "b""c"'


def test_accented_words_stay_whole_in_the_index(spark):
    assert one(spark, text.index_tokens(F.lit("Café snake_case getUserById"))) == ["café", "snake_case", "getuserbyid"]


@pytest.mark.parametrize(
    "path, language",
    [("a/b.ts", "typescript"), ("Dockerfile", "dockerfile"), ("x/Dockerfile.prod", "dockerfile"), ("Makefile", "makefile"), (".env", None), ("a.tar.gz", None), ("b.PY", "python")],
)
def test_language(spark, path, language):
    assert one(spark, paths.language(F.lit(path))) == language


@pytest.mark.parametrize(
    "path, size, worthy",
    [("src/a.ts", 10, True), ("node_modules/a.ts", 10, False), ("src/a.ts", 600 * 1024, False), ("yarn.lock", 1, False), ("a.min.js", 1, False), ("a.pb.go", 1, False), ("a.png", 1, False), ("vendor", 1, False)],
)
def test_index_worthy(spark, path, size, worthy):
    assert one(spark, paths.index_worthy(F.lit(path), F.lit(size))) is worthy


@pytest.mark.parametrize("glob, path, hit", [("docs/**", "docs/a/b.md", True), ("*.ts", "a/b.ts", False), ("**/*.ts", "a/b.ts", True), ("**/*.ts", "b.ts", True), ("a?.{js,ts}", "ab.js", True)])
def test_globs(spark, glob, path, hit):
    assert one(spark, paths.matches_any(F.lit(path), [glob])) is hit


def test_normalised_path(spark):
    assert one(spark, paths.normalised(F.lit("../a//./b/../c"))) == "a/c"


def test_ancestors(spark):
    assert one(spark, paths.ancestors(F.lit("a/b/c.ts"))) == ["a/b", "a", ""]


@pytest.mark.parametrize("path, tokens, weight", [("src/auth.ts", ["auth"], 1.25), ("CHANGELOG.md", [], 0.6), ("tests/a.ts", [], 0.7), ("docs/x.html", [], 0.8), ("a/b.ts", ["zz"], 1.0)])
def test_path_weight(spark, path, tokens, weight):
    given = F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")
    assert one(spark, paths.path_weight(F.lit(path), given)) == pytest.approx(weight)


def test_first_line_and_truncation(spark):
    assert one(spark, text.first_line(F.lit("\n  \n  hello  \nx"))) == "hello"
    assert one(spark, F.length(text.truncated(F.lit("ab " * 100)))) == 140
