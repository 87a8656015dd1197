import pytest
from pyspark.sql import functions as F

from modweave.functions.globs import compile_globs, excluded_col, glob_col, ignore_col, matches

CASES = [
    (["src/*.ts"], "src/a/b.ts", True),  # a star crosses slashes
    (["src/**/*.ts"], "src/types.ts", False), (["src/**/*.ts"], "src/d/index.ts", True),
    (["**/*.ts"], "index.ts", True), (["src/", "!src/keep/"], "src/keep/x", False), (["!src/keep/", "src/"], "src/keep/x", False), (["src/", "!src/keep/"], "src/x", True),
    (["!a"], "a", False), (["name"], "x/name", True), (["name"], "name/x", True), (["name"], "x/name/y", True), (["name"], "xname", False), (["/name"], "x/name", False), (["/name"], "name/y", True),
    (["/dir/"], "x/dir/y", False), (["dir/"], "x/dir/y", True), (["./a/*.js"], "a/x.js", True), (["\\!odd"], "!odd", True), (["a.{js,ts}"], "a.ts", True), (["[!x].js"], "y.js", True), (["[!x].js"], "x.js", False),
    (["a\\[b\\].ts"], "a[b].ts", True), (["a.ts"], "axts", False), (["p?.ts"], "p1.ts", True), (["", "  "], "a", False),
]


@pytest.mark.parametrize("patterns,path,want", CASES)
def test_patterns(patterns, path, want):
    assert matches("/root/" + path, compile_globs(patterns, "/root")) is want


def test_columns_agree(spark):
    rows = spark.createDataFrame([("/root/" + p,) for _, p, _ in CASES], "p string")
    for patterns, path, want in CASES:
        got = rows.where(F.col("p") == "/root/" + path).select(glob_col(F.col("p"), patterns, "/root")).first()[0]
        assert got is want, (patterns, path)


def test_parent_directories():
    assert matches("/a/other/x.ts", compile_globs(["../other/*.ts"], "/a/root"))
    assert matches("/elsewhere/src/x", compile_globs(["**/src/x"], "/root"))  # outside the root nothing is stripped


def test_excluded_and_ignored(spark):
    df = spark.createDataFrame([("/r/a/x", "v1"), ("/r/b/x", "v2"), ("/r/b/y", "w1")], "p string, v string")
    assert [r.p for r in df.where(excluded_col(F.col("p"), ["b/"], ["**/y"], "/r")).collect()] == ["/r/b/x"]
    assert [r.v for r in df.where(ignore_col(F.col("p"), F.col("v"), {"b/**": ["w*"]}, ["a/"], [], "/r")).collect()] == ["v1", "w1"]
