"""Ignore patterns against a table of cases with hand-written outcomes."""

import pytest
from pyspark.sql import functions as F

from seekwell.operators import ignore

CASES = [
    # patterns, path, ignored
    (["*.log"], "a.log", True),
    (["*.log"], "d/e/a.log", True),
    (["*.log"], "a.logs", False),
    (["target"], "target", True),
    (["target"], "target/x/y", True),
    (["target"], "a/target/x", True),
    (["target"], "targets/x", False),
    (["target/"], "target", False),
    (["target/"], "target/x", True),
    (["target/"], "a/target/x", True),
    (["/build"], "build", True),
    (["/build"], "build/x", True),
    (["/build"], "a/build", False),
    (["docs/*.md"], "docs/a.md", True),
    (["docs/*.md"], "docs/b/a.md", False),
    (["docs/*.md"], "x/docs/a.md", False),
    (["a/**/b"], "a/b", True),
    (["a/**/b"], "a/x/b", True),
    (["a/**/b"], "a/x/y/b/c", True),
    (["a/**/b"], "a/xb", False),
    (["**/foo"], "foo", True),
    (["**/foo"], "x/y/foo", True),
    (["foo/**"], "foo/x/y", True),
    (["foo/**"], "foo", False),
    (["*.log", "!keep.log"], "keep.log", False),
    (["*.log", "!keep.log"], "d/keep.log", False),
    (["*.log", "!keep.log"], "other.log", True),
    (["!keep.log", "*.log"], "keep.log", True),
    (["logs/", "!logs/keep.log"], "logs/keep.log", True),
    (["build", "!build"], "build/x", False),
    (["*", "!*.md"], "a.md", False),
    (["*", "!*.md"], "d/a.md", True),
    (["/*", "!/src"], "src/a/b", False),
    (["/*", "!/src"], "lib/a", True),
    (["#comment"], "#comment", False),
    ([r"\#literal"], "#literal", True),
    ([r"\!literal"], "!literal", True),
    (["trail   "], "trail", True),
    (["trail\\ "], "trail ", True),
    (["trail\\ "], "trail", False),
    (["", "   "], "a", False),
    (["[ab].txt"], "a.txt", True),
    (["[ab].txt"], "c.txt", False),
    (["[!ab].txt"], "c.txt", True),
    (["[!ab].txt"], "a.txt", False),
    (["[a-c]x"], "bx", True),
    (["[a-c]x"], "dx", False),
    (["[]x]"], "]", True),
    (["[x"], "[x", True),
    (["f?o"], "foo", True),
    (["f?o"], "f/o", False),
    (["f*o"], "f/o", False),
    (["a.b"], "axb", False),
    (["a+(b)$"], "a+(b)$", True),
    (["ünï*"], "ünïcode", True),
]


@pytest.mark.parametrize("batch", [CASES])
def test_cases(spark, batch):
    wrong = []
    one = spark.range(1)
    columns = [
        ignore.is_ignored(F.lit(path), patterns).alias(f"c{i}")
        for i, (patterns, path, _) in enumerate(batch)
    ]
    row = one.select(*columns).first()
    for i, (patterns, path, expected) in enumerate(batch):
        if row[i] != expected:
            wrong.append((patterns, path, row[i]))
    assert not wrong


def test_folder_patterns_agree_with_fixed_ones(spark, make_files):
    """The per-folder form gives the outcome of the fixed form in every case."""
    contents, expected = {}, set()
    for i, (patterns, path, ignored) in enumerate(CASES):
        folder = f"f{i}"
        contents[(folder, ".gitignore")] = "\n".join(patterns)
        contents[(folder, path)] = "x"
        if not ignored:
            expected.add((folder, path))
    kept = ignore.filter_ignored_by_folder(make_files(contents), defaults=False)
    found = {(r["folder"], r["path"]) for r in kept.collect() if r["path"] != ".gitignore"}
    assert found == expected


def test_defaults_and_second_pattern_file(spark, make_files):
    files = make_files({
        ("a", ".gitignore"): "*.txt",
        ("a", ".seekwellignore"): "!keep.txt\n*.md",
        ("a", "x.txt"): "1", ("a", "keep.txt"): "1", ("a", "y.md"): "1", ("a", "z.py"): "1",
        ("a", "node_modules/z.py"): "1",
        ("b", "x.txt"): "1", ("b", "t.log"): "1", ("b", "target/c.py"): "1",
    })
    kept = ignore.filter_ignored_by_folder(files)
    found = {(r["folder"], r["path"]) for r in kept.collect() if not r["path"].startswith(".")}
    assert found == {("a", "keep.txt"), ("a", "z.py"), ("b", "x.txt")}


def test_fixed_patterns_need_one_expression(spark):
    plan = ignore.filter_ignored(
        spark.createDataFrame([("a",)], "path string"), ["x", "y/", "*.z"]
    )._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1
