"""Column functions against the standard library."""

import hashlib
import uuid

from pyspark.sql import functions as F

from seekwell.functions import ids, paths, text, vectors
from seekwell.operators import filters
from seekwell.sources import from_binary


def values(spark, inputs, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", expression.alias("o")).orderBy("i").collect()]


def test_uuid5(spark):
    names = ["", "a", "path:10", "path1:0", "ünï/cöde", "x" * 500, "日本:3"]
    found = values(spark, names, ids.uuid5("6ba7b8109dad11d180b400c04fd430c8", F.col("v")))
    assert found == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    found = values(spark, names, ids.chunk_id_hash_form(F.col("v"), F.lit(4)))
    assert found == [f"{uuid.uuid5(uuid.NAMESPACE_OID, n)}#4" for n in names]


def test_hash_and_folder_key(spark):
    names = ["a", "é"]
    sha = [hashlib.sha256(n.encode()).hexdigest() for n in names]
    assert values(spark, names, ids.content_hash(F.col("v"))) == sha
    assert values(spark, names, ids.folder_key(F.col("v"), "k-")) == [f"k-{s[:16]}" for s in sha]


def test_extension(spark):
    cases = {
        "Makefile": "", "a/x.PY": "PY", ".env": "", "a.b.py": "py", "a/b": "", "d.x/f": "",
        "a.": "", "..rs": "rs",
    }
    assert values(spark, cases, paths.extension(F.col("v"))) == list(cases.values())


def test_indexed_names(spark):
    cases = {
        "Makefile": True, "makefile": False, "x.makefile": True, "x.PY": False, ".env": False,
        "a.b.py": True, "a/Dockerfile": True, "noext": False, "x.py/data": False,
    }
    assert values(spark, cases, filters.is_indexed_name(F.col("v"))) == list(cases.values())


def test_within_and_relative(spark):
    names = ["a/b", "a/b/c", "a/bc", "a", "x/a/b"]
    within = values(spark, names, paths.is_within(F.col("v"), F.lit("a/b")))
    assert within == [True, True, False, False, False]
    assert values(spark, names, paths.relative_path(F.col("v"), F.lit("a/b/"))) == [
        None, "c", None, None, None,
    ]
    assert values(spark, ["/r/x", "/"], paths.relative_path(F.col("v"), F.lit("/"))) == ["r/x", ""]


def test_normalize_path(spark):
    cases = {
        "file:/a//b/./c/": "/a/b/c", "file:///a": "/a", "/a/../b": "/b", "a/b": "/a/b",
        "/../..": "/", "s3a://bucket/k/..": "/bucket", "": "/",
    }
    assert values(spark, cases, paths.normalize_path(F.col("v"))) == list(cases.values())


def test_blank(spark):
    cases = {"": False, " \t\n": False, "\u00a0\u2003": False, "\u00a0x": True, "é": True}
    assert values(spark, cases, text.is_not_blank(F.col("v"))) == list(cases.values())


def test_size_counts_bytes(spark, make_files):
    files = make_files({("f", "a.md"): "é" * 500_000, ("f", "b.md"): "é" * 500_000 + "x"})
    assert [r["path"] for r in filters.indexable(files).collect()] == ["a.md"]


def test_invalid_utf8_is_skipped(spark):
    rows = spark.createDataFrame(
        [("a", bytearray("é".encode())), ("b", bytearray(b"\xff\xfe")), ("c", bytearray(b"\xc3"))],
        "p string, c binary",
    )
    kept = from_binary(rows, F.lit("f"), F.col("p"), F.col("c")).collect()
    assert [(r["path"], r["content"], r["size"]) for r in kept] == [("a", "é", 2)]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(
        vectors.norm(F.col("a")).alias("n"),
        vectors.normalize(F.col("a")).alias("u"),
        vectors.normalize(F.col("z")).alias("z"),
        vectors.dot(F.col("a"), F.col("a")).alias("d"),
        vectors.squared_distance(F.col("a"), F.col("z")).alias("q"),
        vectors.similarity_from_distance(F.lit(1.0)).alias("s"),
    ).first()
    assert (row["n"], row["u"], row["z"]) == (5.0, [0.6, 0.8], [0.0, 0.0])
    assert (row["d"], row["q"], row["s"]) == (25.0, 25.0, 0.5)
