"""Chunkers against straight models."""

import re

import pytest
from pyspark.sql import functions as F

from seekwell.functions import text
from seekwell.operators import chunking

WORD = "word"
LINE_TEXTS = (
    ["", " ", "\n", "\n\n", "a", "a\n", "a\r\n", "a\r\nb\r", "\r\n\r\n", "a\r\r\nb", "\u00a0\n\u2003"]
    + ["\n".join(f"line {i}" for i in range(n)) for n in (1, 49, 50, 51, 89, 90, 91, 130, 131)]
    + ["\n" * 120, "\n" * 60 + WORD, WORD + "\n" * 120 + WORD + "\n"]
)
TOKEN_TEXTS = ["", "   ", "a", " a b ", "a b c d e f g h", "a " * 9, "x\n\n y\tz " * 5, "é ü\u00a0ñ"]


def model_lines(content):
    parts = content.split("\n")
    tail = parts.pop()
    parts = [p[:-1] if p.endswith("\r") else p for p in parts]
    return parts + ([tail] if tail else [])


def model_line_chunks(content, size, overlap):
    lines, chunks, at = model_lines(content), [], 0
    while at < len(lines):
        window = "\n".join(lines[at : at + size])
        if window.strip():
            chunks.append(window)
        if at + size >= len(lines):
            break
        at += size - overlap
    return chunks


def model_token_chunks(content, size):
    tokens = re.findall(r"\s*[^\s]+|\s+", content, flags=re.ASCII)
    windows = ["".join(tokens[i : i + size]) for i in range(0, len(tokens), size)]
    return [w for w in windows if w.strip()]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, content string")


def chunks_by_id(chunked, n):
    found = {i: [] for i in range(n)}
    for row in chunking.explode_chunks(chunked, "id").orderBy("id", "chunk_index").collect():
        assert row["chunk_index"] == len(found[row["id"]])  # dense numbering
        found[row["id"]].append(row["text"])
    return [found[i] for i in range(n)]


def test_lines(spark):
    rows = table(spark, LINE_TEXTS).select("id", text.lines(F.col("content")).alias("l"))
    found = [r["l"] for r in rows.orderBy("id").collect()]
    assert found == [model_lines(t) for t in LINE_TEXTS]


@pytest.mark.parametrize("size,overlap", [(50, 10), (3, 1), (4, 0), (1, 0), (5, 4)])
def test_line_chunks(spark, size, overlap):
    chunked = chunking.with_line_chunks(table(spark, LINE_TEXTS), size, overlap)
    expected = [model_line_chunks(t, size, overlap) for t in LINE_TEXTS]
    assert chunks_by_id(chunked, len(LINE_TEXTS)) == expected


@pytest.mark.parametrize("size", [1, 2, 4, 8, 8192])
def test_token_chunks(spark, size):
    chunked = chunking.with_token_chunks(table(spark, TOKEN_TEXTS), size)
    expected = [model_token_chunks(t, size) for t in TOKEN_TEXTS]
    assert chunks_by_id(chunked, len(TOKEN_TEXTS)) == expected


def test_token_chunks_keep_the_text(spark):
    texts = [t for t in TOKEN_TEXTS if t.strip()]
    joined = chunking.with_token_chunks(table(spark, texts), 3).select(
        "id", F.array_join("chunk_texts", "").alias("t")
    )
    assert [r["t"] for r in joined.orderBy("id").collect()] == texts


def test_token_ceiling(spark):
    texts = ["a b c", "a b c d"]
    chunked = chunking.with_token_chunks(table(spark, texts), size=2, ceiling=3)
    assert chunks_by_id(chunked, 2) == [["a b", " c"], []]


def test_pluggable_tokenizer(spark):
    class Bytes:
        """Byte tokens, so that windows can cut a character in two."""

        def encode(self, value):
            return list(value.encode())

        def decode(self, tokens):
            return bytes(tokens).decode()

    texts = ["abcdef", "aé", "", "    "]
    chunked = chunking.with_tokenizer_chunks(table(spark, texts), Bytes, size=2)
    counts = [r["n_tokens"] for r in chunked.orderBy("id").collect()]
    assert counts == [6, 3, 0, 4]
    # "aé" is three bytes: both windows hold half of a character and are skipped
    assert chunks_by_id(chunked, 4) == [["ab", "cd", "ef"], [], [], []]


def test_bad_windows():
    with pytest.raises(ValueError):
        chunking.line_starts(F.lit(1), 10, 10)
    with pytest.raises(ValueError):
        chunking.line_starts(F.lit(1), 10, 11)


def test_chunking_is_planned_once(spark):
    """The tokenizing expression must not be copied below or beside itself."""
    chunked = chunking.with_token_chunks(table(spark, TOKEN_TEXTS), 4)
    plan = chunking.explode_chunks(chunked, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_rejected_files_have_the_first_reason(spark):
    from seekwell.operators import filters

    rows = [
        ("f", "a.md", b"fine text", 9, None), ("f", "b.bin", b"\xff", 1, None),
        ("f", "c.md", b"x" * 30, 30, None), ("f", "d.md", b"\xff", 1, None),
        ("f", "e.md", b" \n", 2, None), ("f", "g.md", None, None, None),
        ("f", "h.md", b"a b c d e f", 11, None), ("f", "i.md", b"", 0, "denied"),
    ]
    files = spark.createDataFrame(rows, "folder string, path string, content binary, size long, error string")
    found = {r["path"]: r["reason"] for r in filters.rejected(files, 20, 5).collect()}
    assert found == {
        "b.bin": "name", "c.md": "size", "d.md": "encoding", "e.md": "blank", "g.md": "blank",
        "h.md": "tokens", "i.md": "unreadable",
    }
    assert filters.rejected(files.drop("error").limit(0)).count() == 0
