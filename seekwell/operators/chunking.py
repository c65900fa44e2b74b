"""Chunkers: an array of window texts per file, then one row per chunk.

Blank windows are dropped before numbering, so positions are dense.
"""

from typing import Callable, Iterator, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    LINE_OVERLAP,
    LINES_PER_CHUNK,
    MAX_TOKENS_PER_REQUEST,
    TOKENS_PER_CHUNK,
)
from ..functions import text as text_fn


def _windows(items: Column, starts: Column, size: int, separator: str) -> Column:
    """Joined slices of `items` at zero-based `starts`."""
    return F.transform(
        starts, lambda at: F.array_join(F.slice(items, at + 1, F.lit(size)), separator)
    )


def line_starts(n_lines: Column, size: int, overlap: int) -> Column:
    """Starts of the line windows; the first that reaches the end is the last."""
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be in [0, {size}), got {overlap}")
    step = size - overlap
    last = F.when(n_lines <= size, 0).otherwise(F.ceil((n_lines - size) / step) * step)
    return F.when(n_lines == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), last.cast("int"), F.lit(step))
    )


def with_line_chunks(
    files: DataFrame,
    size: int = LINES_PER_CHUNK,
    overlap: int = LINE_OVERLAP,
    column: str = "content",
) -> DataFrame:
    """Adds `chunk_texts`: overlapping windows of lines."""
    starts = line_starts(F.size("_lines"), size, overlap)
    return (
        files.withColumn("_lines", text_fn.lines(F.col(column)))
        .withColumn("chunk_texts", _windows(F.col("_lines"), starts, size, "\n"))
        .drop("_lines")
    )


def with_token_chunks(
    files: DataFrame,
    size: int = TOKENS_PER_CHUNK,
    ceiling: int = MAX_TOKENS_PER_REQUEST,
    column: str = "content",
) -> DataFrame:
    """Adds `n_tokens` and `chunk_texts`: consecutive windows of tokens, found
    by tokenizing once. A document over the ceiling gets no windows; testing it
    here, not in a filter, keeps the tokenizing from being repeated below."""
    if size < 1:
        raise ValueError("size must be positive")
    count = F.size("_tokens")
    starts = F.when(
        (count == 0) | (count > ceiling), F.array().cast("array<int>")
    ).otherwise(F.sequence(F.lit(0), count - 1, F.lit(size)))
    return (
        files.withColumn("_tokens", text_fn.tokens(F.col(column)))
        .withColumn("n_tokens", count)
        .withColumn("chunk_texts", _windows(F.col("_tokens"), starts, size, ""))
        .drop("_tokens")
    )


class Tokenizer(Protocol):
    """What a pluggable tokenizer offers; `decode` may raise on a split token."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, tokens: list[int]) -> str: ...


def with_tokenizer_chunks(
    files: DataFrame,
    load: Callable[[], Tokenizer],
    size: int = TOKENS_PER_CHUNK,
    ceiling: int = MAX_TOKENS_PER_REQUEST,
    column: str = "content",
) -> DataFrame:
    """Like `with_token_chunks` for a tokenizer loaded once per task. A window
    that cannot be decoded is skipped."""

    @F.arrow_udf("struct<n_tokens:int,chunk_texts:array<string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load()
        for batch in batches:
            counts, chunked = [], []
            for document in batch.to_pylist():
                ids = tokenizer.encode(document or "")
                counts.append(len(ids))
                windows = []
                for at in range(0, len(ids) if len(ids) <= ceiling else 0, size):
                    try:
                        windows.append(tokenizer.decode(ids[at : at + size]))
                    except ValueError:  # includes UnicodeDecodeError
                        continue
                chunked.append(windows)
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int32()), pa.array(chunked, pa.list_(pa.string()))],
                names=["n_tokens", "chunk_texts"],
            )

    return (
        files.withColumn("_run", run(F.col(column)))
        .withColumn("n_tokens", F.col("_run.n_tokens"))
        .withColumn("chunk_texts", F.col("_run.chunk_texts"))
        .drop("_run")
    )


def explode_chunks(chunked: DataFrame, *keep: str) -> DataFrame:
    """One row per window that is not blank: the kept columns, `chunk_index`,
    `text`. Files without such windows give no row."""
    # Exploding an expression, not a column: Spark would infer a size filter
    # from a column and push a second copy of the chunking below the shuffle.
    kept = F.filter("chunk_texts", text_fn.is_not_blank)
    return chunked.select(*keep, F.posexplode(kept).alias("chunk_index", "text"))
