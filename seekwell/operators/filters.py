"""File-level predicates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    INDEXED_EXTENSIONS,
    INDEXED_FILE_NAMES,
    MAX_FILE_BYTES,
    MAX_TOKENS_PER_REQUEST,
)
from ..functions import paths, text


def is_indexed_name(path: Column) -> Column:
    return paths.extension(path).isin(*INDEXED_EXTENSIONS) | paths.base_name(path).isin(
        *INDEXED_FILE_NAMES
    )


def is_indexed_size(size: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """Counts bytes, not characters; the limit itself is allowed."""
    return size <= max_bytes


def is_valid_encoding(content: Column) -> Column:
    return F.is_valid_utf8(content)


def within_token_ceiling(
    n_tokens: Column, ceiling: int = MAX_TOKENS_PER_REQUEST
) -> Column:
    return n_tokens <= ceiling


def indexable(
    files: DataFrame,
    max_bytes: int | None = MAX_FILE_BYTES,
    by_name: bool = True,
) -> DataFrame:
    """Files worth indexing. Conditions on path and size come before the one
    that reads the content."""
    kept = files
    if by_name:
        kept = kept.filter(is_indexed_name(F.col("path")))
    if max_bytes is not None:
        kept = kept.filter(is_indexed_size(F.col("size"), max_bytes))
    return kept.filter(text.is_not_blank(F.col("content")))


def rejected_by_tokens(
    files: DataFrame, ceiling: int = MAX_TOKENS_PER_REQUEST
) -> DataFrame:
    """Documents that no single request can hold, with the reason."""
    # Exploding zero or one count, as a filter would be pushed below the count
    # and tokenize a second time.
    over = F.filter(
        F.array(text.token_count(F.col("content"))),
        lambda n: ~within_token_ceiling(n, ceiling),
    )
    return files.select("folder", "path", F.explode(over).alias("n_tokens")).withColumn(
        "reason", F.lit(f"more than {ceiling} tokens")
    )


def reject_reason(
    failed: Column,
    by_name: bool = True,
    max_bytes: int | None = MAX_FILE_BYTES,
    ceiling: int | None = MAX_TOKENS_PER_REQUEST,
) -> Column:
    """Why a file of `(path, size, content)` is left out, the first reason that holds:
    unreadable, name, size, encoding, blank or tokens; null if it is not. What reads
    the content comes last."""
    content = F.col("content")
    body = content.cast("string")
    tests = [(failed, "unreadable")]
    if by_name:
        tests.append((~is_indexed_name(F.col("path")), "name"))
    if max_bytes is not None:
        tests.append((~is_indexed_size(F.col("size"), max_bytes), "size"))
    tests.append((~is_valid_encoding(content), "encoding"))
    tests.append((content.isNull() | ~text.is_not_blank(body), "blank"))
    if ceiling is not None:  # a token has a byte at least, so most texts need no count
        long = F.octet_length(content) > ceiling
        tests.append((long & ~within_token_ceiling(text.token_count(body), ceiling), "tokens"))
    reason = F.lit(None).cast("string")
    for test, name in reversed(tests):
        reason = F.when(test, name).otherwise(reason)
    return reason


def rejected(
    files: DataFrame,
    max_bytes: int = MAX_FILE_BYTES,
    ceiling: int = MAX_TOKENS_PER_REQUEST,
) -> DataFrame:
    """`(folder, path, size, reason)` of the files that an index leaves out, by
    `reject_reason`. `content` may be text or bytes; a null content is blank."""
    failed = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    reason = reject_reason(failed, max_bytes=max_bytes, ceiling=ceiling)
    # Exploding zero or one reason, as a filter would repeat the tests below it.
    given = F.filter(F.array(reason), lambda r: r.isNotNull())
    return files.select("folder", "path", "size", F.explode(given).alias("reason"))


def in_folder(files: DataFrame, folder: str, column: str = "path") -> DataFrame:
    return files.filter(paths.is_within(F.col(column), F.lit(folder)))
