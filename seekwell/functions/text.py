"""Text expressions: lines, tokens, blankness, encoding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token keeps the white space before it, so that joined tokens give the text.
TOKEN_PATTERN = r"\s*[^\s]+|\s+"
WORD_PATTERN = r"[\p{L}\p{N}_]+"


def is_not_blank(text: Column) -> Column:
    """True if the text holds a character that is not Unicode white space."""
    return text.rlike(r"(?U)\S")


def lines(text: Column) -> Column:
    """The lines of a text: `\\n` or `\\r\\n` end a line, and the end of the
    text does not start another one."""
    unified = F.regexp_replace(text, "\r\n", "\n")
    body = F.regexp_replace(unified, r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, "\n", -1)
    )


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def chunk_estimate(n_tokens: Column, tokens_per_chunk: int) -> Column:
    """How many token windows a document of `n_tokens` fills."""
    return F.ceil(n_tokens / F.lit(tokens_per_chunk)).cast("int")


def words(text: Column) -> Column:
    """Lower-case words, the units of the default embedder."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))
