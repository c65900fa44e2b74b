"""Path expressions. Paths use `/` and are compared by component."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """Absolute lexical form: no scheme, no empty, `.` or `..` components.
    Symbolic links are not resolved."""
    bare = F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:", "")
    kept = F.aggregate(
        F.split(bare, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _stem(folder: Column) -> Column:
    return F.regexp_replace(folder, "/+$", "")


def is_within(path: Column, folder: Column) -> Column:
    """True if `path` is `folder` or lies below it (`a/bc` is not within `a/b`)."""
    stem = _stem(folder)
    return (path == folder) | F.startswith(path, F.concat(stem, F.lit("/")))


def relative_path(path: Column, folder: Column) -> Column:
    """`path` without its `folder` prefix; null if it is not within the folder."""
    stem = _stem(folder)
    rest = F.regexp_replace(F.substring(path, F.length(stem) + 1, F.length(path)), "^/+", "")
    return F.when(is_within(path, folder), rest)


def join_path(folder: Column, path: Column) -> Column:
    return F.concat(_stem(folder), F.lit("/"), path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the base name; empty for `.env` and `Makefile`."""
    return F.regexp_extract(base_name(path), r"(?s)^.+\.([^.]*)$", 1)
