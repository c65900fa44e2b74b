"""File snapshots: `files(folder, path, content, size)`."""

import os
import zlib
from functools import partial, reduce
from typing import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_IGNORE_PATTERNS, IGNORE_FILE_NAMES, MAX_FILE_BYTES
from ..functions import paths
from ..operators import ignore
from ..operators.filters import is_indexed_name, is_valid_encoding
from ..session import materialize
from ..storage import Storage


_READ_BYTES = 16 * 1024 * 1024
_ENTRIES = "path string, size long, is_dir boolean, more boolean"
_PAGE = 20_000
_PARTS = 64  # of a directory that has more entries than a page


def _file_system(uri: str):
    """File system of a URI and the path within it. Names are as they are listed, so
    what a URI may not hold is quoted here."""
    if "://" in uri:
        uri = quote(uri.replace("s3a://", "s3://", 1), safe="/:@")
    return pafs.FileSystem.from_uri(uri)


_LISTED = (pafs.FileType.File, pafs.FileType.Directory)


def _children(uri: str, part: int, parts: int) -> Iterator[tuple[str, int, bool] | None]:
    """(name, size, is_dir) of the entries of a directory that fall to a part by a hash
    of their names; None for others. Links to directories are left out."""
    system, inner = _file_system(uri)
    if not isinstance(system, pafs.LocalFileSystem):
        for entry in system.get_file_info(pafs.FileSelector(inner)):
            if zlib.crc32(entry.base_name.encode()) % parts != part or entry.type not in _LISTED:
                yield None
            else:
                yield entry.base_name, entry.size or 0, entry.type == pafs.FileType.Directory
        return
    with os.scandir(inner) as found:
        for entry in found:
            if zlib.crc32(os.fsencode(entry.name)) % parts != part:
                yield None
            elif entry.is_dir(follow_symlinks=False):
                yield entry.name, 0, True
            elif entry.is_file():
                try:
                    yield entry.name, entry.stat().st_size, False
                except FileNotFoundError:  # gone since
                    yield None


def _list_pages(batches: Iterator[pa.RecordBatch], page: int) -> Iterator[pa.RecordBatch]:
    """The entries of directories, or of parts of them, a page at a time. A whole
    directory of more than a page gives one row with `more`, to be listed in parts."""

    def batch_of(uri: str, rows: list[tuple[str, int, bool]], more: bool = False) -> pa.RecordBatch:
        root = uri.rstrip("/")
        return pa.record_batch({
            "path": pa.array([uri] if more else [f"{root}/{name}" for name, _, _ in rows], pa.string()),
            "size": pa.array([0] if more else [size for _, size, _ in rows], pa.int64()),
            "is_dir": pa.array([True] if more else [is_dir for _, _, is_dir in rows], pa.bool_()),
            "more": pa.array([more] * (1 if more else len(rows)), pa.bool_()),
        })

    for batch in batches:
        for uri, part, parts in zip(*(batch.column(k).to_pylist() for k in ("path", "part", "parts"))):
            rows: list[tuple[str, int, bool]] = []
            for entry in _children(uri, part, parts):
                if entry is None:
                    continue
                if len(rows) == page:
                    if parts == 1:
                        yield batch_of(uri, [], more=True)
                        rows = []
                        break
                    yield batch_of(uri, rows)
                    rows = []
                rows.append(entry)
            if rows:
                yield batch_of(uri, rows)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of files, a few megabytes at a time; of an unreadable one the error."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
    names, contents, errors, held = [], [], [], 0

    def batch_of() -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(names), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], schema
        )

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            content, error = None, None
            try:
                system, inner = _file_system(uri)
                with system.open_input_stream(inner) as stream:
                    content = stream.read()
            except OSError as failure:
                error = str(failure)
            names.append(uri)
            contents.append(content)
            errors.append(error)
            held += len(content or b"")
            if held > _READ_BYTES:
                yield batch_of()
                names, contents, errors, held = [], [], [], 0
    if names:
        yield batch_of()


def list_directory(
    spark: SparkSession, directory: str, patterns: Iterable[str] = (), page: int = _PAGE
) -> DataFrame:
    """`(path, relative, size)` of every file below a directory.

    One job per level of the tree lists all directories of that level in
    parallel. A local or mounted directory of more than `page` entries is listed once
    more, with the next level, by many tasks: each goes through the names, but looks
    up and holds only its own, a page at a time. Ignored directories are not entered. Spark's own file readers
    cannot be used for this, as they hide names that start with `_` or `.`,
    such as `__init__.py`."""
    uri = directory.rstrip("/") or "/"
    lines = [*DEFAULT_IGNORE_PATTERNS, *patterns]
    relative = F.substring("path", len(uri.rstrip("/")) + 2, 1 << 30)
    cores = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(uri, 0, 1)], "path string, part int, parts int")
    files = []
    while True:
        entries = materialize(
            level.repartition(cores).mapInArrow(partial(_list_pages, page=page), _ENTRIES), "listing"
        ).withColumn("relative", relative)
        files.append(entries.filter(~F.col("is_dir")).select("path", "relative", "size"))
        # a trailing component makes the test see the directory as one
        below = ignore.is_ignored(F.concat("relative", F.lit("/x")), lines)
        whole = entries.filter(F.col("is_dir") & ~F.col("more") & ~below)
        parts = F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("part")
        level = whole.select("path", F.lit(0).alias("part"), F.lit(1).alias("parts")).unionByName(
            entries.filter("more").select("path", parts, F.lit(_PARTS).alias("parts"))
        )
        if level.isEmpty():
            return reduce(DataFrame.unionByName, files)


def scan_directory(
    spark: SparkSession,
    directory: str,
    folder: str | None = None,
    max_bytes: int | None = MAX_FILE_BYTES,
    by_name: bool = True,
    patterns: Iterable[str] = (),
) -> DataFrame:
    """Every text file below `directory`, with paths relative to it.

    Names, patterns and sizes are tested on the listing, so only files that can
    be indexed are opened, and the pattern files in the root, which `FileRules` may
    ask for and then drops. Files that are not valid UTF-8 are skipped. A file that
    cannot be read has an empty content and its `error`; a refresh leaves it alone."""
    listed = list_directory(spark, directory, patterns).filter(
        ~ignore.is_ignored(F.col("relative"), [*DEFAULT_IGNORE_PATTERNS, *patterns])
    )
    if by_name:
        rules = F.col("relative").isin(*IGNORE_FILE_NAMES)
        listed = listed.filter(is_indexed_name(F.col("relative")) | rules)
    if max_bytes is not None:
        listed = listed.filter(F.col("size") <= max_bytes)
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    parts = max(spark.sparkContext.defaultParallelism, total // (128 * 1024 * 1024))
    read = (
        listed.select("path")
        .repartition(int(parts))
        .mapInArrow(_read_files, "path string, content binary, error string")
    )
    skip = len(directory.rstrip("/")) + 2
    name = F.lit(folder) if folder is not None else paths.normalize_path(F.lit(directory))
    inside = F.substring("path", skip, 1 << 30)
    valid = F.col("error").isNotNull() | is_valid_encoding(F.col("content"))
    text = F.coalesce(F.col("content").cast("string"), F.lit(""))
    return read.filter(valid).select(
        name.alias("folder"), inside.alias("path"), text.alias("content"),
        F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"), "error",
    )


def scan_visible(
    spark: SparkSession, directory: str, folder: str, max_bytes: int | None = MAX_FILE_BYTES
) -> DataFrame:
    """Like `scan_directory` through Spark's binary file reader: works on every
    store Spark knows, with the size limit pushed to the scan, but does not see
    names that start with `_` or `.`."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    if max_bytes is not None:
        raw = raw.filter(F.col("length") <= max_bytes)
    root = paths.normalize_path(F.lit(directory))
    inside = paths.relative_path(paths.normalize_path(F.col("path")), root)
    return from_binary(raw, F.lit(folder), inside, F.col("content"))


def pattern_lines(spark: SparkSession, directory: str) -> list[str]:
    """Ignore patterns in the root of a directory, in order of precedence."""
    store = Storage(spark, directory)
    lines: list[str] = []
    for name in IGNORE_FILE_NAMES:
        if store.exists(name):
            lines += store.read_text(name).splitlines()
    return lines


def indexable_names(files: DataFrame) -> DataFrame:
    return files.filter(is_indexed_name(F.col("path")))


def from_table(
    table: DataFrame, folder: Column, path: Column, content: Column
) -> DataFrame:
    """A snapshot made of any table that holds texts."""
    return table.select(
        folder.alias("folder"),
        path.alias("path"),
        content.alias("content"),
        F.octet_length(content).cast("long").alias("size"),
    )


def from_binary(
    table: DataFrame, folder: Column, path: Column, content: Column
) -> DataFrame:
    """A snapshot made of byte contents; rows that are not UTF-8 are skipped."""
    return (
        table.select(folder.alias("folder"), path.alias("path"), content.alias("content"))
        .filter(is_valid_encoding(F.col("content")))
        .withColumn("size", F.octet_length("content").cast("long"))
        .withColumn("content", F.col("content").cast("string"))
    )
