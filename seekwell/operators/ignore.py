"""Ignore patterns.

Each pattern becomes a regular expression once; paths are then tested inside
the JVM. A file is ignored if the last pattern that matches it, or matches any
directory above it, is not negated. As in version control, a negated pattern
cannot bring back a file below an ignored directory.
"""

from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from typing import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_IGNORE_PATTERNS, IGNORE_FILE_NAMES
from ..session import broadcast_if_small


@dataclass(frozen=True)
class Rule:
    body: str  # regular expression of the whole path, without anchors
    negated: bool
    dir_only: bool


@dataclass(frozen=True)
class Run:
    """Neighbouring rules of one polarity, joined to one expression per kind."""

    on_file: str
    on_dir: str
    below: str
    negated: bool


_NEVER = r"(?!)"
_SPECIAL = set("\\.^$|()[]{}*+?-&~#")


def _literal(char: str) -> str:
    return "\\" + char if char in _SPECIAL else char


def _char_class(glob: str, start: int) -> tuple[str, int] | None:
    """The class that opens at `start` and the position after it."""
    i = start + 1
    negate = i < len(glob) and glob[i] in "!^"
    i += negate
    members, first = [], True
    while i < len(glob) and (glob[i] != "]" or first):
        first = False
        if glob[i] == "\\" and i + 1 < len(glob):
            i += 1
            members.append("\\" + glob[i] if not glob[i].isalnum() else glob[i])
        elif glob[i] == "-" and members and i + 1 < len(glob) and glob[i + 1] != "]":
            members.append("-")
        else:
            members.append(glob[i] if glob[i].isalnum() else "\\" + glob[i])
        i += 1
    if i >= len(glob):
        return None
    inner = "".join(members)
    return (f"(?!/)[^{inner}]" if negate else f"[{inner}]"), i + 1


def _segment(glob: str) -> str:
    """Regular expression of one path component."""
    out, i = [], 0
    while i < len(glob):
        char = glob[i]
        if char == "\\" and i + 1 < len(glob):
            out.append(_literal(glob[i + 1]))
            i += 2
        elif char == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out.append("[^/]*")
        elif char == "?":
            out.append("[^/]")
            i += 1
        elif char == "[" and (found := _char_class(glob, i)):
            out.append(found[0])
            i = found[1]
        else:
            out.append(_literal(char))
            i += 1
    return "".join(out)


def parse_rule(line: str) -> Rule | None:
    """The rule of one line, None for blank lines and comments."""
    line = line.rstrip("\r\n")
    bare = line.rstrip(" ")
    if (len(bare) - len(bare.rstrip("\\"))) % 2 and len(bare) < len(line):
        bare += " "  # an escaped trailing space is kept
    if not bare or bare.startswith("#"):
        return None
    negated = bare.startswith("!")
    glob = bare[1:] if negated else bare
    dir_only = glob.endswith("/")
    glob = glob.rstrip("/") if dir_only else glob
    if not glob:
        return None
    anchored = "/" in glob
    parts = glob.lstrip("/").split("/")
    body = "" if anchored else "(?:.*/)?"
    for position, part in enumerate(parts):
        last = position == len(parts) - 1
        if part == "**":
            body += ".+" if last else "(?:.*/)?"
        else:
            body += _segment(part) + ("" if last else "/")
    return Rule(body, negated, dir_only)


def compile_patterns(lines: Iterable[str]) -> list[Run]:
    """Runs in order of precedence, last pattern first."""
    rules = [rule for line in lines if (rule := parse_rule(line))]
    runs = []
    for negated, group in groupby(reversed(rules), key=lambda rule: rule.negated):
        members = list(group)
        either = lambda bodies: "|".join(f"(?:{b})" for b in bodies)
        files = either(r.body for r in members if not r.dir_only)
        below = either(r.body + ("/.*" if r.dir_only else "(?:/.*)?") for r in members)
        runs.append(
            Run(
                on_file=f"(?s)^(?:{files})$" if files else _NEVER,
                on_dir=f"(?s)^(?:{either(r.body for r in members)})$",
                below=f"(?s)^(?:{below})$",
                negated=negated,
            )
        )
    return runs


def _verdict(tests: list[tuple[Column, bool]]) -> Column:
    """The polarity of the first test that holds; not ignored if none does."""
    return reduce(
        lambda rest, test: F.when(test[0], F.lit(not test[1])).otherwise(rest),
        reversed(tests),
        F.lit(False),
    )


def _parents(path: Column) -> Column:
    """The directories above a path, outermost first."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    above = F.transform(
        F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    return F.when(depth > 0, above).otherwise(F.array().cast("array<string>"))


def is_ignored(path: Column, patterns: Iterable[str]) -> Column:
    """Whether a folder-relative path is ignored by a list of patterns."""
    runs = compile_patterns(patterns)
    if not any(run.negated for run in runs):
        # one test of the whole path covers the file and its directories
        return reduce(lambda a, b: a | b, [path.rlike(r.below) for r in runs], F.lit(False))
    in_ignored_dir = F.exists(
        _parents(path), lambda d: _verdict([(d.rlike(r.on_dir), r.negated) for r in runs])
    )
    return in_ignored_dir | _verdict([(path.rlike(r.on_file), r.negated) for r in runs])


def filter_ignored(
    files: DataFrame,
    patterns: Iterable[str] = (),
    defaults: bool = True,
    column: str = "path",
) -> DataFrame:
    lines = (list(DEFAULT_IGNORE_PATTERNS) if defaults else []) + list(patterns)
    return files.filter(~is_ignored(F.col(column), lines))


_RUNS_TYPE = "array<struct<on_file:string,on_dir:string,negated:boolean>>"


def folder_rules(files: DataFrame, defaults: bool = True) -> DataFrame:
    """`(folder, runs)` from the pattern files in the root of each folder."""
    base = list(DEFAULT_IGNORE_PATTERNS) if defaults else []

    @F.pandas_udf(_RUNS_TYPE)
    def compiled(first: pd.Series, second: pd.Series) -> pd.Series:
        def one(a, b):
            lines = base + (a or "").split("\n") + (b or "").split("\n")
            return [
                {"on_file": r.on_file, "on_dir": r.on_dir, "negated": r.negated}
                for r in compile_patterns(lines)
            ]

        return pd.Series([one(a, b) for a, b in zip(first, second)])

    name_a, name_b = IGNORE_FILE_NAMES
    return (
        files.filter(F.col("path").isin(name_a, name_b))
        .groupBy("folder")
        .agg(
            F.max(F.when(F.col("path") == name_a, F.col("content"))).alias("a"),
            F.max(F.when(F.col("path") == name_b, F.col("content"))).alias("b"),
        )
        .select("folder", compiled("a", "b").alias("runs"))
    )


def filter_ignored_by_folder(
    files: DataFrame, defaults: bool = True, pattern_files: DataFrame | None = None
) -> DataFrame:
    """Apply to every folder its own pattern files: those among `files`, or the rows
    `(folder, path, content)` of `pattern_files`."""
    source = files if pattern_files is None else pattern_files
    rules = broadcast_if_small(folder_rules(source, defaults))

    def says_ignore(text: Column, field: str) -> Column:
        matching = F.filter("runs", lambda run: F.rlike(text, run[field]))
        return F.coalesce(~F.get(matching, F.lit(0))["negated"], F.lit(False))

    own = F.exists(_parents(F.col("path")), lambda d: says_ignore(d, "on_dir")) | says_ignore(
        F.col("path"), "on_file"
    )
    shared = is_ignored(F.col("path"), DEFAULT_IGNORE_PATTERNS if defaults else [])
    return (
        files.join(rules, "folder", "left")
        .filter(F.when(F.col("runs").isNull(), ~shared).otherwise(~own))
        .drop("runs")
    )
