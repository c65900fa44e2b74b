"""Difference between two snapshots, by folder, path and content hash.

Only keys and hashes are shuffled; contents are fetched afterwards for the
files that changed.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

KEY = ["folder", "path"]


def snapshot_keys(files: DataFrame) -> DataFrame:
    """One row per file: `hash`, how often the key was given (`copies`) and
    whether its contents disagree (`conflict`). Combined before the shuffle."""
    return files.groupBy(*KEY).agg(
        F.min("hash").alias("hash"),
        F.count("*").alias("copies"),
        (F.min("hash") != F.max("hash")).cast("int").alias("conflict"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """All keys of both sides with `status`: added, deleted, modified or same.

    `old` needs folder, path and hash; `new` the same. Other columns of either
    side are carried through."""
    left = old.withColumnRenamed("hash", "old_hash").withColumn("_in_old", F.lit(True))
    right = new.withColumnRenamed("hash", "new_hash").withColumn("_in_new", F.lit(True))
    status = (
        F.when(F.col("_in_old").isNull(), "added")
        .when(F.col("_in_new").isNull(), "deleted")
        .when(F.col("old_hash") != F.col("new_hash"), "modified")
        .otherwise("same")
    )
    return (
        left.join(right, KEY, "full_outer")
        .withColumn("status", status)
        .drop("_in_old", "_in_new")
    )


def changes(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("status") != "same")


def change_stats(diff: DataFrame) -> DataFrame:
    """One row of counts per outcome."""
    counts = [
        F.count_if(F.col("status") == s).alias(s)
        for s in ("added", "modified", "deleted", "same")
    ]
    return diff.agg(F.count("*").alias("files"), *counts)


def paths_to_delete(diff: DataFrame) -> DataFrame:
    """Keys whose stored chunks must go: deleted files, and modified ones, whose
    chunks are all replaced."""
    return (
        diff.filter(F.col("status").isin("deleted", "modified"))
        .select(*KEY)
        .dropDuplicates(KEY)
    )


def without_paths(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose file is not in `gone`."""
    return rows.join(gone.select(*KEY), KEY, "left_anti")


def rename_pairs(diff: DataFrame) -> DataFrame:
    """Pairs each deleted file with at most one added file of the same folder
    and content, in the order of the md5 of the paths.

    Many files may share one content, so positions are counted in two steps:
    within a slice of the md5 range, then shifted by the sizes of the slices
    before it. No task sees more than a slice, and the join is one to one. The
    moved rows are stored first, as each side reads them twice."""
    moved = materialize(
        diff.filter(F.col("status").isin("deleted", "added")).select(
            *KEY, "status", "old_hash", "new_hash"
        ),
        "moved",
    )

    def numbered(status: str, hash_column: str, name: str) -> DataFrame:
        rows = moved.filter(F.col("status") == status).select(
            "folder",
            F.col("path").alias(name),
            F.col(hash_column).alias("hash"),
            F.md5("path").alias("_rank"),
        ).withColumn("_slice", F.substring("_rank", 1, 3))
        group = ["folder", "hash"]
        before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
            Window.unboundedPreceding, -1
        )
        shift = (
            rows.groupBy(*group, "_slice")
            .agg(F.count("*").alias("_n"))
            .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .drop("_n")
        )
        inside = Window.partitionBy(*group, "_slice").orderBy("_rank", name)
        return (
            rows.withColumn("_at", F.row_number().over(inside))
            .join(shift, [*group, "_slice"])
            .select(*group, name, (F.col("_at") + F.col("_shift")).alias("_at"))
        )

    gone = numbered("deleted", "old_hash", "old_path")
    come = numbered("added", "new_hash", "new_path")
    return gone.join(come, ["folder", "hash", "_at"]).select(
        "folder", "hash", "old_path", "new_path"
    )
