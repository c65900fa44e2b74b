"""Helpers that several operators share."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small enough for a task's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by `keys`. The last
    group of a batch is held until the next batch shows its end."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        same = bool(held) and all(
            held[-1].column(k)[held[-1].num_rows - 1].equals(batch.column(k)[0]) for k in keys
        )
        if last or (held and not same):
            head = [*held, batch.slice(0, last)] if last else held
            yield pa.Table.from_batches([b for b in head if b.num_rows])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table_: pa.Table, keys: list[str]):
    """Start rows of the groups of a sorted table, and its number of rows."""
    import numpy as np

    change = np.zeros(table_.num_rows, bool)
    change[0] = True
    for k in keys:
        c = table_.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), table_.num_rows)
