"""Vectors as rows: which take part, and how they get into numpy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType


def _parts(rows: DataFrame, *others: Column) -> tuple[DataFrame, Column]:
    """(vec_id, vector) and `others`, and whether a component is null or not finite."""
    kind = rows.schema["embedding"].dataType.elementType
    vector = F.col("embedding")
    if not isinstance(kind, FloatType):
        vector = vector.cast("array<double>")
    infinite = lambda x: F.abs(x).cast("double") == F.lit(float("inf"))
    bad = F.exists("vector", lambda x: F.coalesce(F.isnan(x) | infinite(x), F.lit(True)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), *others), bad


def finite(rows: DataFrame, *others: Column) -> DataFrame:
    """(vec_id, vector) and `others` of all rows whose vector is neither null nor empty
    and has only finite components."""
    kept, bad = _parts(rows, *others)
    return kept.filter(F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(~bad)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, repeated rows once: not null, not
    zero, without null or non-finite components. Floats stay floats, which doubles
    hold exactly; other numbers become doubles."""
    kept, bad = _parts(rows)
    kept = kept.filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    some = F.exists("vector", lambda x: x != 0)
    return kept.filter(~bad & some).distinct()


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a column as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) % len(column) or len(set(np.diff(column.offsets.to_numpy()))) > 1:
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; large and small components do no harm."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
