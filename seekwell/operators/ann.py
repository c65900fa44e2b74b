"""Approximate search by cells: chunks are stored by nearest centroid and a
query looks only into its nearest cells. Scores are exact; with all cells
probed the result equals exact search.

`top_chunks_bounded` is exact without reading all cells. A row of a cell is at most the
cell's width, an angle, away from its centroid, so a query at a larger angle cannot come
nearer to any row than the difference. Cells that cannot hold a score as good as the
k-th best of the nearest cells stay unread.
"""

from dataclasses import replace
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..constants import MAX_BROADCAST_BYTES, SEARCH_DEPTH
from ..session import materialize
from .embedding import unit_rows
from .scoring import (
    RequestStore, _least_cosine, _vectors, local_best, merge_best, raised, store_requests, stored_requests, top_chunks,
)

TRAINING_ROWS_PER_CELL = 1024
_DISTANCES_AT_ONCE = 4 * 1024 * 1024
_ANGLE_SLACK = 1e-6  # covers rounding of angles and of scores


def train_cells(
    chunks: DataFrame, n_cells: int, seed: int = 17, rows_per_cell: int = TRAINING_ROWS_PER_CELL
) -> np.ndarray:
    """Centroids of the chunk vectors. Tables of more than `rows_per_cell` rows for
    each cell are sampled for training only; every chunk is still assigned and
    searched."""
    dim = len(chunks.select("vector").first()["vector"])
    if n_cells * dim * 8 > MAX_BROADCAST_BYTES:
        raise ValueError(f"{n_cells} cells of {dim} dimensions are too many to send")
    total = chunks.count()
    wanted = n_cells * rows_per_cell
    rows = chunks.select("vector")
    if total > wanted:
        rows = rows.sample(fraction=wanted / total, seed=seed)
    # stored once, as every training step reads it again
    rows = materialize(rows, "training")
    features = rows.select(array_to_vector("vector").alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=20).fit(features)
    return np.array(model.clusterCenters())


def given_cells(cells: DataFrame) -> np.ndarray:
    """Centroids from a table `(cell, vector)`, numbered by rising `cell`. Measured
    before it is fetched, as centroids are sent to every task."""
    size = cells.agg(F.coalesce(F.sum(F.size("vector") * 8), F.lit(0)).alias("n")).first()["n"]
    if size > MAX_BROADCAST_BYTES:
        raise ValueError(f"centroids of {size} bytes are too many to send")
    return np.array([r["vector"] for r in cells.orderBy("cell").collect()], dtype=np.float64)


def nearest_cells(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The `n` nearest centroids of each unit row, nearest first."""
    lengths = np.einsum("ij,ij->i", centroids, centroids)
    nearest = np.empty((len(vectors), n), dtype=np.int64)
    step = max(1, _DISTANCES_AT_ONCE // len(centroids))
    for at in range(0, len(vectors), step):
        away = lengths[None, :] - 2.0 * vectors[at : at + step] @ centroids.T
        if n == 1:
            nearest[at : at + step, 0] = away.argmin(axis=1)
        else:
            nearest[at : at + step] = np.argsort(away, axis=1, kind="stable")[:, :n]
    return nearest


def assign_cells(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds `cell`, the nearest centroid."""
    sent = chunks.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cells = sent.value
        for batch in batches:
            if len(batch) == 0:
                yield pa.array([], pa.int32())
                continue
            unit = unit_rows(_vectors(batch, cells.shape[1]))
            yield pa.array(nearest_cells(unit, cells, 1)[:, 0], pa.int32())

    return chunks.withColumn("cell", run("vector"))


def write_cells(chunks: DataFrame, centroids: np.ndarray, target: str) -> DataFrame:
    """Store chunks in one directory per cell. The rebalance step splits a cell
    that holds much of the data and joins small ones."""
    (
        assign_cells(chunks, centroids)
        .hint("rebalance", "cell")
        .write.partitionBy("cell")
        .parquet(target)
    )
    schema = StructType(chunks.schema.fields + [StructField("cell", IntegerType())])
    return chunks.sparkSession.read.schema(schema).parquet(target)


def with_probes(queries: DataFrame, centroids: np.ndarray, n_probe: int) -> DataFrame:
    """Adds `cells`, the `n_probe` nearest cells of each request."""
    sent = queries.sparkSession.sparkContext.broadcast(centroids)
    wanted = min(n_probe, len(centroids))

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cells = sent.value
        for batch in batches:
            near = np.empty((0, wanted), np.int64)
            if len(batch):
                unit = unit_rows(_vectors(batch, cells.shape[1]).astype(np.float64))
                near = nearest_cells(unit, cells, wanted)
            ends = np.arange(0, near.size + 1, wanted, dtype=np.int32)
            yield pa.ListArray.from_arrays(ends, pa.array(near.ravel(), pa.int32()))

    return queries.withColumn("cells", run("vector"))


def top_chunks_in_cells(
    celled: DataFrame,
    queries: DataFrame,
    centroids: np.ndarray,
    n_probe: int,
    metric: str = "cosine",
    k: int = SEARCH_DEPTH,
    parts: int | None = None,
    uncelled: DataFrame | None = None,
) -> DataFrame:
    """Like `top_chunks`, reading only the probed cells. Chunks that have no
    cell yet (`uncelled`) are searched in full."""
    dim = centroids.shape[1]
    store = store_requests(with_probes(queries, centroids, n_probe), dim, k)
    if not store.rows:
        return top_chunks(celled, store, dim, metric, k)
    found = local_best(celled.filter(F.col("cell").isin(probed(store, celled))), store, metric, k)
    if uncelled is not None:
        found = found.unionByName(local_best(uncelled, replace(store, celled=False), metric, k))
    return merge_best(found, k, parts)


def cell_widths(celled: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The largest angle between a cell's centroid and a row of it; below zero for cells
    without rows. A row or a centroid of length zero makes a cell as wide as can be."""
    directions = unit_rows(centroids)
    sent = celled.sparkSession.sparkContext.broadcast(directions)

    @F.arrow_udf("double")
    def away(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, cells in batches:
            if len(cells) == 0:
                yield pa.array([], pa.float64())
                continue
            rows = unit_rows(_vectors(vectors, sent.value.shape[1]))
            centres = sent.value[cells.to_numpy()]
            angles = np.arccos(np.clip(np.einsum("ij,ij->i", rows, centres), -1, 1))
            angles[~rows.any(axis=1) | ~centres.any(axis=1)] = np.pi
            yield pa.array(np.where(np.isnan(angles), 0.0, angles))  # NaN never scores

    found = celled.select("cell", away("vector", "cell").alias("angle")).groupBy("cell")
    widths = np.full(len(centroids), -1.0)
    for row in found.agg(F.max("angle").alias("width")).collect():  # one row a cell
        widths[row["cell"]] = row["width"]
    return widths


def with_open_cells(requests: DataFrame, centroids: np.ndarray, widths: np.ndarray, metric: str) -> DataFrame:
    """`cells` replaced by those not in it that may hold a score at the cutoff or above."""
    sent = requests.sparkSession.sparkContext.broadcast((unit_rows(centroids), widths))

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        directions, wide = sent.value
        for vectors, seen, cutoffs in batches:
            if len(vectors) == 0:
                yield pa.array([], pa.list_(pa.int32()))
                continue
            rows = unit_rows(_vectors(vectors, directions.shape[1]).astype(np.float64))
            bars = _least_cosine(cutoffs.to_numpy(zero_copy_only=False).astype(np.float64), metric)
            angles = np.arccos(np.clip(rows @ directions.T, -1, 1))
            nearest = np.maximum(angles - wide - _ANGLE_SLACK, 0)
            may = np.cos(nearest) >= bars[:, None] - _ANGLE_SLACK
            may[~rows.any(axis=1)] = True  # a zero query scores zero everywhere
            may &= wide >= 0
            at = np.repeat(np.arange(len(rows)), seen.value_lengths().to_numpy())
            may[at, seen.flatten().to_numpy()] = False
            yield pa.array([np.flatnonzero(m).astype(np.int32) for m in may], pa.list_(pa.int32()))

    rest = [c for c in requests.columns if c != "cells"]
    return requests.select(*rest, run("vector", "cells", "cutoff").alias("cells"))


def top_chunks_bounded(
    celled: DataFrame,
    queries: DataFrame,
    centroids: np.ndarray,
    widths: np.ndarray,
    n_probe: int,
    metric: str = "cosine",
    k: int = SEARCH_DEPTH,
    parts: int | None = None,
    uncelled: DataFrame | None = None,
) -> DataFrame:
    """The rows of `top_chunks`, from the `n_probe` nearest cells of each request and then
    from every other cell that may hold a better hit than its `k`-th best. `widths` are
    those of `cell_widths`, or larger."""
    dim = centroids.shape[1]
    first = store_requests(with_probes(queries, centroids, n_probe), dim, k)
    if not first.rows:
        return top_chunks(celled, first, dim, metric, k)
    near = local_best(celled.filter(F.col("cell").isin(probed(first, celled))), first, metric, k)
    if uncelled is not None:
        near = near.unionByName(local_best(uncelled, replace(first, celled=False), metric, k))
    found = materialize(merge_best(near, k, parts).drop("rank"), "cells-near")
    asked = raised(stored_requests(first, celled), found, k)
    rest = with_open_cells(asked, centroids, widths, metric).filter(F.size("cells") > 0)
    second = store_requests(rest, dim, k)
    if second.rows:
        far = celled.filter(F.col("cell").isin(probed(second, celled)))
        found = found.unionByName(local_best(far, second, metric, k))
    return merge_best(found, k, parts)


def probed(store: RequestStore, celled: DataFrame) -> list[int]:
    """The cells that some request looks into; never more than there are cells."""
    stored = celled.sparkSession.read.schema("cells array<int>").parquet(*store.files)
    return sorted(r["cell"] for r in stored.select(F.explode("cells").alias("cell")).distinct().collect())


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits found, per query."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("_found"))
    return (
        exact.join(hit, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg(F.avg(F.coalesce("_found", F.lit(0))).alias("recall"))
    )
