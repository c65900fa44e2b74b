"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors, padded to a power of two, go through pseudo-rotations (three rounds of
random signs and a fast Hadamard transform); a vector belongs to the signed axis that
is nearest to its image. Each table is one rotation. A query probes, in every table,
the axes nearest to its own image. All vectors of a probed bucket are compared exactly
on the original vectors, and the best of all buckets win.

Equal vectors are indexed once, with their `k + 1` least ids: no query needs more of
them, so a vector with very many copies is no hot bucket. Buckets are dealt in blocks
of bounded size, each with the queries that probe it; a block returns `k` rows per
query, whatever its size. Nothing is capped: every member of a probed bucket is
compared.

Vectors that are null, zero or hold null or non-finite components take no part; vectors
must have one length, others raise an error. Repeated rows of one id are one row.
A query that finds fewer than k others then probes every axis of one table, which meets
all vectors; so with fewer than k others all of them are returned. Ties go to the smaller
id. Extra columns are ignored; an empty table gives an empty result."""

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import group_bounds, runs, small_batches
from .vectors import matrix, unit, usable


@dataclass(frozen=True)
class Index:
    tables: int = 10
    probes: int = 20
    block: int = 512  # rows of a bucket in one task
    seed: int = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal."""
    n, d = x.shape
    step = 1
    while step < d:
        pair = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotated(vectors: np.ndarray, table: int, seed: int) -> np.ndarray:
    size = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    image = np.zeros((len(vectors), size))
    image[:, : vectors.shape[1]] = unit(vectors)
    rng = np.random.default_rng([seed, table])
    for _ in range(3):
        image = hadamard(image * rng.choice([-1.0, 1.0], size))
    return image


def nearest_axes(image: np.ndarray, count: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: axis i is 2i, its opposite
    2i + 1."""
    signed = np.empty((len(image), 2 * image.shape[1]))
    signed[:, 0::2], signed[:, 1::2] = image, -image
    return np.argsort(-signed, axis=1, kind="stable")[:, :count]


def _assigned(rows: DataFrame, index: Index, probes: int, names: list[str]) -> DataFrame:
    """`rows` once for each table and axis: columns bucket and `names`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = matrix(batch.column("vector"))
            for table in range(index.tables):
                image = rotated(vectors, table, index.seed)
                axes = nearest_axes(image, min(probes, 2 * image.shape[1]))
                take = pa.array(np.repeat(np.arange(len(axes)), axes.shape[1]))
                bucket = pa.array((axes + table * 2 * image.shape[1]).ravel().astype(np.int64))
                cols = [batch.column(n).take(take) for n in names]
                yield pa.RecordBatch.from_arrays([bucket, *cols], ["bucket", *names])

    from pyspark.sql.types import LongType, StructType

    schema = StructType().add("bucket", LongType())
    for n in names:
        schema = schema.add(rows.schema[n])
    return rows.select(*names).mapInArrow(run, schema)


def _best(ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by distance, then id."""
    if len(ids) > 4 * k:
        edge = np.partition(dist, k - 1)[k - 1]
        near = np.flatnonzero(dist <= edge)
        return near[np.lexsort((ids[near], dist[near]))[:k]]
    return np.lexsort((ids, dist))[:k]


def distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def _distinct(rows: DataFrame, ids: int) -> DataFrame:
    """(first, ids, vector): each distinct vector with its least ids. Ranks are cut
    first in salted parts, so that a common vector loads no task."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    for part in (["vector", "salt"], ["vector"]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy("vec_id"))
        salted = salted.withColumn("rank", rank).filter(F.col("rank") <= ids).drop("rank")
    return salted.groupBy("vector").agg(
        F.min("vec_id").alias("first"), F.array_sort(F.collect_list("vec_id")).alias("ids")
    )


def neighbours(
    rows: DataFrame, queries: DataFrame, k: int = 10, index: Index = Index()
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each query.

    Both tables have vec_id and embedding; a query may be one of the rows."""
    small_batches(rows.sparkSession, 2000)
    good = usable(rows)
    distinct = materialize(_distinct(good, k + 1), "ann-distinct")
    asked = materialize(usable(queries).dropDuplicates(["vec_id"]), "ann-queries")
    found = materialize(_probed(distinct, asked, k, index), "ann-found")
    short = asked.join(found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    short = materialize(short, "ann-short")
    if short.isEmpty():
        return found
    whole = _probed(distinct, short, k, replace(index, tables=1, probes=1 << 30))
    enough = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return enough.select(*found.columns).unionByName(whole)


def _probed(distinct: DataFrame, asked: DataFrame, k: int, index: Index) -> DataFrame:
    """The k nearest other rows in the buckets that each query probes, ranked."""
    members = _assigned(distinct, index, 1, ["first", "ids", "vector"])
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / index.block).cast("int")
    sizes = materialize(sizes.select("bucket", blocks.alias("blocks")), "ann-sizes")
    probes = _assigned(asked, index, index.probes, ["vec_id", "vector"])
    probes = probes.join(sizes, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(1).alias("side"), F.col("vec_id").alias("id"),
        F.array().cast("array<long>").alias("ids"), "vector",
    )
    members = members.join(sizes, "bucket").select(
        "bucket", F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int").alias("block"),
        F.lit(0).alias("side"), F.col("first").alias("id"), "ids", "vector",
    )
    keys = ["bucket", "block"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, keys):
            side = part.column("side").to_numpy()
            bounds = group_bounds(part, keys)
            for start, end in zip(bounds[:-1], bounds[1:]):
                split = start + int((side[start:end] == 0).sum())
                if split in (start, end):
                    continue
                group = part.slice(start, split - start)
                vectors = matrix(group.column("vector"))
                lists = group.column("ids").combine_chunks()
                owner = lists.value_parent_indices().to_numpy()
                ids = lists.flatten().to_numpy()
                asking = part.slice(split, end - split)
                names, wanted = asking.column("id").to_numpy(), matrix(asking.column("vector"))
                found = []
                for name, query in zip(names, wanted):
                    dist = distances(query, vectors)[owner]
                    near = _best(ids, dist, k + 1)
                    near = near[ids[near] != name][:k]
                    found.append((np.full(len(near), name), ids[near], dist[near]))
                q, v, d = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_pydict({"query_id": q, "vec_id": v, "score": d})

    dealt = members.unionByName(probes).repartition(*keys).sortWithinPartitions(*keys, "side")
    found = dealt.mapInArrow(compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
