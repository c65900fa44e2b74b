"""Connected components of an edge table by alternating star contraction.

Each round links, for every node, its larger neighbours and then its smaller ones
to the least neighbour. Rounds are written to the shared folder, so a lost
executor costs one round; only a count and a checksum reach the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

_MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """`edges` run from the larger id `u` to the smaller id `v`."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m")
    )
    linked = both.join(least, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").filter(F.col("v") != F.col("m"))
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.max(F.col("v")), F.min(F.col("v")),
        ).first()
    )


def connected_components(edges: DataFrame, left: str, right: str, label: str) -> DataFrame:
    """(node, component) for every node of an edge; `component` is the least node
    reachable. Loops, nulls and repeated edges do no harm; nodes without an edge to
    another node are not listed."""
    now = materialize(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        f"{label}-edges",
    )
    seen = _checksum(now)
    for _ in range(_MAX_ROUNDS):
        before = now
        now = materialize(_small_star(_large_star(before)), f"{label}-star")
        discard(before)
        mark = _checksum(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components of {label} did not settle in {_MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
