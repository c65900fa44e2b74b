"""Session helpers: settings, scratch space, size checks."""

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import MAX_BROADCAST_BYTES

_PACKAGE = "seekwell"
_CHECKPOINT_KEY = "spark.checkpoint.dir"
_FREEING_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SPLIT_BYTES = 128 * 1024 * 1024
_TASK_BYTES = 128 * 1024  # not worth a task below this


def local_session(cores: str = "*", app_name: str = "seekwell") -> SparkSession:
    """A session for one machine. On a cluster use the session you are given."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application. Not
    needed where it is installed there or passed with `--py-files`."""
    context = spark.sparkContext
    name = f"{_PACKAGE}-{context.applicationId}.zip"
    if any(path.endswith(name) for path in context._python_includes):
        return
    target = os.path.join(tempfile.mkdtemp(prefix=f"{_PACKAGE}-"), name)
    home = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(home):
            for file in names:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(target)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`.

    Only a local session without that setting gets a new temporary folder."""
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        _CHECKPOINT_KEY
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder shared by the cluster")
    created = tempfile.mkdtemp(prefix="seekwell-")
    spark.conf.set(_CHECKPOINT_KEY, created)
    return created


def new_scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is stored, not when the
    driver happens to collect its garbage."""
    before = spark.conf.get(_FREEING_KEY)
    spark.conf.set(_FREEING_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREEING_KEY, before)


def free_shuffles(df: DataFrame) -> None:
    """Remove the files of the last shuffles behind `df`, whose rows have been stored: for
    the batch of a stream with a state, whose plan `freeing_shuffles` does not reach. If
    they are asked for again all the same, Spark makes them anew."""
    components = df.sparkSession.sparkContext._jsc.sc().shuffleDriverComponents()
    left, seen = [df._jdf.queryExecution().toRdd()], set()
    while left:
        rdd = left.pop()
        if rdd.id() in seen:
            continue
        seen.add(rdd.id())
        needs = rdd.dependencies()
        for need in (needs.apply(k) for k in range(needs.size())):
            if need.getClass().getSimpleName() == "ShuffleDependency":
                components.removeShuffle(need.shuffleId(), False)
            else:
                left.append(need.rdd())


_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back: cuts the lineage and
    survives lost executors."""
    return materialize_all([df], label)


def materialize_all(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """The rows of all `parts`, at least one, written one after the other: only one of
    them has files of shuffles at a time."""
    target = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        target = target or new_scratch(spark, label)
        with freeing_shuffles(spark):
            df.write.mode("append").parquet(target)
    out = spark.read.schema(schema).parquet(target)
    _WRITTEN[out] = target
    return out


def discard(df: DataFrame) -> None:
    """Remove what `materialize` has written for `df`, once nothing will read it again."""
    target = _WRITTEN.pop(df, None)
    if target is not None:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(target)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fan_in(spark: SparkSession) -> int:
    """How many parts a per-query merge is split into before the last step."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


def input_bytes(df: DataFrame) -> int:
    """Size of the tables a plan reads, as the planner knows it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
    return sum(int(str(size)) for size in sizes)


def expected_tasks(df: DataFrame) -> int:
    """About how many tasks a scan of the tables of a plan has."""
    return -(-input_bytes(df) // _SPLIT_BYTES)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to more tasks if the input is smaller than one split per
    core, as a single row group is read by one task. Larger input is left as
    it is, so the shuffle is never bigger than cores x split size."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString():
        return df  # rows that tasks made: the plan's leaves do not tell their size
    size = input_bytes(df)
    if size >= cores * _SPLIT_BYTES:
        return df
    return df.repartition(max(1, min(cores, size // _TASK_BYTES)))


def broadcast_if_small(df: DataFrame, limit_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark a stored table for broadcast after measuring it, else leave the
    choice of join to the planner."""
    measured = df.agg(
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("n")
    ).first()
    return F.broadcast(df) if measured["n"] <= limit_bytes else df
