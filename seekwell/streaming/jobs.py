"""Streaming jobs. Each micro-batch runs the batch plan; the stream checkpoint
takes the place of saved state."""

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..constants import SEARCH_DEPTH
from ..plans.index import SearchIndex
from ..plans.search import answers
from ..schemas import DELTA, REQUESTS
from ..session import discard, free_shuffles, materialize
from ..storage import Storage
from .latest import last_changes


def file_changes(
    spark: SparkSession, directory: str, files_per_batch: int | None = None, consume: bool = False
) -> DataFrame:
    """Stream of `(folder, path, content, op, seq)` rows from Parquet files. With `consume`
    files are removed after the batch that read them is done; a new checkpoint then has
    nothing to replay."""
    reader = spark.readStream.schema(DELTA)
    if consume:
        reader = reader.option("cleanSource", "delete")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(directory)


def requests(spark: SparkSession, directory: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REQUESTS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(directory)


def start_refresh(
    index: SearchIndex,
    changes: DataFrame,
    checkpoint: str,
    name: str,
    catch_up: bool = True,
    keyed: bool = True,
) -> StreamingQuery:
    """Keep the index current. A batch replayed after a failure is recognized by
    the commit that holds it, under the name and the id that the checkpoint gives the
    query. A new checkpoint therefore replays its input, which `seq` makes harmless.
    With `catch_up` the job ends when the input does.

    If `keyed`, the state of the stream holds the last change of every file, so a batch
    reads nothing that is stored. If anything else has written to the index since the
    stream started, or pattern files inside the snapshot decide, the stored manifest is
    read instead. Without `keyed` it always is: faster while the index is small, as a
    state is looked up file by file. A checkpoint keeps to the one it began with."""
    saved = Storage(index.spark, checkpoint)
    keyed = keyed and not index.rules.pattern_files

    def apply(batch: DataFrame, batch_id: int) -> None:
        changed = materialize(batch, "changes")  # read several times: keys, contents, chunks
        free_shuffles(batch)
        stream = f"{name}/{saved.read_json('metadata')['id']}"
        if keyed and (batch_id == 0 or index.follows(stream)):
            index.apply_last_changes(changed, stream, batch_id)
        else:
            index.apply_changes(changed, stream, batch_id)
        discard(changed)

    if keyed:
        started = saved.exists("metadata")
        heads = None if started or not index.versions() else index.heads()
        changes = last_changes(changes, lambda files: index.prepared(files, "seq"), heads)
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if keyed:
        writer = writer.outputMode("update")
    return (writer.trigger(availableNow=True) if catch_up else writer).start()


def start_answers(
    index: SearchIndex,
    incoming: DataFrame,
    target: str,
    checkpoint: str,
    k: int = SEARCH_DEPTH,
    catch_up: bool = True,
    patterns: Iterable[str] = (),
    pattern_files: DataFrame | None = None,
) -> StreamingQuery:
    """Answer a stream of requests from the last committed version. Each batch
    overwrites its own directory, so a replay leaves one answer per request. Patterns
    are as in `search_batch`."""
    patterns = tuple(patterns)

    def respond(batch: DataFrame, batch_id: int) -> None:
        asked = materialize(batch, "asked")  # read twice: for vectors and for texts
        told = answers(index, asked, k, patterns, pattern_files)
        told.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        discard(asked)

    writer = incoming.writeStream.foreachBatch(respond).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if catch_up else writer).start()
