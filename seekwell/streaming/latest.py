"""The last change of every file, kept by Spark in the state store of a stream.

Per file the state holds the last `seq` and the hash of what is indexed. Files are dealt
to a fixed number of parts by a hash of their names, and a part is one value of the state:
looking up a value costs much more than a file in it. A micro-batch reads and writes the
parts of the files it names and no other, so its cost follows the batch and not the index.
State and input position are saved together, so a batch that is replayed sees the state it
saw the first time."""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import ids
from ..schemas import DELTA, FILES, require

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: `op` is U or D as given; `hash` and `content` are null where nothing is to be indexed.
HEADS = "folder string, path string, op string, seq long, content string, hash string, old_hash string"


#: Parts that files are dealt to. A checkpoint is only good for the number it began with.
PARTS = 4096
_SEEN = ["folder", "path", "op", "seq", "content", "hash"]


class _LastChanges(StatefulProcessor):
    """Last changes of the files of one part. The state is a JSON list of
    [folder, path, seq, hash]."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._files = handle.getValueState("files", "heads string")

    def _heads(self) -> dict[tuple, tuple]:
        stored = self._files.get()
        rows = json.loads(stored[0]) if stored else []
        return {(folder, path): (seq, hash_) for folder, path, seq, hash_ in rows}

    def _store(self, heads: dict[tuple, tuple]) -> None:
        self._files.update((json.dumps([(*file, *head) for file, head in heads.items()]),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        heads = self._heads()
        for folder, path, seq, hash_ in zip(*(initialState[c] for c in ("folder", "path", "seq", "hash"))):
            heads[_text(folder), _text(path)] = (None if _text(seq) is None else int(seq), _text(hash_))
        self._store(heads)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        named: dict[tuple, tuple[int, set, dict]] = {}
        for frame in rows:
            for folder, path, op, seq, content, hash_ in zip(*(frame[c] for c in _SEEN)):
                file, seq = (_text(folder), _text(path)), int(seq)
                if file not in named or seq > named[file][0]:
                    named[file] = (seq, set(), {})
                if seq < named[file][0]:
                    continue
                _, ops, kept = named[file]
                if _text(op) is not None:
                    ops.add(op)
                if _text(hash_) is not None:
                    kept[hash_] = content
        heads, last = self._heads(), []
        for file, (seq, ops, kept) in named.items():
            if len(ops) > 1:
                raise ValueError(f"a file is both stored and removed under one seq: {file}")
            if len(kept) > 1:
                raise ValueError(f"files were given with different contents: {file}")
            before, old_hash = heads.get(file, (None, None))
            if before is not None and seq < before:
                continue
            hash_, content = next(iter(kept.items()), (None, None))
            heads[file] = (seq, hash_)
            last.append((*file, ops.pop(), seq, content, hash_, old_hash))
        if last:
            self._store(heads)
            yield pd.DataFrame(last, columns=[*_SEEN, "old_hash"])

    def close(self) -> None:
        pass


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def last_changes(
    changes: DataFrame, prepare, heads: DataFrame | None, parts: int = PARTS
) -> DataFrame:
    """A stream of rows like `HEADS`: for every file that a micro-batch of `changes`
    names, its last change, unless a later one was seen before. `prepare` keeps the rows
    that an index takes, with their `hash`; `heads(folder, path, seq, hash)` is what the
    index holds when the stream first starts."""
    spark = changes.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)
    changes = require(changes, DELTA, "changes")
    known = F.col("op").isin("U", "D") & F.col("seq").isNotNull()
    said = F.concat(F.lit("change with op "), F.to_json(F.struct("op", "seq")))
    named = changes.select(
        "folder", "path", F.when(F.coalesce(known, F.lit(False)), F.col("op")).otherwise(F.raise_error(said)).alias("op"),
        "seq", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("hash"),
    )
    files = changes.filter("op = 'U'").withColumn("size", F.octet_length("content").cast("long"))
    kept = prepare(files.select(*[f.name for f in FILES.fields], "seq")).select(
        "folder", "path", F.lit(None).cast("string").alias("op"), "seq", "content", "hash"
    )
    part = F.pmod(F.xxhash64("folder", "path"), F.lit(parts)).alias("part")
    grouped = None
    if heads is not None:
        # a long with nulls would come as a double
        seq = F.col("seq").cast("string").alias("seq")
        grouped = heads.select(part, "folder", "path", seq, "hash").groupBy("part")
    return named.unionByName(kept).select("*", part).groupBy("part").transformWithStateInPandas(
        _LastChanges(), HEADS, "Update", "none", grouped
    )
