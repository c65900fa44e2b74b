"""Packing documents into embedding requests.

Within a shard documents come in path order; a request is closed when the next
document would take it over the chunk or token budget. A document larger than
the chunk budget gets a request of its own. The cut points depend on all
documents before them, which no window function can express, so each shard is
cut by one small task over `(path, n_tokens, n_chunks)` rows.

`pack_in_order` packs one sequence of all documents instead. What comes before a block
of documents matters to it only through the request that is still open, and that only
through the first document of the block that no longer fits. Few documents can be that
one, so a block is summed up as a function: from each of them to the number of requests
begun and to what is open at its end. The functions are composed in the order of blocks,
and then all blocks are numbered at once.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    MAX_CHUNKS_PER_REQUEST,
    MAX_TOKENS_PER_REQUEST,
    ROWS_PER_UPSERT,
)
from ..session import materialize

DOCUMENTS_PER_SHARD = 256
_BLOCK_BITS = 18  # documents of a block of the one sequence: a task handles one at a time


def path_shard(path: Column, n_shards: Column | int) -> Column:
    """Shard of a path by hash, so that no folder or source makes a big shard."""
    head = F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(n_shards) if isinstance(n_shards, int) else n_shards)


def with_shards(documents: DataFrame, per_shard: int = DOCUMENTS_PER_SHARD) -> DataFrame:
    """Adds `shard`; the number of shards follows the number of documents. Folder and
    path are hashed together, so a name that every folder has makes no big shard."""
    n = documents.count()
    whole = F.concat("folder", F.lit("/"), "path")
    return documents.withColumn("shard", path_shard(whole, max(1, -(-n // per_shard))))


def request_numbers(
    n_tokens: np.ndarray,
    n_chunks: np.ndarray,
    max_tokens: int = MAX_TOKENS_PER_REQUEST,
    max_chunks: int = MAX_CHUNKS_PER_REQUEST,
) -> np.ndarray:
    """Request number of each document in order, found by jumping from cut to
    cut over the running totals."""
    tokens = np.concatenate([[0], np.cumsum(n_tokens, dtype=np.int64)])
    chunks = np.concatenate([[0], np.cumsum(n_chunks, dtype=np.int64)])
    total = len(n_tokens)
    numbers = np.empty(total, dtype=np.int64)
    at = number = 0
    while at < total:
        fits = min(
            np.searchsorted(tokens, tokens[at] + max_tokens, side="right"),
            np.searchsorted(chunks, chunks[at] + max_chunks, side="right"),
        ) - 1
        end = max(int(fits), at + 1)
        numbers[at:end] = number
        at, number = end, number + 1
    return numbers


def pack_requests(
    documents: DataFrame,
    shard: str = "shard",
    max_tokens: int = MAX_TOKENS_PER_REQUEST,
    max_chunks: int = MAX_CHUNKS_PER_REQUEST,
) -> DataFrame:
    """`(shard, folder, path, n_tokens, n_chunks, request_no)`; documents over
    the token budget are left out. Request numbers count from 0 in each shard."""

    def cut(shard_rows: pd.DataFrame) -> pd.DataFrame:
        fitting = shard_rows[shard_rows["n_tokens"] <= max_tokens]
        ordered = fitting.sort_values(["path", "folder"], kind="stable")
        return ordered.assign(
            request_no=request_numbers(
                ordered["n_tokens"].to_numpy(), ordered["n_chunks"].to_numpy(),
                max_tokens, max_chunks,
            )
        )

    return (
        documents.select(
            F.col(shard).cast("long").alias("shard"), "folder", "path",
            F.col("n_tokens").cast("long").alias("n_tokens"),
            F.col("n_chunks").cast("long").alias("n_chunks"),
        )
        .groupBy("shard")
        .applyInPandas(
            cut,
            "shard long, folder string, path string, n_tokens long, n_chunks long, "
            "request_no long",
        )
    )


def _jumps(tokens: np.ndarray, chunks: np.ndarray, max_tokens: int, max_chunks: int):
    """Running totals before each document, and where the request that begins there ends."""
    t = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    c = np.concatenate([[0], np.cumsum(chunks, dtype=np.int64)])
    starts = np.arange(len(tokens))
    ends = np.minimum(
        np.searchsorted(t, t[:-1] + max_tokens, side="right"), np.searchsorted(c, c[:-1] + max_chunks, side="right")
    ) - 1
    return t, c, np.maximum(ends, starts + 1)


def block_function(
    tokens: np.ndarray, chunks: np.ndarray, max_tokens: int, max_chunks: int
) -> tuple[np.ndarray, ...]:
    """What a block does, for each document that can be the first not to fit into the
    request open before: `(document, totals with it, requests begun from it on, totals
    of the last of these)`. A document can only be the first if all before it fit, and
    one without size, other than the very first, never is. A last row stands for none:
    the open request takes the whole block."""
    t, c, ends = _jumps(tokens, chunks, max_tokens, max_chunks)
    size = len(tokens)
    requests, last = np.ones(size, np.int64), np.arange(size)
    for i in range(size - 1, -1, -1):  # from the end, as every jump goes forward
        if ends[i] < size:
            requests[i], last[i] = requests[ends[i]] + 1, last[ends[i]]
    fits = (t[:-1] <= max_tokens) & (c[:-1] <= max_chunks) & ((tokens > 0) | (chunks > 0))
    fits[0] = True
    first = np.flatnonzero(fits)
    rows = (first, t[first + 1], c[first + 1], requests[first], t[-1] - t[last[first]], c[-1] - c[last[first]])
    return tuple(np.append(column, end) for column, end in zip(rows, (size, t[-1], c[-1], 0, t[-1], c[-1])))


def compose(functions: pd.DataFrame, max_tokens: int, max_chunks: int) -> pd.DataFrame:
    """`(block, first, before)`: the document of each block that begins its first
    request, and the number of the request open before it. `functions` has the rows of
    all blocks in order."""
    out, tokens, chunks, number = [], 0, 0, -1
    for block, rows in functions.groupby("block", sort=False):
        with_t, with_c = rows["with_tokens"].to_numpy(), rows["with_chunks"].to_numpy()
        over = (tokens + with_t > max_tokens) | (chunks + with_c > max_chunks)
        over[-1] = False
        at = 0 if number < 0 else int(over.argmax()) if over.any() else len(rows) - 1
        row = rows.iloc[at]
        out.append((block, int(row["first"]), number))
        begun = int(row["requests"])
        number += begun
        open_tokens, open_chunks = int(row["open_tokens"]), int(row["open_chunks"])
        tokens = open_tokens if begun else tokens + open_tokens
        chunks = open_chunks if begun else chunks + open_chunks
    return pd.DataFrame(out, columns=["block", "first", "before"])


def pack_in_order(
    documents: DataFrame,
    max_tokens: int = MAX_TOKENS_PER_REQUEST,
    max_chunks: int = MAX_CHUNKS_PER_REQUEST,
) -> DataFrame:
    """`(folder, path, n_tokens, n_chunks, request_no)` for one sequence of all documents
    in order of path and folder; documents over the token budget are left out. The
    documents are sorted once over all tasks. The driver composes the blocks' functions,
    a few dozen rows for a quarter of a million documents."""
    sized = documents.select(
        "folder", "path", F.col("n_tokens").cast("long").alias("n_tokens"),
        F.col("n_chunks").cast("long").alias("n_chunks"),
    ).filter(F.col("n_tokens") <= max_tokens)
    ordered = sized.repartitionByRange("path", "folder").sortWithinPartitions("path", "folder")
    rows = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "packing-order")
    rows = rows.withColumn("block", F.shiftright("at", _BLOCK_BITS))

    def sum_up(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        names = ("first", "with_tokens", "with_chunks", "requests", "open_tokens", "open_chunks")
        sizes = (block["n_tokens"].to_numpy(), block["n_chunks"].to_numpy())
        columns = dict(zip(names, block_function(*sizes, max_tokens, max_chunks)))
        return pd.DataFrame({"block": block["block"].iloc[0], **columns})

    functions = rows.select("block", "at", "n_tokens", "n_chunks").groupBy("block").applyInPandas(
        sum_up,
        "block long, first long, with_tokens long, with_chunks long, requests long, open_tokens long, "
        "open_chunks long",
    )
    begun = compose(functions.orderBy("block", "first").toPandas(), max_tokens, max_chunks)
    schema = "block long, first long, before long"
    starts = rows.sparkSession.createDataFrame(begun, schema) if len(begun) else rows.sparkSession.createDataFrame([], schema)

    def number(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        first, before = int(block["first"].iloc[0]), int(block["before"].iloc[0])
        numbers = np.full(len(block), before, np.int64)
        rest = request_numbers(
            block["n_tokens"].to_numpy()[first:], block["n_chunks"].to_numpy()[first:], max_tokens, max_chunks
        )
        numbers[first:] = before + 1 + rest
        return block[["folder", "path", "n_tokens", "n_chunks"]].assign(request_no=numbers)

    return rows.join(F.broadcast(starts), "block").groupBy("block").applyInPandas(
        number, "folder string, path string, n_tokens long, n_chunks long, request_no long"
    )


def request_sums(packed: DataFrame) -> DataFrame:
    return packed.groupBy("shard", "request_no").agg(
        F.sum("n_tokens").alias("tokens"),
        F.sum("n_chunks").alias("chunks"),
        F.count("*").alias("documents"),
    )


def fixed_batches(
    rows: DataFrame, shard: str, order: list[str], size: int = ROWS_PER_UPSERT
) -> DataFrame:
    """Adds `batch_no`: consecutive groups of `size` rows in each shard."""
    position = F.row_number().over(Window.partitionBy(shard).orderBy(*order))
    return rows.withColumn("batch_no", F.floor((position - 1) / size).cast("long"))
