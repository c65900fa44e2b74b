"""Exact top-k scoring of a chunk table against a set of requests.

The chunk table is scanned once and never shuffled, whatever the number of requests.
Requests do not pass through the driver: Spark writes them to the shared folder as
numbered Parquet files of bounded size, the blocks. Every task cuts its part of the
chunks into segments, multiplies each segment by one block after the other, and keeps
only its best `k` rows per query. What a query already has in a task is the bar for the
task's next segment. Those few rows are then merged by query. No row pairs are formed
outside the matrix product.

With very many tasks, tasks x queries x k rows would still leave them. A first look at a
share of the chunks then gives every query a floor: the k-th best score of any part of
the chunks is a lower bound of the k-th best of all.

With very many requests a hit list per task and query costs more than the chunks themselves.
The roles then change: keys and vectors of the chunks are written once to the shared
folder, every task takes some requests and reads all chunks, a batch at a time, so that
it alone holds what its requests have, and `k` rows per query leave the tasks in all.

Products are formed in single precision. What comes within their largest error of the bar
is scored in double precision, so hits and scores are those of double precision.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..constants import (
    MAX_BROADCAST_BYTES,
    MAX_KEPT_HITS,
    RANK_DECIMALS,
    SEARCH_DEPTH,
)
from ..functions.ids import FOLDER_PARTS, folder_part
from ..schemas import HITS
from ..session import expected_tasks, fan_in, input_bytes, materialize, new_scratch
from .embedding import unit_rows

METRICS = ("cosine", "l2sim")
_ROWS_AT_ONCE = 2048
_QUERIES_AT_ONCE = 1024
_SEGMENT_BYTES = 64 * 1024 * 1024  # of chunk vectors that a task holds at a time
_HIT_SCHEMA = pa.schema([
    ("query_id", pa.int64()),
    ("folder", pa.string()),
    ("path", pa.string()),
    ("chunk_id", pa.string()),
    ("chunk_index", pa.int32()),
    ("score", pa.float64()),
])
_FLOOR_TASKS = 64  # from this many tasks on, a search looks for floors first
_FLOOR_SHARE = 0.2
_HIT_BYTES = 4096  # read in about the time in which a hit is made, moved and ranked
_QUERIES_PER_TASK = 4096  # at most, where tasks take requests
_LEAST_QUERIES = 512  # that are worth reading all chunks for
_EXACT_SHARE = 32  # from one pair in so many on, all are scored in double precision
_PAIRS_AT_ONCE = 1024
_PAYLOAD = ["folder", "path", "chunk_id", "chunk_index"]
_REQUEST = ["query_id", "folder", "cutoff", "vector"]


@dataclass(frozen=True)
class RequestStore:
    """Requests in the shared folder. `files` are its blocks; `parts` are the parts of
    folders asked for, of `FOLDER_PARTS`, and `between` the first and last folder, None if some request asks
    for all; `celled` tells whether each request names the cells it may look into."""

    files: tuple[str, ...]
    rows: int
    dim: int
    parts: tuple[int, ...] | None
    between: tuple[str, str] | None
    celled: bool = False

    def visible(self, chunks: DataFrame) -> DataFrame:
        """The chunks that some request may see, as far as the names' range tells."""
        if self.between is not None:
            first, last = self.between
            name = F.col("folder")
            chunks = chunks.filter(name == first if first == last else name.between(first, last))
        return chunks


def block_limit(dim: int, k: int) -> int:
    """How many requests of this dimension one block may hold, if `k` hits of each are
    kept."""
    return max(1, min(MAX_KEPT_HITS // k, MAX_BROADCAST_BYTES // (8 * dim)))


def store_requests(requests: DataFrame, dim: int, k: int = SEARCH_DEPTH) -> RequestStore:
    """Write `requests(query_id, folder, cutoff, vector)`, and `cells` if there is such
    a column, in blocks of at most `block_limit(dim, k)` rows. Small partitions are put
    together first, so that blocks are few. What the driver learns is counted while the
    rows are written: their number, and which folders they are about."""
    spark = requests.sparkSession
    celled = "cells" in requests.columns
    rows = requests.select(*_REQUEST, *(["cells"] if celled else []))
    seen = Observation()
    masks = F.call_function("shiftleft", F.lit(1).cast("long"), folder_part(F.col("folder")))
    watched = rows.hint("rebalance").observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("folder").isNull()).alias("anywhere"),
        F.min("folder").alias("first"), F.max("folder").alias("last"), F.bit_or(masks).alias("parts"),
    )
    target = new_scratch(spark, "requests")
    watched.write.option("maxRecordsPerFile", block_limit(dim, k)).parquet(target)
    told = seen.get
    if not told["rows"]:
        return RequestStore((), 0, dim, None, None, celled)
    files = tuple(sorted(spark.read.schema(rows.schema).parquet(target).inputFiles()))
    if told["anywhere"]:
        return RequestStore(files, told["rows"], dim, None, None, celled)
    parts = tuple(p for p in range(FOLDER_PARTS) if told["parts"] >> p & 1)
    return RequestStore(files, told["rows"], dim, parts, (told["first"], told["last"]), celled)


@dataclass(frozen=True)
class QueryBlock:
    """The requests of one block in a task's memory; `cells` are the cells each may
    look into."""

    ids: np.ndarray
    folders: list[str | None]
    cutoffs: np.ndarray
    matrix: np.ndarray
    cells: list[frozenset] | None = None

    @cached_property
    def single(self) -> np.ndarray:
        return self.matrix.astype(np.float32)

    def part(self, first: int, last: int) -> "QueryBlock":
        at = slice(first, last)
        cells = None if self.cells is None else self.cells[at]
        return QueryBlock(self.ids[at], self.folders[at], self.cutoffs[at], self.matrix[at], cells)


def read_block(uri: str, dim: int, celled: bool = False) -> QueryBlock:
    """One block of a store; a local file is mapped, not copied. Runs in tasks."""
    fs, path = pafs.FileSystem.from_uri(uri)
    table = pq.read_table(path, filesystem=fs, memory_map=True, partitioning=None)
    cutoffs = table["cutoff"].to_numpy().astype(np.float64)
    vectors = table["vector"]
    vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    return QueryBlock(
        ids=table["query_id"].to_numpy(),
        folders=table["folder"].to_pylist(),
        cutoffs=np.where(np.isnan(cutoffs), -np.inf, cutoffs),
        matrix=unit_rows(_vectors(vectors, dim).astype(np.float64)),
        cells=[frozenset(c) for c in table["cells"].to_pylist()] if celled else None,
    )


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column as a matrix view; wrong lengths raise."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if not (lengths == dim).all():
        raise ValueError(f"vectors do not all have {dim} entries")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


class _Best:
    """The best `k` hits per query seen so far by one task."""

    def __init__(self, n_queries: int, k: int, cutoffs: np.ndarray):
        self.k = k
        self.bars = cutoffs.copy()
        self.parts: list[pa.Table] = []
        self.waiting = 0
        self.room = max(2 * k * n_queries, 16_384)

    def offer(self, payload: pa.RecordBatch, rows, columns, scores) -> None:
        table = pa.Table.from_batches([payload.take(pa.array(rows))])
        table = table.append_column("query", pa.array(columns, pa.int32()))
        self.parts.append(table.append_column("score", pa.array(scores, pa.float64())))
        self.waiting += len(rows)
        if self.waiting > self.room:
            self.shrink()

    def shrink(self) -> pa.Table | None:
        if not self.parts:
            return None
        table = pa.concat_tables(self.parts)
        order = pc.sort_indices(table, sort_keys=[
            ("query", "ascending"), ("score", "descending"), ("chunk_id", "ascending"),
        ])
        query = table["query"].to_numpy()[order.to_numpy()]
        starts = np.searchsorted(query, query, side="left")
        kept = table.take(order.filter(pa.array(np.arange(len(query)) - starts < self.k)))
        found, counts = np.unique(kept["query"].to_numpy(), return_counts=True)
        full = counts >= self.k
        if full.any():
            last = np.cumsum(counts)[full] - 1
            worst = kept["score"].to_numpy()[last]
            self.bars[found[full]] = np.maximum(self.bars[found[full]], worst)
        self.parts, self.waiting = [kept], kept.num_rows
        return kept


def _score(cosine: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2sim":
        # squared distance of unit vectors, then distance to similarity
        cosine = 1.0 / (1.0 + (2.0 - 2.0 * cosine))
    return np.round(cosine, RANK_DECIMALS)


def _least_cosine(cutoffs: np.ndarray, metric: str) -> np.ndarray:
    """The cosine that a score at the cutoff has; NaN stands for no cutoff."""
    if metric == "l2sim":
        positive = cutoffs > 0
        cutoffs = np.where(positive, 1.5 - 0.5 / np.where(positive, cutoffs, 1.0), -np.inf)
    return np.where(np.isnan(cutoffs), -np.inf, cutoffs)


def _slack(dim: int) -> float:
    """More than a product of unit vectors in single precision, or the rounding of a score,
    can be off: `dim` additions and the rounding of both vectors, twice."""
    return (dim + 8) * 2.0**-23 + 1e-7


def _pair_cosines(unit: np.ndarray, asked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Products in double precision of some pairs, or of all if some are many."""
    if len(rows) * _EXACT_SHARE > len(unit) * len(asked):
        return (unit @ asked.T)[rows, columns]
    out = np.empty(len(rows))
    for at in range(0, len(rows), _PAIRS_AT_ONCE):
        some = slice(at, at + _PAIRS_AT_ONCE)
        np.einsum("ij,ij->i", unit[rows[some]], asked[columns[some]], out=out[some])
    return out


def _offer_group(best, block, payload, matrix, rows, queries, metric) -> None:
    """Score some rows of a batch against some queries, both in parts, so that the
    matrix of scores stays small."""
    slack = _slack(matrix.shape[1])
    for at in range(0, len(rows), _ROWS_AT_ONCE):
        part = rows[at : at + _ROWS_AT_ONCE]
        # doubles for one part at a time; every row is in one group only
        unit = unit_rows(matrix[part])
        single = unit.astype(np.float32)
        for begin in range(0, len(queries), _QUERIES_AT_ONCE):
            asked = queries[begin : begin + _QUERIES_AT_ONCE]
            near = single @ block.single[asked].T
            bars = best.bars[asked]
            least = (_least_cosine(bars, metric) - slack).astype(np.float32)
            hits = near >= least  # false for NaN
            if len(part) > 2 * best.k and np.count_nonzero(hits) > best.k * len(asked):
                # nothing below the k-th best of this part can be in the result
                comparable = np.where(np.isnan(near), -np.inf, near)
                kth = np.partition(comparable, -best.k, axis=0)[-best.k] - np.float32(2 * slack)
                hits = near >= np.maximum(least, kth)
            hit_rows, hit_columns = np.divmod(np.flatnonzero(hits), len(asked))
            if not len(hit_rows):
                continue
            scores = _score(_pair_cosines(unit, block.matrix[asked], hit_rows, hit_columns), metric)
            kept = scores >= bars[hit_columns]
            if kept.any():
                best.offer(payload, part[hit_rows[kept]], asked[hit_columns[kept]], scores[kept])


class _Audience:
    """Which queries of a block may see a row, by its folder and cell."""

    def __init__(self, block: QueryBlock):
        self._block = block
        self._by_folder: dict[str | None, list[int]] = {}
        for query, folder in enumerate(block.folders):
            self._by_folder.setdefault(folder, []).append(query)
        self._known: dict[tuple, np.ndarray] = {}
        self._everywhere = set(self._by_folder) == {None} and block.cells is None

    def of(self, folder: str | None, cell: int | None) -> np.ndarray:
        key = (folder if folder in self._by_folder else None, cell)
        if key not in self._known:
            queries = set(self._by_folder.get(None, [])) | set(self._by_folder.get(key[0], []))
            if cell is not None:
                queries = {q for q in queries if cell in self._block.cells[q]}
            self._known[key] = np.array(sorted(queries), dtype=np.int64)
        return self._known[key]

    def groups(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of a batch with their queries; each row comes at most once."""
        if self._everywhere:
            yield np.arange(batch.num_rows), self.of(None, None)
            return
        coded = batch.column("folder").dictionary_encode()
        folders = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cells = np.zeros(batch.num_rows, dtype=np.int64)
        if self._block.cells is not None:
            cells = batch.column("cell").to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((codes, cells))
        changes = np.flatnonzero((np.diff(codes[order]) != 0) | (np.diff(cells[order]) != 0)) + 1
        for rows in np.split(order, changes):
            cell = int(cells[rows[0]]) if self._block.cells is not None else None
            queries = self.of(folders[codes[rows[0]]], cell)
            if len(queries):
                yield rows, queries


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in runs of about `_SEGMENT_BYTES`."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= _SEGMENT_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _offer_all(
    best: _Best, block: QueryBlock, audience: _Audience, segment: list[pa.RecordBatch], metric: str
) -> None:
    for batch in segment:
        if batch.num_rows == 0:
            continue
        matrix = _vectors(batch.column("vector"), block.matrix.shape[1])
        payload = batch.select(_PAYLOAD)
        for rows, seen_by in audience.groups(batch):
            _offer_group(best, block, payload, matrix, rows, seen_by, metric)


def _hits(kept: pa.Table | None, block: QueryBlock) -> pa.Table:
    if kept is None:
        return _HIT_SCHEMA.empty_table()
    ids = pa.array(block.ids[kept["query"].to_numpy()])
    table = kept.drop_columns(["query"]).append_column("query_id", ids)
    return table.select(_HIT_SCHEMA.names).cast(_HIT_SCHEMA)


def local_best(chunks: DataFrame, store: RequestStore, metric: str, k: int) -> DataFrame:
    """Each task's best hits per query, at most `k` of a segment. The scan reads only key
    columns and vectors, and only the folders asked for."""
    chunks = store.visible(chunks)
    columns = [*_PAYLOAD, "vector", *(["cell"] if store.celled else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(store.files) == 1:  # its hits stay in the task until the end
            block = read_block(store.files[0], store.dim, store.celled)
            best, audience = _Best(len(block.ids), k, block.cutoffs), _Audience(block)
            for batch in batches:
                _offer_all(best, block, audience, [batch], metric)
            yield from _hits(best.shrink(), block).to_batches()
            return
        bars: dict[str, np.ndarray] = {}
        for segment in _segments(batches):
            for uri in store.files:
                block = read_block(uri, store.dim, store.celled)
                best = _Best(len(block.ids), k, bars.get(uri, block.cutoffs))
                _offer_all(best, block, _Audience(block), segment, metric)
                kept = best.shrink()
                bars[uri] = best.bars
                yield from _hits(kept, block).to_batches()

    return chunks.select(*columns).mapInArrow(run, HITS)


def _queries_per_task(store: RequestStore, spark) -> int:
    """Requests that a task takes, so that there are some tasks for each core."""
    wanted = max(_LEAST_QUERIES, store.rows // (2 * spark.sparkContext.defaultParallelism))
    return min(wanted, _QUERIES_PER_TASK)


def _takes_requests(chunks: DataFrame, store: RequestStore, k: int) -> bool:
    """Whether reading all chunks for every few requests costs less than the hits that
    tasks of chunks would give, and keeps the cores busy. The result is the same."""
    if len(store.files) < 2 or store.celled:
        return False
    spark = chunks.sparkSession
    cores = spark.sparkContext.defaultParallelism
    takers = -(-store.rows // _queries_per_task(store, spark))
    reads = input_bytes(chunks) * takers
    hits = max(expected_tasks(chunks), cores) * store.rows * k
    return 4 * takers >= cores and reads < hits * _HIT_BYTES


def best_of_requests(chunks: DataFrame, store: RequestStore, metric: str, k: int) -> DataFrame:
    """The hits of every request at its cutoff or above, at most `k`, each request's from
    one task, with `rank` among them."""
    spark = chunks.sparkSession
    written = materialize(store.visible(chunks).select(*_PAYLOAD, "vector"), "chunk-vectors")
    files = sorted(written.inputFiles())
    limit = block_limit(store.dim, k)
    slices = -(-limit // _queries_per_task(store, spark))
    taken = -(-limit // slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (n for batch in batches for n in batch.column(0).to_pylist()):
            first = number % slices * taken
            block = read_block(store.files[number // slices], store.dim).part(first, first + taken)
            if not len(block.ids):
                continue
            best, audience = _Best(len(block.ids), k, block.cutoffs), _Audience(block)
            for uri in files:
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as source:
                    for part in pq.ParquetFile(source).iter_batches(_ROWS_AT_ONCE * 4):
                        _offer_all(best, block, audience, [part], metric)
            kept = best.shrink()
            if kept is None:
                continue
            query = kept["query"].to_numpy()
            rank = np.arange(len(query)) - np.searchsorted(query, query, side="left") + 1
            table = _hits(kept, block).append_column("rank", pa.array(rank, pa.int32()))
            yield from table.combine_chunks().to_batches(16_384)

    count = len(store.files) * slices
    return spark.range(0, count, 1, count).mapInArrow(run, StructType([*HITS.fields, StructField("rank", IntegerType())]))


def merge_best(hits: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """The best `k` hits per query of all tasks, with `rank`.

    With many tasks one query still has tasks x k rows, so they are first cut
    down in hash parts of the chunk id, in parallel, and then by query."""
    parts = fan_in(hits.sparkSession) if parts is None else parts
    order = [F.desc("score"), F.asc("chunk_id")]
    if parts > 1:
        part = F.pmod(F.xxhash64("chunk_id"), F.lit(parts))
        hits = (
            hits.withColumn("_part", part)
            .withColumn(
                "_rn", F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*order))
            )
            .filter(F.col("_rn") <= k)
            .drop("_part", "_rn")
        )
    return hits.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    ).filter(F.col("rank") <= k)


def raised(requests: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """`requests` with the cutoff at the `k`-th best score of `found`, for those that have
    `k` hits there."""
    bars = found.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_bar"))
    bars = bars.filter(F.col("_n") >= k).drop("_n")
    higher = F.greatest("cutoff", "_bar").alias("cutoff")
    rest = [c for c in requests.columns if c != "cutoff"]
    return requests.join(bars, "query_id", "left").select(*rest, higher)


def stored_requests(store: RequestStore, chunks: DataFrame) -> DataFrame:
    return chunks.sparkSession.read.parquet(*store.files)


def floor_share(chunks: DataFrame) -> float | None:
    """The share of the chunks to look for floors in, None if there are few tasks. About
    k / share rows a query pass the floor, so a smaller share does with more tasks."""
    tasks = expected_tasks(chunks)
    if not _FLOOR_TASKS <= tasks < 2**30:  # unknown sizes are huge
        return None
    return min(_FLOOR_SHARE, 2 / tasks**0.5)


def with_floors(
    chunks: DataFrame, store: RequestStore, metric: str, k: int, share: float, seed: int = 29
) -> RequestStore:
    """The requests with cutoffs raised to their `k`-th best score in a share of the
    chunks; ties with it stay, so the result of a search does not change."""
    some = chunks.sample(fraction=share, seed=seed)
    found = materialize(merge_best(local_best(some, store, metric, k), k), "floors")
    return store_requests(raised(stored_requests(store, chunks), found, k), store.dim, k)


def top_chunks(
    chunks: DataFrame,
    queries: DataFrame | RequestStore,
    dim: int,
    metric: str = "cosine",
    k: int = SEARCH_DEPTH,
    parts: int | None = None,
    share: float | None = None,
) -> DataFrame:
    """Best `k` chunks per query at or above its cutoff, with `rank`.

    `queries(query_id, folder, cutoff, vector)`: a null folder searches all, a
    null cutoff keeps all. Ties go to the smaller chunk id. Applying the cutoff
    before the limit gives the same rows as after it. With `share` floors are sought in
    that share of the chunks first; the result is the same."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    if k < 1:
        raise ValueError("k must be positive")
    store = queries if isinstance(queries, RequestStore) else store_requests(queries, dim, k)
    if not store.rows:
        empty = chunks.sparkSession.createDataFrame([], HITS)
        return empty.withColumn("rank", F.lit(0))
    if _takes_requests(chunks, store, k):
        found = best_of_requests(chunks, store, metric, k)
        ids = stored_requests(store, chunks).groupBy("query_id").count()
        # requests of one id share its hits
        return found if ids.filter("count > 1").isEmpty() else merge_best(found.drop("rank"), k, parts)
    if share is not None:
        store = with_floors(chunks, store, metric, k, share)
    return merge_best(local_best(chunks, store, metric, k), k, parts)


def best_files(top: DataFrame) -> DataFrame:
    """Best score per file of the chunks found, ranked by score then path.

    The rows are already placed by query, so neither step shuffles again."""
    scored = top.groupBy("query_id", "folder", "path").agg(
        F.max("score").alias("score"),
        F.min_by("chunk_id", "rank").alias("chunk_id"),
        F.min_by("chunk_index", "rank").alias("chunk_index"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "folder")
    return scored.withColumn("rank", F.row_number().over(order))
