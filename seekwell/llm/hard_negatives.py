"""Hard negatives by exact integer scores from a residue number system.

Components become whole numbers, and a score is an inner product of two rows of them.
The matrices are reduced modulo several primes. For each prime a product of residue
matrices in float32 is exact, as residues are taken around zero and primes are small
enough for all sums to stay below 2^24. The residues of a score are put together by
Chinese remaindering in mixed radix, and the sign comes from the leading digits. As many
primes are used as the largest possible score asks for, so scores are exact and equal on
every machine and in every order of summation.

Anchors are compared with all rows in cells: anchors are dealt to blocks and rows to
parts, both by hash, and each cell is one block with one part. Cells have a fixed size
in rows, so their number grows with the table, and no task holds more than one cell. In
a first round each cell gives its best rows of the same label per anchor; merged, these
are the positives. They fix windows of scores, and in a second round each cell gives its
best rows of another label per window. Only these few rows leave a cell.

Rows with a null vec_id or label, or a null vector, an empty one, or one that holds null
or non-finite components, take no part; nor do rows with a component whose whole number
is so large (2^28 or more at 64 dimensions) that a score would not fit a long. Zero
vectors do. Repeated rows count once. Rows that share an id with the anchor are its own
rows and are not compared with it. Equal scores are ordered by vec_id, and among rows of
one id the best counts first. Vectors must have one length; other columns are ignored;
an empty table, or one without anchors, gives no rows."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fan_in, materialize
from .common import group_bounds, runs
from .vectors import finite

_NONE = np.iinfo(np.int64).min
_CELL = ["block", "part"]


@dataclass(frozen=True)
class Mining:
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50  # percent of the positive's score
    high: int = 95
    block: int = 16_384  # anchors of a cell
    part: int = 65_536  # rows of a cell


# -- residues ---------------------------------------------------------------------------


def primes_for(size: int, largest: int) -> list[int]:
    """The largest primes whose residue products of `size` terms float32 adds exactly,
    as many as tell apart all scores up to `largest` on both sides of zero."""
    limit = min(2047, 2 * int(np.sqrt(2**24 / max(size, 1))) + 1)
    found, product = [], 1
    for candidate in range(limit, 2, -1):
        if product > 2 * largest + 1:
            break
        if all(candidate % d for d in range(2, int(candidate**0.5) + 1)):
            found.append(candidate)
            product *= candidate
    if product <= 2 * largest + 1:
        raise ValueError(f"scores of {size} components up to {largest} have too few primes")
    return found


def residues(whole: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The matrix modulo each prime, around zero, as float32."""
    out = []
    for p in primes:
        rest = np.mod(whole, p)
        out.append(np.where(rest > p // 2, rest - p, rest).astype(np.float32))
    return out


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """left right', exact, from the residues of both."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        digit = np.mod((left[i] @ right[i].T).astype(np.int32), np.int32(p))
        # the digit of the mixed radix: what is left of the residue after the earlier ones
        for earlier, q in zip(digits, primes):
            digit = np.mod((digit - earlier) * np.int32(pow(q, -1, p)), np.int32(p))
        digits.append(digit)
    # the largest positive number has the digits (p - 1) / 2, so a number stands for a
    # negative one if the first of its digits from the top that differs is larger
    negative = np.zeros(digits[0].shape, bool)
    undecided = ~negative
    for digit, p in zip(reversed(digits), reversed(primes)):
        half = (p - 1) // 2
        negative |= undecided & (digit > half)
        undecided &= digit == half
    total = np.zeros(digits[0].shape, np.uint64)
    weight = 1
    for digit, p in zip(digits, primes):
        total += digit.astype(np.uint64) * np.uint64(weight % 2**64)  # modulo 2^64
        weight *= p
    total -= np.where(negative, np.uint64(weight % 2**64), np.uint64(0))
    return total.view(np.int64)


# -- cells ------------------------------------------------------------------------------


def _best(scores: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) of the best `count` scores of each row, round by round; the first
    column wins a tie. `scores` is used up."""
    rows = np.arange(len(scores))
    for _ in range(min(count, scores.shape[1])):
        at = scores.argmax(axis=1)
        found = scores[rows, at] != _NONE
        if not found.any():
            return
        yield rows[found], at[found]
        scores[rows[found], at[found]] = _NONE


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _cells(rows: DataFrame, anchors: DataFrame, settings: Mining) -> DataFrame:
    """Anchors and rows of each cell, anchors first, both in order of id."""
    spark = rows.sparkSession
    n, asked = rows.count(), anchors.count()
    cores = spark.sparkContext.defaultParallelism
    parts = max(-(-n // settings.part), min(2 * cores, -(-n // 2048)), 1)
    blocks = max(-(-asked // settings.block), 1)

    def dealt(some: DataFrame, own: str, count: int, other: str, others: int, side: int) -> DataFrame:
        here = F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias(own)
        there = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        return some.withColumn("side", F.lit(side)).select("*", here).select("*", there)

    windows = F.lit(None).cast("array<struct<id: long, score: long>>")
    both = dealt(anchors, "block", blocks, "part", parts, 0).unionByName(
        dealt(rows.withColumn("windows", windows), "part", parts, "block", blocks, 1)
    )
    order = [*_CELL, "side", "vec_id", "row"]
    count = max(1, min(parts * blocks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return both.repartition(count, *_CELL).sortWithinPartitions(*order)


def _compared(cells: DataFrame, size: int, largest: int, settings: Mining, negatives: bool) -> DataFrame:
    """The best rows of every cell: of the anchor's label, or of others in its windows."""
    primes = primes_for(size, size * largest * largest)
    names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "vec_id", "score", "part"]
    schema = ", ".join(f"{name} long" for name in names)

    def found(anchor, rows, part, i, j, scores, place: int) -> pa.RecordBatch:
        """Rows `j` as hits of anchors `i`, in the window `place`."""
        known = "positive_id" in anchor
        of_place = [anchor[k][i, place] if known else np.zeros(len(i)) for k in ("positive_id", "positive_score")]
        values = [
            anchor["row"][i], anchor["vec_id"][i], np.full(len(i), place), *of_place, rows["vec_id"][j],
            scores, np.full(len(i), part),
        ]
        return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in values], names)

    def same_label(anchor, rows, part) -> Iterator[pa.RecordBatch]:
        for label in np.unique(anchor["label"]):
            mine, its = (np.flatnonzero(x["label"] == label) for x in (anchor, rows))
            for a in range(0, len(mine), 512):
                asked = mine[a : a + 512]
                left = [m[asked] for m in anchor["residues"]]
                for c in range(0, len(its), 4096):
                    given = its[c : c + 4096]
                    scores = products(left, [m[given] for m in rows["residues"]], primes)
                    masked = np.where(anchor["vec_id"][asked][:, None] == rows["vec_id"][given], _NONE, scores)
                    for i, j in _best(masked, settings.positives):
                        yield found(anchor, rows, part, asked[i], given[j], scores[i, j], 0)

    def windowed(anchor, rows, part) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(anchor["row"]), 512):
            asked = np.arange(a, min(a + 512, len(anchor["row"])))
            left = [m[asked] for m in anchor["residues"]]
            for c in range(0, len(rows["row"]), 4096):
                given = np.arange(c, min(c + 4096, len(rows["row"])))
                scores = products(left, [m[given] for m in rows["residues"]], primes)
                other = anchor["label"][asked][:, None] != rows["label"][given]
                for k in range(anchor["low"].shape[1]):
                    low, high = anchor["low"][asked, k][:, None], anchor["high"][asked, k][:, None]
                    masked = np.where(other & (scores >= low) & (scores <= high), scores, _NONE)
                    for i, j in _best(masked, settings.negatives):
                        yield found(anchor, rows, part, asked[i], given[j], scores[i, j], k)

    def side(table: pa.Table) -> dict:
        out = {k: table.column(k).to_numpy() for k in ("row", "vec_id", "label")}
        return out | {"residues": residues(_matrix(table.column("whole")), primes)}

    def windows_of(anchor: dict, table: pa.Table) -> None:
        lists = table.column("windows").combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        flat = lists.flatten()
        shape = (len(lengths), settings.positives)
        filled = np.arange(settings.positives) < lengths[:, None]
        for name, field, empty in (("positive_id", "id", 0), ("positive_score", "score", 0)):
            anchor[name] = np.full(shape, empty, np.int64)
            anchor[name][filled] = flat.field(field).to_numpy()
        score = anchor["positive_score"]
        # whole scores s with low p <= 100 s <= high p; an empty window where there is none
        anchor["low"] = np.where(filled, -(-settings.low * score // 100), 1)
        anchor["high"] = np.where(filled, settings.high * score // 100, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, _CELL):
            bounds = group_bounds(table, _CELL)
            for start, end in zip(bounds[:-1], bounds[1:]):
                cell = table.slice(start, end - start)
                split = int((cell.column("side").to_numpy() == 0).sum())
                if split in (0, cell.num_rows):
                    continue
                anchor, rows = side(cell.slice(0, split)), side(cell.slice(split))
                part = cell.column("part")[0].as_py()
                if negatives:
                    windows_of(anchor, cell.slice(0, split))
                yield from (windowed if negatives else same_label)(anchor, rows, part)

    return cells.mapInArrow(run, schema)


def _merged(hits: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The best `count` hits per key, with `rank`; hits are cut down by parts first, so
    that a key's hits of very many cells do not meet in one task."""
    order = [F.desc("score"), F.asc("vec_id")]
    groups = fan_in(hits.sparkSession)
    for by in ([[*keys, "part"]] if groups > 1 else []) + [keys]:
        if "part" in by:
            hits = hits.withColumn("part", F.pmod("part", F.lit(groups)))
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        hits = hits.withColumn("rank", place).filter(F.col("rank") <= count)
    return hits


def _numbered(table: DataFrame, label: Column, scale: int) -> tuple[DataFrame, int, int]:
    """(row, vec_id, label, whole) of the rows that take part, how long their vectors
    are, and the largest whole number."""
    clean = finite(table, label.cast("long").alias("label")).filter("vec_id IS NOT NULL AND label IS NOT NULL")
    enough = 1e18  # so that no whole number overflows; such rows are left out below
    scaled = F.transform(
        "vector", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(enough)), F.lit(-enough)))
    )
    rows = clean.distinct().select("vec_id", "label", scaled.alias("whole"))
    rows = rows.withColumn("most", F.greatest(F.array_max("whole"), -F.array_min("whole")))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    found = rows.agg(F.max(F.size("whole")).alias("size"), F.min(F.size("whole")).alias("least")).first()
    if found["size"] != found["least"]:
        raise ValueError("vectors differ in length")
    size = found["size"] or 1
    limit = 1 << (62 - (size - 1).bit_length()) // 2
    rows = rows.filter(F.col("most") < limit)
    return rows.drop("most"), size, rows.agg(F.max("most").alias("most")).first()["most"] or 0


def hard_negatives(
    table: DataFrame, is_anchor: Column, label: Column | None = None, settings: Mining = Mining()
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Both
    `is_anchor`, a condition on vec_id, and `label` see the columns of `table`."""
    rows, size, largest = _numbered(table, F.col("label") if label is None else label, settings.scale)
    anchors = rows.filter(is_anchor)
    bare = anchors.withColumn("windows", F.lit(None).cast("array<struct<id: long, score: long>>"))
    near = _compared(_cells(rows, bare, settings), size, largest, settings, False)
    positives = materialize(_merged(near, ["anchor"], settings.positives), "negatives-positives")
    found = positives.groupBy(F.col("anchor").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("found")
    )  # at most `positives` each
    windows = F.transform("found", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))
    asked = materialize(
        anchors.join(found, "row").select(*rows.columns, windows.alias("windows")), "negatives-windows"
    )
    hits = _compared(_cells(rows, asked, settings), size, largest, settings, True)
    return _merged(hits, ["anchor", "place"], settings.negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
