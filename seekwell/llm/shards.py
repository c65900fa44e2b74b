"""Shards of near equal size by a minimax partition of one ordered line.

Rows of equal text are one unit and stay together; a null text is the empty text. A
unit's size is the sum over its rows of the text's UTF-8 bytes plus `OVERHEAD`. Units
stand in one order: first those larger than an even share, largest first, then all
others by the 64-bit hash of their text, which mixes documents well. (Unlike texts of
one hash would also stay together, which does no harm.)

The line is cut into contiguous shards: binary search finds the smallest capacity with
which a greedy walk, that opens a shard where the next unit does not fit, needs no more
shards than there are. The first shard is cut there. The rest is searched again for the
shards that are left, so one very large unit does not leave the others uneven: no other
cut has a smaller largest shard.

The line never comes to the driver. It sees sums over at most 65,536 ranges of hashes;
a walk is then known up to the ranges it stops in. Where that leaves the verdict on a
capacity open, only these ranges are cut finer, by another sum over the written units.
At most `shards` units are larger than an even share, so they are few as well.

Places in a shard come from one range sort of narrow rows (no texts) by shard, hash and
id: a row's place is that in its task plus the counts of the tasks before. A unit with a
third of all rows is dealt over many tasks.

A null id is kept, repeated rows are rows of their own, other columns are ignored, an
empty table gives no rows. With fewer units than shards the last shards are empty."""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_of

#: Added to the bytes of each text.
OVERHEAD = 16
_FIRST_BITS, _STEP_BITS = 48, 10
_TASK_BITS = 33  # monotonically_increasing_id: the task above these bits, the row below


def key_of(column: str = "text") -> Column:
    return F.xxhash64(text_of(column))


@dataclass(frozen=True)
class ShardPlan:
    """`alone` maps the hashes of units ahead of the line to shards; every other hash
    is in shard `first` plus the number of `cuts` at or below it."""

    shards: int
    capacity: int
    alone: dict[int, int]
    first: int
    cuts: tuple[int, ...]

    def shard_of(self, key: Column) -> Column:
        place = F.lit(self.first)
        for cut in self.cuts:
            place = place + (key >= F.lit(cut)).cast("int")
        for hash_, shard in self.alone.items():
            place = F.when(key == F.lit(hash_), F.lit(shard)).otherwise(place)
        return place.cast("int")


@dataclass(frozen=True)
class _Cell:
    """Units of the line whose hashes share all but their last `bits` bits."""

    start: int
    bits: int
    size: int
    units: int


class Line:
    """Sizes along the order, as far as they were cut into cells."""

    def __init__(self, ahead: list[_Cell], cells: list[_Cell], finer: Callable[[list[_Cell]], list[_Cell]]):
        self.ahead = ahead
        self._finer = finer
        self._set(cells)

    def _set(self, cells: list[_Cell]) -> None:
        self.cells = self.ahead + sorted(cells, key=lambda c: c.start)
        self.ends = np.cumsum([c.size for c in self.cells], dtype=np.int64)
        self.total = int(self.ends[-1]) if self.cells else 0

    def refine(self, doubtful: set[int]) -> None:
        kept = [c for i, c in enumerate(self.cells) if i >= len(self.ahead) and i not in doubtful]
        self._set(kept + self._finer([self.cells[i] for i in sorted(doubtful)]))

    def _step(self, at: int, capacity: int) -> tuple[int, int]:
        """The cells that end within `capacity` of `at`, and where the last one ends."""
        whole = int(np.searchsorted(self.ends, at + capacity, side="right"))
        return whole, max(at, int(self.ends[whole - 1]) if whole else 0)

    def fits(self, at: int, capacity: int, shards: int) -> tuple[bool | None, set[int]]:
        """Whether `shards` shards from `at` reach the end, None if the cells cannot
        tell; and the cells that a walk stops inside of."""
        least = most = at
        doubtful: set[int] = set()
        for _ in range(shards):
            for bound in ("least", "most"):
                begin = least if bound == "least" else most
                whole, end = self._step(begin, capacity)
                if whole < len(self.cells) and self.cells[whole].units > 1:
                    doubtful.add(whole)
                    if bound == "most":
                        end = min(begin + capacity, int(self.ends[whole]))
                if bound == "least":
                    least = end
                else:
                    most = end
        if least >= self.total:
            return True, doubtful
        return (False if most < self.total else None), doubtful

    def smallest(self, at: int, shards: int, exact: bool) -> int:
        """The smallest capacity of `shards` shards from `at`; if not `exact`, the
        smallest that the present cells prove."""
        rest = self.total - at
        low, high = (rest - 1) // shards, rest
        while high - low > 1:
            middle = (low + high) // 2
            verdict, doubtful = self.fits(at, middle, shards)
            if verdict is None and exact:
                self.refine(doubtful)
            elif verdict:
                high = middle
            else:
                low = middle
        return high

    def cut(self, at: int, capacity: int) -> tuple[int, int]:
        """The first cell that no longer fits, and where it starts; exact."""
        while True:
            whole, end = self._step(at, capacity)
            if whole == len(self.cells) or self.cells[whole].units == 1:
                return whole, end
            self.refine({whole})


def cut_line(line: Line, shards: int) -> ShardPlan:
    """Smallest largest shard first, then the same for what is left."""
    at, capacity, firsts = 0, 0, []
    starts: list[_Cell] = []
    for left in range(shards, 0, -1):
        if at >= line.total:
            break
        allowed = line.smallest(at, left, exact=left == shards)
        capacity = max(capacity, allowed)
        whole, end = line.cut(at, allowed)
        firsts.append(at)
        if whole < len(line.cells):
            starts.append(line.cells[whole])
        at = end
    ahead = {c.start: i for i, c in enumerate(line.ahead)}
    ends = np.cumsum([c.size for c in line.ahead], dtype=np.int64)
    cuts = [c.start for c in starts if not (c.bits < 0 and c.start in ahead)]
    alone = {
        c.start: int(np.searchsorted(firsts, int(ends[i]) - c.size, side="right")) - 1
        for i, c in enumerate(line.ahead)
    }
    return ShardPlan(shards, capacity, alone, len(firsts) - 1 - len(cuts) if firsts else 0, tuple(cuts))


def plan_shards(rows: DataFrame, shards: int) -> ShardPlan:
    """The plan for `rows(key, size)`."""
    units = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-units")
    total = units.agg(F.sum("size").alias("n")).first()["n"]
    if total is None:
        return ShardPlan(shards, 0, {}, 0, ())
    large = units.filter(F.col("size") > total // shards).collect()
    ahead = [_Cell(r["key"], -1, r["size"], 1) for r in sorted(large, key=lambda r: (-r["size"], r["key"]))]
    others = units.filter(~F.col("key").isin([c.start for c in ahead])) if ahead else units

    def cells(some: DataFrame, bits: int) -> list[_Cell]:
        summed = some.groupBy(F.shiftright("key", bits).alias("cell")).agg(
            F.sum("size").alias("size"), F.count("*").alias("units")
        )
        return [_Cell(r["cell"] << bits, bits, r["size"], r["units"]) for r in summed.collect()]

    def finer(doubtful: list[_Cell]) -> list[_Cell]:
        out = []
        for bits in sorted({c.bits for c in doubtful}):
            inside = [c.start >> bits for c in doubtful if c.bits == bits]
            some = others.filter(F.shiftright("key", bits).isin(inside))
            out += cells(some, max(0, bits - _STEP_BITS))
        return out

    return cut_line(Line(ahead, cells(others, _FIRST_BITS), finer), shards)


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = text_of("text")
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), key_of().alias("key"),
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    plan = plan_shards(rows, shards)
    order = ["shard", "key", "doc_id", "row"]
    dealt = rows.withColumn("shard", plan.shard_of(F.col("key"))).repartitionByRange(*order)
    stored = materialize(
        dealt.sortWithinPartitions(*order).drop("row", "key").withColumn("at", F.monotonically_increasing_id()),
        "shard-order",
    ).withColumn("task", F.shiftright("at", _TASK_BITS))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy("shard", "task").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    counts = counts.select(
        "shard", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift")
    )  # a row per task, and one more where a task goes on to the next shard
    return stored.join(F.broadcast(counts), ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, target: str, shards: int = 40) -> ShardPlan:
    """All columns of `docs` as Parquet below `target`, one folder `shard=i` each. A
    column named shard is replaced. Only the texts' hashes and sizes are summed up
    before; the rows are then dealt once, by range of hash, so that a large shard is
    written by several tasks."""
    text = text_of("text")
    sizes = docs.select(key_of().alias("key"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"))
    plan = plan_shards(sizes, shards)
    rest = [c for c in docs.columns if c.lower() != "shard"]
    out = docs.select(*[F.col(f"`{c}`") for c in rest], plan.shard_of(key_of()).alias("shard"))
    salt = F.monotonically_increasing_id()
    out.repartitionByRange(F.col("shard"), key_of(), salt).write.partitionBy("shard").parquet(target)
    return plan
