"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits the distinct vectors recursively by random directions; what lies close
to a split goes to both sides. How close follows from the distance that `threshold`
allows, not from the node, so linked vectors rarely part however dense their group is.
A split is put where it leaves the fewest pairs to compare. Where none leaves fewer, as
in a group of near copies, rows stay together. Vectors of one leaf are compared with
each other, pairs of cosine `threshold` or more are links, and links are joined to
components.

Trees grow in rounds. A round counts the rows of each node; a node above `leaf` rows
gets a subtree, fitted in a task on a bounded sample of its rows (the places of its
splits only need a sample), and all of its rows are sent down. A vector is one row with
the list of its nodes, whatever their number; it is sent down all trees in one pass and
written to the shared folder once a round, where it takes the place of the round before.
A leaf that stays too large, say of vectors that no direction parts, is compared in
blocks, all blocks with all, so nothing is dropped and no task holds more than two blocks.

Many leaves hold a vector, more the larger the table is. So rows are not dealt to all
leaves at once, but to a portion of them at a time, about as large as all vectors; what
a portion's shuffle wrote goes before the next.

A link counts in the first of the leaves that its two vectors share; every vector
brings the list of its leaves. So links are added up where they are found: a pair of
blocks gives a number per vector and the edges of a spanning forest, not a row per link.

Equal vectors are one row with a count and their least id. A link between two distinct
vectors counts for all their copies, which are never paired one by one.

Vectors that are null, zero or hold null or non-finite components link with nothing but
are in the result; so is a null vec_id. Vectors must have one length. Repeated rows of
one id give one vector but repeated results; an id with several vectors has the links of
all. Extra columns are ignored; an empty table gives an empty result."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..session import broadcast_if_small, discard, materialize, materialize_all
from .common import group_bounds, runs, small_batches
from .components import connected_components
from .vectors import matrix, unit, usable

_KEYS = ["tree", "node"]


@dataclass(frozen=True)
class Forest:
    threshold: float = 0.9
    trees: int = 7
    leaf: int = 2048
    reach: float = 0.6  # overlap each way, in distances of two vectors at the threshold
    levels: int = 6  # of a subtree
    sample: int = 8192  # rows of a node that its subtree is fitted on
    seed: int = 9

    @property
    def width(self) -> float:
        """Half the overlap. Along a random direction of normal components, the difference
        of two vectors is normal with their distance as its deviation."""
        return self.reach * float(np.sqrt(max(0.0, 2 - 2 * self.threshold)))

    def _depth(self, rows: int) -> int:
        shrink = min(0.7, 0.5 + 0.4 * self.width)  # of a node's rows, on one side
        return max(0, int(np.ceil(np.log(max(rows, 2) / self.leaf) / -np.log(shrink))))

    def levels_for(self, rows: int) -> int:
        return int(np.clip(self._depth(rows), 1, self.levels))

    def rounds_for(self, rows: int) -> int:
        """What even splits need, and one more. Rows that no direction parts would
        only be copied by further ones; blocks take them."""
        return -(-self._depth(rows) // self.levels) + 1


def directions(tree: int, node: int, count: int, size: int, seed: int) -> np.ndarray:
    """One random direction per inner position of a subtree, the same on every task."""
    rng = np.random.default_rng([seed, tree, node & 0xFFFFFFFF, (node >> 32) & 0xFFFFFFFF])
    return rng.normal(size=(count, size))


#: A split must leave fewer than this share of a node's pairs to compare.
_WORTH = 0.98


def _split(x: np.ndarray, width: float) -> float:
    """The place that leaves the fewest pairs on its two sides; infinite, with all on
    the low side, where no place is worth it."""
    x = np.sort(x)
    places = np.quantile(x, np.linspace(0.1, 0.9, 17))
    low = np.searchsorted(x, places + width) / len(x)
    high = 1 - np.searchsorted(x, places - width) / len(x)
    pairs = low**2 + high**2
    best = int(np.argmin(pairs))
    return float(places[best]) if pairs[best] < _WORTH else np.inf


def _fit(vectors: np.ndarray, along: np.ndarray, levels: int, width: float) -> np.ndarray:
    """(split, half width of the overlap) per inner position; position p has the
    children 2p + 1 and 2p + 2."""
    out = np.tile([np.inf, width], (2**levels - 1, 1))
    members = {0: np.arange(len(vectors))}
    for p in range(len(out)):
        rows = members.pop(p, np.empty(0, int))
        if len(rows) == 0:
            continue
        x = vectors[rows] @ along[p]
        out[p, 0] = _split(x, width)
        members[2 * p + 1] = rows[x < out[p, 0] + width]
        members[2 * p + 2] = rows[x >= out[p, 0] - width]
    return out


def _route(vectors: np.ndarray, along: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf position) for every leaf of the subtree that a row reaches."""
    rows, at = np.arange(len(vectors)), np.zeros(len(vectors), int)
    projected = vectors @ along.T
    while len(at) and at.min() < len(splits):
        x, (split, width) = projected[rows, at], splits[at].T
        low, high = x < split + width, x >= split - width
        rows = np.concatenate([rows[low], rows[high]])
        at = np.concatenate([2 * at[low] + 1, 2 * at[high] + 2])
    return rows, at


def _child(node: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    mixed = (node.astype(np.uint64) + leaf.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)).astype(np.int64)


#: Bytes of rows that are dealt out by node or leaf at a time, or all vectors' if these are more.
_DEALT_BYTES = 384 * 1024 * 1024


@dataclass(frozen=True)
class _Room:
    """How much may be dealt out at a time."""

    rows: int
    row_bytes: int  # of one with its vector

    def at_once(self, more: int = 0) -> int:
        """How many rows, each of them `more` bytes larger."""
        return max(1, max(_DEALT_BYTES, self.rows * self.row_bytes) // (self.row_bytes + more))


def _room(vectors: DataFrame) -> _Room:
    width = 4 if isinstance(vectors.schema["vector"].dataType.elementType, FloatType) else 8
    found = vectors.agg(F.count("*").alias("rows"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("size")).first()
    return _Room(found["rows"], 64 + width * found["size"])


def _share_of(hashed: Column, portion: int, portions: int) -> Column:
    return F.pmod(hashed, F.lit(portions)) == portion


def _flat(rows: DataFrame, portion: int = 0, portions: int = 1) -> DataFrame:
    """A row for every node that a row of `rows` is in, or for a portion of the nodes."""
    nodes = F.arrays_zip("tree", "node")
    if portions > 1:
        nodes = F.filter(nodes, lambda x: _share_of(F.xxhash64(x["tree"], x["node"]), portion, portions))
    both = F.explode(nodes).alias("at")
    return rows.select(*[c for c in rows.columns if c not in _KEYS], both).select("*", "at.tree", "at.node").drop("at")


def _subtrees(rows: DataFrame, sizes: DataFrame, forest: Forest, room: _Room) -> DataFrame:
    """(tree, node, splits) for every node that is too large, stored."""
    share = F.least(F.lit(1.0), F.lit(float(forest.sample)) / F.col("n"))
    drawn = F.pmod(F.xxhash64("id", "tree", "node"), F.lit(1_000_000)) < share * 1_000_000
    portions = -(-sizes.agg(F.sum(F.least("n", F.lit(forest.sample)))).first()[0] // room.at_once())
    sizes = broadcast_if_small(sizes)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, _KEYS):
            bounds = group_bounds(part, _KEYS)
            cols: dict[str, list] = {"tree": [], "node": [], "splits": []}
            for start, end in zip(bounds[:-1], bounds[1:]):
                group = part.slice(start, end - start)
                tree, node, n = (group.column(k)[0].as_py() for k in (*_KEYS, "n"))
                vectors, levels = unit(matrix(group.column("vector"))), forest.levels_for(n)
                along = directions(tree, node, 2**levels - 1, vectors.shape[1], forest.seed)
                cols["tree"].append(tree)
                cols["node"].append(node)
                cols["splits"].append(_fit(vectors, along, levels, forest.width).ravel())
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols.values(), kinds)], list(cols))

    def of(portion: int) -> DataFrame:
        sample = _flat(rows, portion, portions).join(sizes, _KEYS).filter(drawn).select(*_KEYS, "n", "vector")
        dealt = sample.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
        return dealt.mapInArrow(fit, "tree long, node long, splits array<double>")

    return materialize_all(map(of, range(portions)), "forest-subtrees")


#: Bytes of splits that may go to every task; more are joined to the rows instead.
_SENT_BYTES = 16 * 1024 * 1024


def _sent_down(rows: DataFrame, subtrees: DataFrame, forest: Forest) -> DataFrame:
    """`rows` with each node that has a subtree replaced by its leaves. A vector is sent
    down all of its trees at once and stays one row."""
    names, known = ["id", "copies", "vector", *_KEYS], None
    if subtrees.count() * 2**forest.levels * 16 <= _SENT_BYTES:
        known = {(r["tree"], r["node"]): np.array(r["splits"]) for r in subtrees.collect()}
        source = rows
    else:
        source = _flat(rows).join(subtrees, _KEYS, "left").select(
            "id", "copies", "vector", *[F.array(k).alias(k) for k in _KEYS], "splits"
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = unit(matrix(batch.column("vector")))
            of = np.repeat(np.arange(len(vectors)), batch.column("tree").value_lengths().to_numpy())
            tree, node = (batch.column(k).flatten().to_numpy() for k in _KEYS)
            order = np.lexsort((node, tree))
            change = np.flatnonzero((np.diff(tree[order]) != 0) | (np.diff(node[order]) != 0)) + 1
            take, nodes = [], []
            for part in np.split(order, change):
                first = int(part[0])
                key = (int(tree[first]), int(node[first]))
                splits = batch.column("splits")[of[first]].as_py() if known is None else known.get(key)
                if splits is None:
                    take.append(part)
                    nodes.append(node[part])
                    continue
                splits = np.asarray(splits).reshape(-1, 2)
                along = directions(*key, len(splits), vectors.shape[1], forest.seed)
                which, at = _route(vectors[of[part]], along, splits)
                take.append(part[which])
                nodes.append(_child(np.full(len(at), key[1]), at))
            take, nodes = np.concatenate(take), np.concatenate(nodes)
            order = np.argsort(of[take], kind="stable")
            ends = np.cumsum(np.bincount(of[take], minlength=len(vectors)))
            ends = pa.array(np.append(0, ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("id", "copies", "vector")],
                    pa.ListArray.from_arrays(ends, pa.array(tree[take[order]])),
                    pa.ListArray.from_arrays(ends, pa.array(nodes[order])),
                ],
                names,
            )

    sent = source.mapInArrow(run, rows.select(*names).schema)
    if known is not None:
        return sent
    same = ["id", F.xxhash64("vector").alias("of")]  # an id may have several vectors
    lists = sent.select(*same, *_KEYS).groupBy("id", "of").agg(F.collect_list(F.struct(*_KEYS)).alias("at"))
    lists = lists.select("id", "of", *[F.flatten(f"at.{k}").alias(k) for k in _KEYS])
    return rows.select("copies", "vector", *same).join(lists, ["id", "of"]).select(*names)


def leaves(vectors: DataFrame, forest: Forest, room: _Room) -> DataFrame:
    """`vectors` with the lists `tree` and `node` of the leaves of all trees that a row is in."""
    trees = F.sequence(F.lit(0).cast("long"), F.lit(forest.trees - 1).cast("long"))
    rows = vectors.select("id", "copies", "vector", trees.alias("tree"))
    rows = rows.withColumn("node", F.transform("tree", lambda t: F.lit(0).cast("long")))
    for _ in range(forest.rounds_for(room.rows)):
        large = _flat(rows.select(*_KEYS)).groupBy(*_KEYS).agg(F.count("*").alias("n"))
        large = materialize(large.filter(F.col("n") > forest.leaf), "forest-large")
        if large.isEmpty():
            break
        subtrees, before = _subtrees(rows, large, forest, room), rows
        rows = materialize(_sent_down(rows, subtrees, forest), "forest-rows")
        for done in (before, subtrees, large):
            discard(done)
    return rows


def _classes(lists: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The different lists of leaves, and which of them each row has."""
    ends = np.cumsum(lists.value_lengths().to_numpy())
    known: dict[bytes, int] = {}
    parts = np.split(lists.flatten().to_numpy(), ends[:-1])
    which = np.array([known.setdefault(p.tobytes(), len(known)) for p in parts])
    return [np.frombuffer(k, np.int64) for k in known], which


def _share(some: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Whether a list of `some` and one of `others` have a leaf in common."""
    common = np.intersect1d(np.concatenate(some), np.concatenate(others))
    out = np.zeros((len(some), len(others)), bool)
    for start in range(0, len(common), 1024):
        leaf = common[start : start + 1024]
        a, b = (np.stack([np.isin(leaf, x) for x in side]).astype(np.float32) for side in (some, others))
        out |= a @ b.T > 0
    return out


def _spanning(hit: np.ndarray, first: np.ndarray, second: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what `hit` joins and `label`, which is brought up to date, does not."""
    out = []
    for row in np.flatnonzero(hit.any(axis=1)):
        x, ys = int(first[row]), second[hit[row]]
        fresh = ys[label[ys] != label[x]]
        if len(fresh) == 0:
            continue
        found, at = np.unique(label[fresh], return_index=True)
        out += [(x, int(y)) for y in fresh[at]]
        label[np.isin(label, found)] = label[x]
    return out


def _linked(
    group: np.ndarray, rough: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float
) -> np.ndarray | None:
    """Which cosines of `first` and `second` reach the threshold; None if no pair does.
    `rough` are the same unit vectors in single precision, whose products settle all
    pairs further from the threshold than its rounding; the others are taken in double."""
    slack = (group.shape[1] + 4) * 2.0**-23
    near = rough[first] @ rough[second].T
    hit = near >= threshold - slack
    if not hit.any():
        return None
    x, y = np.nonzero(hit & (near < threshold + slack))
    for at in range(0, len(x), 65_536):
        a, b = x[at : at + 65_536], y[at : at + 65_536]
        hit[a, b] = np.einsum("ij,ij->i", group[first[a]], group[second[b]]) >= threshold
    return hit


def links(vectors: DataFrame, forest: Forest) -> DataFrame:
    """Rows (a, null, n), which add up to the number n of rows that vector a links
    with, and rows (a, b, 0): links that join whatever all links join; stored. `vectors`
    has id, vector and copies."""
    room = _room(vectors)
    stored = leaves(vectors, forest, room)
    leaf_of = F.transform(F.arrays_zip(*_KEYS), lambda x: F.xxhash64(x["tree"], x["node"]))
    rows = stored.select("id", "copies", "vector", F.sort_array(leaf_of).alias("at"))
    sizes = rows.select(F.explode("at").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(2 * forest.leaf)).cast("int")
    sizes = materialize(sizes.select("leaf", blocks.alias("blocks"), (F.col("n") * blocks).alias("n")), "forest-leaves")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    at_once = room.at_once(4 * total // max(1, room.rows))  # half of a list of leaves goes along
    portions = max(1, -(-total // at_once))
    counts = sizes.groupBy(F.pmod("leaf", F.lit(portions)).alias("portion")).agg(F.sum("n").alias("n")).collect()
    known = broadcast_if_small(sizes.select("leaf", "blocks"))
    keys = ["leaf", "i", "j"]

    def dealt(portion: int, part: int, parts: int) -> DataFrame:
        """The rows of the leaves of a portion, or of a part of the pairs of their blocks."""
        here, pair = F.col("at"), lambda o: F.xxhash64("leaf", F.least("block", o), F.greatest("block", o))
        if portions > 1:
            here = F.filter(here, lambda x: _share_of(x, portion, portions))
        found = rows.select("*", F.explode(here).alias("leaf")).join(known, "leaf")
        found = found.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
        if parts > 1:
            others = F.filter(others, lambda o: _share_of(pair(o), part, parts))
        return found.select("*", F.explode(others).alias("other")).select(
            "leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            "block", "id", "copies", "vector",
            F.slice("at", 1, F.array_position("at", F.col("leaf")).cast("int") - 1).alias("at"),  # what comes before
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, keys):
            bounds = group_bounds(part, keys)
            ids, block, i, j = (part.column(k).to_numpy() for k in ("id", "block", "i", "j"))
            for start, end in zip(bounds[:-1], bounds[1:]):
                lists, kind = _classes(part.column("at").slice(start, end - start).combine_chunks())
                if len(lists) <= 64 and _share(lists, lists).all():
                    continue
                group = unit(matrix(part.column("vector").slice(start, end - start)))
                rough = group.astype(np.float32)
                names = ids[start:end]
                copies = part.column("copies").slice(start, end - start).to_numpy().astype(float)
                second = np.flatnonzero(block[start:end] == j[start])
                others, label, edges = np.zeros(len(names)), np.arange(len(names)), []
                all_first = np.flatnonzero(block[start:end] == i[start])
                if i[start] == j[start]:  # by id, so that a pair comes once
                    all_first = second = second[np.argsort(names[second], kind="stable")]
                all_second = second
                for k in range(0, len(all_first), 512):
                    first = all_first[k : k + 512]
                    if i[start] == j[start]:
                        second = all_second[k:]
                    hit = _linked(group, rough, first, second, forest.threshold)
                    if hit is None:
                        continue
                    if i[start] == j[start]:
                        hit &= names[first][:, None] < names[second]
                    x, y = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
                    if len(x) == 0:
                        continue
                    (a, of_x), (b, of_y) = (np.unique(kind[z], return_inverse=True) for z in (first[x], second[y]))
                    earlier = _share([lists[c] for c in a], [lists[c] for c in b])
                    if earlier.any():
                        hit[np.ix_(x, y)] &= ~earlier[of_x][:, of_y]
                    counted = hit.astype(float)
                    others[first] += counted @ copies[second]
                    others[second] += copies[first] @ counted
                    edges += _spanning(hit, first, second, label)
                has = np.flatnonzero(others)
                if len(has):
                    a, b = np.array(edges).T
                    yield pa.RecordBatch.from_pydict(
                        {
                            "a": np.concatenate([names[has], names[a]]),
                            "b": pa.array([None] * len(has) + names[b].tolist(), pa.int64()),
                            "n": np.concatenate([others[has], np.zeros(len(a))]).astype(np.int64),
                        }
                    )

    def compared(portion: int, part: int, parts: int) -> DataFrame:
        given = dealt(portion, part, parts).repartition(*keys).sortWithinPartitions(*keys)
        return given.mapInArrow(compare, "a long, b long, n long")

    parts = [(r["portion"], -(-r["n"] // (2 * at_once))) for r in counts] or [(0, 1)]
    out = materialize_all((compared(p, k, of) for p, of in parts for k in range(of)), "forest-links")
    discard(stored)
    return out


def near_vectors(table: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `table`."""
    small_batches(table.sparkSession, 4000)
    good = materialize(usable(table), "forest-usable")
    classes = good.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "forest-classes")
    members = good.join(classes.select("vector", "class"), "vector").select("vec_id", "class")
    members = materialize(members, "forest-members")
    discard(good)
    found = links(classes.select("id", "vector", "copies"), forest)
    component = connected_components(found.filter("b IS NOT NULL").select("a", "b"), "a", "b", "forest")
    others = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    found = (
        classes.join(others, "id", "left")
        .join(component.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "class", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    of_id = members.join(found, "class").groupBy("vec_id").agg(
        F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    out = table.select(F.col("vec_id").cast("long").alias("vec_id")).join(of_id, "vec_id", "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"),
    )
