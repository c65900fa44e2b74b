"""MinHash near-dedup with sequential Bayesian verification.

1. Each document gets the set of its distinct shingles, a signature and band keys.
   Documents with equal sets form a class; only its least id goes on.
2. Documents that share a band key form a bucket. Buckets are dealt in blocks, so
   that no task holds a large one.
3. Round one compares signatures inside each block by batches, drops pairs whose
   posterior says that they cannot reach the threshold, and keeps a forest of the
   likely pairs, which are confirmed on whole sets. Components follow.
4. Round two takes every pair of two components that share a bucket: all blocks
   against all blocks, signatures first, then whole sets of the survivors, inside
   the task. Each task returns only the links that join components.

Links are between sets with `100 * intersection >= percent * union`. A link can be
lost only if no band agrees, (1 - s ** rows) ** bands, or by the chosen miss
probability. Links inside one component are not all listed, as the result needs
components only.

Edge cases: null or empty texts have no shingles, link with nothing and stay.
Rows that repeat a doc_id are one node, linked by any of their texts; every input row is
in the result. A null
doc_id links with nothing and has a null component. Extra columns are ignored; an
empty table gives an empty result."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .chunk_table import let_go
from .common import group_bounds, runs, small_batches
from .components import connected_components
from .minhash import Pruner, Signer, shingle_sets


@dataclass(frozen=True)
class NearDedup:
    width: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 5
    miss: float = 1e-5
    block: int = 512  # rows of a bucket that meet in one task

    @property
    def signer(self) -> Signer:
        return Signer(self.bands, self.rows)

    @property
    def pruner(self) -> Pruner:
        return Pruner(self.percent / 100, self.bands * self.rows, miss=self.miss)


def signed(docs: DataFrame, settings: NearDedup) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature, bands) of every row."""
    signer, width = settings.signer, settings.width

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        let_go()
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), width))
            signatures = signer.sign(sets)
            short = np.ascontiguousarray(signatures.astype(np.uint16))
            bands = signer.band_keys(signatures).tolist()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_key": pa.array(
                        [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                        pa.binary(),
                    ),
                    "signature": pa.array([r.tobytes() for r in short], pa.binary()),
                    "bands": pa.array(
                        [b if len(s) else [] for b, s in zip(bands, sets)], pa.list_(pa.int64())
                    ),
                }
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sign,
        "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>",
    )


def _blocks(size: str, block: int) -> "F.Column":
    return F.ceil(F.col(size) / F.lit(block)).cast("int")


def _buckets(reps: DataFrame, settings: NearDedup) -> DataFrame:
    """(bucket, n_blocks, block, doc_id, signature) of buckets with two rows or more."""
    keys = reps.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    members = keys.join(sizes, "bucket").join(reps.select("doc_id", "signature"), "doc_id")
    blocks = _blocks("size", settings.block)
    return members.select(
        "bucket", blocks.alias("n_blocks"),
        F.pmod(F.xxhash64("doc_id", F.lit(3)), blocks).cast("int").alias("block"),
        "doc_id", "signature",
    )


def _signatures(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, size)


def _forest(signatures: np.ndarray, pruner: Pruner) -> list[tuple[int, int]]:
    """Likely pairs that hold together what looks alike: each row is taken by the
    first row reached that resembles it, and then looks for others itself."""
    left = np.arange(1, len(signatures))
    queue, out = [0], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        at = queue.pop()
        alive, share = pruner.survivors(signatures[at : at + 1], signatures[left])
        taken = alive[share >= pruner.threshold]
        out += [(at, int(x)) for x in left[taken]]
        queue += left[taken].tolist()
        left = np.delete(left, taken)
    return out


def likely_pairs(buckets: DataFrame, settings: NearDedup) -> DataFrame:
    pruner, size = settings.pruner, settings.signer.size
    keys = ["bucket", "block"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in runs(batches, keys):
            ids = part.column("doc_id").to_numpy()
            sig = _signatures(part.column("signature"), size)
            bounds = group_bounds(part, keys)
            lengths = np.diff(bounds)
            twos = bounds[:-1][lengths == 2]
            alive, share = pruner.survivors(sig[twos], sig[twos + 1])
            alive = twos[alive[share >= pruner.threshold]]
            pairs = [np.stack([ids[alive], ids[alive + 1]], 1)] if len(alive) else []
            for start, n in zip(bounds[:-1][lengths > 2], lengths[lengths > 2]):
                found = _forest(sig[start : start + n], pruner)
                if found:
                    pairs.append(ids[start : start + n][np.array(found)])
            if pairs:
                every = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
                every = every[every[:, 0] != every[:, 1]]
                yield pa.RecordBatch.from_pydict({"a": every[:, 0].copy(), "b": every[:, 1].copy()})

    dealt = buckets.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(pick, "a long, b long").distinct()


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(two) - common)


def confirmed(pairs: DataFrame, texts: DataFrame, settings: NearDedup) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    width, percent = settings.width, settings.percent

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            left = shingle_sets(batch.column("text_a"), width)
            right = shingle_sets(batch.column("text_b"), width)
            keep = [_linked(x, y, percent) for x, y in zip(left, right)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    named = [
        texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab"
    ]
    rows = pairs.join(named[0], "a").join(named[1], "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(verify, "a long, b long")


def _open_groups(buckets: DataFrame, component: DataFrame, settings: NearDedup) -> DataFrame:
    """(members) of block pairs in which rows of two components may be linked."""
    pruner, size = settings.pruner, settings.signer.size
    label = F.coalesce("component", "doc_id")
    labelled = buckets.join(
        component.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).select("bucket", "n_blocks", "block", "doc_id", "signature", label.alias("label"))
    mixed = (
        labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low != high").select("bucket")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    rows = labelled.join(mixed, "bucket").select("*", other).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "doc_id", "signature", "label",
    )
    keys = ["bucket", "i", "j"]

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in runs(batches, keys):
            ids = part.column("doc_id").to_numpy()
            labels = part.column("label").to_numpy()
            sig = _signatures(part.column("signature"), size)
            i, j, block = (part.column(k).to_numpy() for k in ("i", "j", "block"))
            members = []
            bounds = group_bounds(part, keys)
            for start, end in zip(bounds[:-1], bounds[1:]):
                if labels[start:end].min() == labels[start:end].max():
                    continue
                first = np.arange(start, end)[block[start:end] == i[start]]
                second = np.arange(start, end)[block[start:end] == j[start]]
                wanted = np.zeros(end - start, bool)
                for at in first:
                    rest = second[(labels[second] != labels[at]) & ((second > at) | (i[start] != j[start]))]
                    if len(rest):
                        alive, _ = pruner.survivors(sig[at : at + 1], sig[rest])
                        wanted[rest[alive] - start] = True
                        wanted[at - start] |= bool(len(alive))
                if wanted.any():
                    members.append(np.unique(ids[start:end][wanted]))
            if members:
                yield pa.RecordBatch.from_pydict(
                    {"members": pa.array(members, pa.list_(pa.int64()))}
                )

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(seek, "members array<long>")
    return found.select(F.xxhash64("members").alias("group"), "members").dropDuplicates(["group"])


def _join_up(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows of different labels that join them, all rows considered."""
    lengths = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    labels, out = labels.copy(), []
    names, counts = np.unique(labels, return_counts=True)
    largest = names[counts.argmax()]
    for at in np.flatnonzero(labels != largest):
        lo, hi = np.searchsorted(values, sets[at]), np.searchsorted(values, sets[at], "right")
        spans = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo)
        common = np.bincount(owner[spans + np.arange(len(spans))], minlength=len(sets))
        linked = 100 * common >= percent * (lengths + lengths[at] - common)
        for x in np.flatnonzero(linked & (labels != labels[at])):
            if labels[x] != labels[at]:
                out.append((int(at), int(x)))
                labels[labels == labels[x]] = labels[at]
    return out


def _joining_links(
    groups: DataFrame, component: DataFrame, texts: DataFrame, settings: NearDedup
) -> DataFrame:
    width, percent = settings.width, settings.percent

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in runs(batches, ["group"]):
            ids, labels = part.column("doc_id").to_numpy(), part.column("label").to_numpy()
            bounds = group_bounds(part, ["group"])
            text = part.column("text")
            pairs = []
            for start, end in zip(bounds[:-1], bounds[1:]):
                sets = list(shingle_sets(text.slice(start, end - start), width))
                for x, y in _join_up(sets, labels[start:end], percent):
                    pairs.append((ids[start + x], ids[start + y]))
            if pairs:
                both = np.sort(np.array(pairs), axis=1)
                yield pa.RecordBatch.from_pydict({"a": both[:, 0].copy(), "b": both[:, 1].copy()})

    rows = (
        groups.select("group", F.explode("members").alias("doc_id"))
        .join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .join(texts, "doc_id")
        .select("group", "doc_id", F.coalesce("component", "doc_id").alias("label"), "text")
    )
    dealt = rows.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, settings: NearDedup = NearDedup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`."""
    every = materialize(signed(docs, settings), "near-signed")
    classes = (
        every.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    )
    ids = every.select("doc_id", "n_shingles", "set_key")
    reps = every.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    reps = reps.filter("n_shingles > 0").dropDuplicates(["doc_id", "set_key"])
    buckets = materialize(_buckets(reps, settings), "near-buckets")

    shared = buckets.select("doc_id").distinct()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The same join at every size: whole texts are shuffled once and never sorted.
    texts = source.join(shared.hint("shuffle_hash"), "doc_id", "left_semi").filter("text IS NOT NULL")
    # Rows that repeat an id may differ in text: each text counts.
    texts = texts.withColumn("text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "text_key"])
    texts = materialize(texts.drop("text_key"), "near-texts")
    first = materialize(
        confirmed(likely_pairs(buckets, settings), texts, settings), "near-links"
    )
    component = connected_components(first, "a", "b", "near-first")
    groups = materialize(_open_groups(buckets, component, settings), "near-open")
    second = _joining_links(groups, component, texts, settings)
    known = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
    copies = ids.join(classes, "set_key").filter("doc_id != rep").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b")
    )
    linked = connected_components(
        known.unionByName(second).unionByName(copies), "a", "b", "near-all"
    ).withColumnRenamed("node", "doc_id")
    out = ids.join(linked, "doc_id", "left")
    component_id = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component_id.alias("component_id"),
        F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"),
    )
