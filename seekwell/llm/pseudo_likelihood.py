"""Masked pseudo-likelihood of documents by a bidirectional window network.

Every token is predicted from the two tokens on either side; the sum of its
log-probabilities scores a document. Tokens are words (A-Z lower-cased, cut at ASCII
white space). The network, in numpy, joins the four embeddings, has one hidden layer,
and predicts a token's class and then the id within the class, so a token costs two
short softmaxes. The most frequent words of the whole corpus have ids of their own; the
others share ids by hash, and a word's part in its shared id is its share of the id's
occurrences in the corpus. So every word has a probability of its own, that of a word
known from a thousand documents is a thousand times that of a misspelling, and what is
gathered grows with the corpus.

Words are counted over all documents. Counts go to the tasks up to `sent_bytes`: those
from the least power of two on (2 at least) that fits. Counts of 1 need not be sent, as
their logarithm is 0; the others below it are joined to the words of the documents that
have them. So every word has its own count, whatever `sent_bytes` is.

A pass over the texts writes each document's ids to the shared folder; all else reads
these. Training goes over all documents in rounds: each task starts from the last
weights and takes every position of its documents (every `stride`-th if that is set),
so what is learnt from grows with the input; the tasks' weights, weighted by positions,
are averaged in a tree of Spark stages, and only the average comes back. Scoring covers
every token of every document in one narrow pass.

Null or empty texts have no tokens, a sum of 0 and a null mean, and teach nothing.
Repeated rows count repeatedly and score alike. With no tokens at all, weights stay as
they were set. An empty table gives an empty result; extra columns are not read."""

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import group_bounds, runs, small_batches, text_of
from .minhash import word_hashes


@dataclass(frozen=True)
class Shape:
    words: int = 768  # ids of the most frequent words
    classes: int = 32
    per_class: int = 32  # classes * per_class ids in all
    embedding: int = 12
    hidden: int = 24
    stride: int = 1
    rounds: int = 2
    batch: int = 4096
    rate: float = 0.1
    seed: int = 13
    sent_bytes: int = 64 * 1024 * 1024  # of word counts that go to every task

    @property
    def ids(self) -> int:
        return self.classes * self.per_class


def initial(shape: Shape, counts: np.ndarray) -> list[np.ndarray]:
    """Random weights; biases that give each id its share of `counts`."""
    rng = np.random.default_rng(shape.seed)
    share = (counts + 1.0).reshape(shape.classes, shape.per_class)
    wide = 4 * shape.embedding
    draw = lambda *size: rng.normal(0, 1 / np.sqrt(size[-2]), size).astype(np.float32)
    return [
        rng.normal(0, 0.3, (shape.ids + 1, shape.embedding)).astype(np.float32),  # the last is padding
        draw(wide, shape.hidden), np.zeros(shape.hidden, np.float32),
        0.3 * draw(shape.hidden, shape.classes),
        np.log(share.sum(1) / share.sum()).astype(np.float32),
        0.3 * draw(shape.classes, shape.hidden, shape.per_class),
        np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
    ]


def windows(
    ids: np.ndarray, sizes: np.ndarray, padding: int, first: int = 0, last: int | None = None
) -> np.ndarray:
    """For the tokens from `first` to `last` of documents laid end to end, the ids two
    before to two after each, without itself; padding beyond a document's ends."""
    last = len(ids) if last is None else last
    low, high = max(first - 2, 0), min(last + 2, len(ids))
    # only these tokens are laid out, with two places of padding around each document
    counts = np.diff(np.clip(np.concatenate(([0], np.cumsum(sizes))), low, high))
    place = np.arange(2, high - low + 2) + 2 * np.repeat(np.arange(len(counts)), counts)
    laid = np.full(high - low + 2 * len(counts) + 2, padding, np.int64)
    laid[place] = ids[low:high]
    place = place[first - low : last - low]
    out = np.empty((len(place), 4), np.int64)
    for column, step in enumerate((-2, -1, 1, 2)):
        out[:, column] = laid.take(place + step)
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    """Of the columns, row after row, as `x.sum(axis=0)` adds them but in less time."""
    return np.einsum("ij->j", x)


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the rows, taken in place, and their sums. The hidden layer is
    bounded, and so are the logits."""
    np.exp(np.minimum(x, 80, out=x), out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _by_class(classes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(classes.astype(np.int16), kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(classes, minlength=count))))


def _joined(emb: np.ndarray, context: np.ndarray) -> np.ndarray:
    return emb.take(context.ravel(), axis=0).reshape(len(context), -1)


def _own(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row at one place."""
    value = logits[np.arange(len(at)), at]
    return value - np.log(_softmax(logits)[1])


def _inner_logits(h: np.ndarray, bounds: np.ndarray, wt: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Logits within the classes, of rows in order of their classes."""
    out = np.repeat(bt, np.diff(bounds), axis=0)
    for k in np.flatnonzero(np.diff(bounds)):
        out[bounds[k] : bounds[k + 1]] += h[bounds[k] : bounds[k + 1]] @ wt[k]
    return out


def log_probabilities(
    weights: list[np.ndarray], context: np.ndarray, target: np.ndarray, shape: Shape
) -> np.ndarray:
    emb, w1, b1, wc, bc, wt, bt = weights
    out = np.empty(len(target))
    for start in range(0, len(target), 16_384):
        t = target[start : start + 16_384]
        order, bounds = _by_class(t // shape.per_class, shape.classes)
        t = t[order]
        h = np.tanh(_joined(emb, context[start : start + 16_384].take(order, axis=0)) @ w1 + b1)
        value = _own(h @ wc + bc, t // shape.per_class)
        value += _own(_inner_logits(h, bounds, wt, bt), t % shape.per_class)
        out[start + order] = value
    return out


class Trainer:
    """Steps of Adagrad on one task's positions."""

    def __init__(self, weights: list[np.ndarray], shape: Shape):
        self.weights = [w.copy() for w in weights]
        self._squares = [np.full(w.shape, 1e-6, np.float32) for w in weights]
        self._shape = shape

    def _move(self, k: int, grad: np.ndarray) -> None:
        self._squares[k] += grad * grad
        self.weights[k] -= self._shape.rate * grad / np.sqrt(self._squares[k])

    def gradients(self, context: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-probability, by each of the weights."""
        emb, w1, b1, wc, bc, wt, bt = self.weights
        shape, n = self._shape, len(target)
        each, rows = np.float32(1 / n), np.arange(n)
        order, bounds = _by_class(target // shape.per_class, shape.classes)
        context, target = context.take(order, axis=0), target[order]
        x = _joined(emb, context)
        h = np.tanh(x @ w1 + b1)
        gc, total = _softmax(h @ wc + bc)
        gc *= (each / total)[:, None]
        gc[rows, target // shape.per_class] -= each
        gt, total = _softmax(_inner_logits(h, bounds, wt, bt))
        gt *= (each / total)[:, None]
        gt[rows, target % shape.per_class] -= each
        back, g_wt, g_bt = gc @ wc.T, np.zeros_like(wt), np.zeros_like(bt)
        for k in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[k], bounds[k + 1])
            back[part] += gt[part] @ wt[k].T
            np.matmul(h[part].T, gt[part], out=g_wt[k])
            g_bt[k] = _sums(gt[part])
        back *= 1 - h * h
        flat, gx = context.ravel(), (back @ w1.T).reshape(-1, shape.embedding)
        ge = np.stack([np.bincount(flat, gx[:, d], len(emb)) for d in range(shape.embedding)], 1)
        return [
            ge.astype(np.float32), x.T @ back, _sums(back), h.T @ gc, _sums(gc), g_wt, g_bt,
        ]

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        for k, grad in enumerate(self.gradients(context, target)):
            self._move(k, grad)


def token_ids(hashes: np.ndarray, vocabulary: np.ndarray, shape: Shape) -> np.ndarray:
    """Ids of word hashes. `vocabulary` holds hashes by frequency, most first."""
    shared = shape.ids - shape.words
    out = shape.words + (hashes % np.uint64(shared)).astype(np.int64)
    if len(vocabulary):
        order = np.argsort(vocabulary)
        at = np.minimum(np.searchsorted(vocabulary[order], hashes), len(vocabulary) - 1)
        own = order[at]
        out = np.where(vocabulary[own] == hashes, own, out)
    return out


@dataclass(frozen=True)
class Words:
    """What is known of the words of a corpus; words are hashes."""

    own: np.ndarray  # words with ids of their own, most frequent first
    totals: np.ndarray  # occurrences of each id
    counted: np.ndarray  # further words, in order
    logs: np.ndarray  # logarithms of their counts
    named: int  # ids before the shared ones
    unsent: DataFrame | None = None  # (word, log) of the other words that occur more than once

    def shares(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logarithm of each word's part in the occurrences of its id. Words that are not
        `counted` count as 1; the logarithms of their counts are still to be added."""
        out = np.zeros(len(ids))
        at = np.flatnonzero(ids >= self.named)
        words, value = hashes[at], np.zeros(len(at))
        if len(self.counted):
            place = np.minimum(np.searchsorted(self.counted, words), len(self.counted) - 1)
            value = np.where(self.counted[place] == words, self.logs[place], 0.0)
        out[at] = value - np.log(np.maximum(self.totals[ids[at]], 1))
        return out

    def uncounted(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a word has a shared id and its count was not sent."""
        out = ids >= self.named
        if len(self.counted):
            place = np.minimum(np.searchsorted(self.counted, hashes), len(self.counted) - 1)
            out &= self.counted[place] != hashes
        return out


def words_of(docs: DataFrame, shape: Shape) -> Words:
    """Counts of the words of all documents; of equal counts the smaller hash first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [h for h, _ in word_hashes(batch.column("text"))]
            if words:
                value, n = np.unique(np.concatenate(words), return_counts=True)
                yield pa.RecordBatch.from_pydict({"word": value.view(np.int64), "n": n.astype(np.int64)})

    counts = docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "lm-words")
    # Both are bounded by the shape, not by the corpus.
    top = counts.orderBy(F.desc("n"), "word").limit(shape.words).collect()
    # The low bits that token_ids takes are those of the hash as an unsigned number.
    shared = shape.ids - shape.words
    if shared & (shared - 1):
        raise ValueError("the number of shared ids must be a power of two")
    rest = counts.groupBy(F.col("word").bitwiseAND(F.lit(shared - 1)).alias("id")).agg(F.sum("n").alias("n"))
    totals = np.zeros(shape.ids)
    for r in rest.collect():
        totals[shape.words + r["id"]] = r["n"]
    for i, r in enumerate(top):
        totals[i] = r["n"]
        totals[shape.words + (r["word"] & (shared - 1))] -= r["n"]
    least = _least_sent(counts, shape.sent_bytes)
    sent = counts.filter(F.col("n") >= least).toArrow()
    words, n = (sent.column(k).to_numpy() for k in ("word", "n"))
    order = np.argsort(words.view(np.uint64))
    return Words(
        np.array([r["word"] for r in top], np.int64).view(np.uint64), totals,
        words.view(np.uint64)[order], np.log(n[order]).astype(np.float32), shape.words,
        None if least == 2 else counts.filter(F.col("n").between(2, least - 1)).select("word", F.log("n").cast("float").cast("double").alias("log")),
    )


def _least_sent(counts: DataFrame, limit: int) -> int:
    """The least power of two, 2 at least, from which counts take at most `limit` bytes."""
    # the number of binary digits less one, which unlike a logarithm is exact
    power = (F.length(F.bin("n")) - 1).alias("power")
    by_power = counts.groupBy(power).agg(F.count("*").alias("words")).collect()
    least = 1
    while sum(r["words"] for r in by_power if r["power"] >= least) * 12 > limit:
        least += 1
    return 2**least


def averaged(weights: DataFrame, parts: int) -> tuple[np.ndarray, float] | None:
    """Weighted mean of rows (task, n, values), `parts` to one until one task's worth
    is left; those few are averaged here."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["task"]):
            bounds = group_bounds(part, ["task"])
            for start, end in zip(bounds[:-1], bounds[1:]):
                n, total = 0.0, 0.0
                for row in range(start, end):
                    share = part.column("n")[row].as_py()
                    n += share
                    total = total + share * np.frombuffer(part.column("values")[row].as_py(), np.float32)
                yield pa.RecordBatch.from_pydict(
                    {"task": [part.column("task")[int(start)].as_py()], "n": [n], "values": [(total / n).astype(np.float32).tobytes()]}
                )

    while weights.count() > parts:
        keyed = weights.withColumn("task", F.floor(F.col("task") / parts).cast("long"))
        dealt = keyed.repartition("task").sortWithinPartitions("task")
        weights = materialize(dealt.mapInArrow(merge, "task long, n double, values binary"), "lm-weights")
    rows = weights.orderBy("task").collect()
    if not rows:
        return None
    total = sum(r["n"] for r in rows)
    return sum(r["n"] / total * np.frombuffer(bytes(r["values"]), np.float32) for r in rows), total


def flat(weights: list[np.ndarray]) -> bytes:
    return np.concatenate([w.ravel() for w in weights]).astype(np.float32).tobytes()


def shaped(values: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([w.size for w in like])
    return [v.reshape(w.shape).astype(np.float32) for v, w in zip(np.split(values, ends[:-1]), like)]


def lessons(count: int, seen: int, round_: int, shape: Shape) -> np.ndarray:
    """The positions of `count` that a round learns from, in mixed order; with a stride,
    spread over a group's documents, and another place each round."""
    at = np.arange((seen + 3 * round_) % shape.stride, count, shape.stride)
    return np.random.default_rng([shape.seed, seen]).permutation(at)


#: ids as _ID, and words that were not sent as 8 bytes each, which costs the JVM nothing
_STORED = "doc_id long, ids binary, shares double, row long, unsent binary"
_ID = np.dtype("<u4")
_POSITIONS = 262_144  # whose windows are held at once


def stored_ids(docs: DataFrame, words: Words, shape: Shape) -> DataFrame:
    """(doc_id, ids, shares, row, unsent) of every document: the ids of its tokens, the sum
    of the tokens' shares in them, a number, and the words whose counts were not sent."""
    known = docs.sparkSession.sparkContext.broadcast(replace(words, unsent=None))
    whole = words.unsent is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, row = known.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            done = 0
            for hashes, sizes in word_hashes(batch.column("text")):
                ids, ends = token_ids(hashes, words.own, shape), np.cumsum(sizes)
                running = np.concatenate(([0.0], np.cumsum(words.shares(hashes, ids))))
                packed, edges = ids.astype(_ID).tobytes(), np.concatenate(([0], ends * _ID.itemsize))
                unsent = pa.nulls(len(sizes), pa.binary())
                if not whole:
                    other = words.uncounted(hashes, ids)
                    rare, cuts = hashes[other].tobytes(), 8 * np.concatenate(([0], np.cumsum(other)))[[0, *ends]]
                    unsent = pa.array([rare[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(done, len(sizes)),
                        pa.array([packed[a:b] for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                        pa.array(running[ends] - running[ends - sizes]),
                        pa.array(np.arange(row, row + len(sizes))), unsent,
                    ],
                    ["doc_id", "ids", "shares", "row", "unsent"],
                )
                done, row = done + len(sizes), row + len(sizes)

    return materialize(docs.mapInArrow(run, _STORED), "lm-ids")


def unsent_shares(stored: DataFrame, unsent: DataFrame) -> DataFrame:
    """(row, more): what the words whose counts were not sent add to the documents."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.binary_length(batch.column("unsent")).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            words = np.frombuffer(b"".join(batch.column("unsent").to_pylist()), np.int64)
            rows = np.repeat(batch.column("row").to_numpy(), n)
            for at in range(0, len(words), _POSITIONS):
                part = slice(at, at + _POSITIONS)
                yield pa.RecordBatch.from_pydict({"row": rows[part], "word": words[part]})

    pairs = stored.select("row", "unsent").mapInArrow(listed, "row long, word long")
    # neither side is known to be small
    return pairs.join(unsent.hint("merge"), "word").groupBy("row").agg(F.sum("log").alias("more"))


def token_counts(lists: pa.Array) -> np.ndarray:
    return pc.binary_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) // _ID.itemsize


def _windowed(lists: pa.Array, shape: Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first position, ids, contexts) of all positions of the documents of a batch."""
    sizes = token_counts(lists)
    ids = np.frombuffer(b"".join(lists.to_pylist()), _ID).astype(np.int64)
    for first in range(0, len(ids), _POSITIONS):
        last = min(first + _POSITIONS, len(ids))
        yield first, ids[first:last], windows(ids, sizes, shape.ids, first, last)


def trained(stored: DataFrame, counts: np.ndarray, shape: Shape) -> list[np.ndarray]:
    weights = initial(shape, counts)
    for round_ in range(shape.rounds):
        start = weights

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            trainer, seen = Trainer(start, shape), 0
            for batch in batches:
                for _, ids, context in _windowed(batch.column("ids"), shape):
                    at = lessons(len(ids), seen, round_, shape)
                    for k in range(0, len(at), shape.batch):
                        rows = at[k : k + shape.batch]
                        trainer.step(context.take(rows, axis=0), ids[rows])
                    seen += len(ids)
            if seen:
                yield pa.RecordBatch.from_pydict(
                    {
                        "task": pa.array([TaskContext.get().partitionId()], pa.int64()),
                        "n": [float(seen)], "values": [flat(trainer.weights)],
                    }
                )

        learnt = stored.select("ids").mapInArrow(learn, "task long, n double, values binary")
        mean = averaged(materialize(learnt, "lm-learnt"), 32)
        if mean is None:
            return weights
        weights = shaped(mean[0], weights)
    return weights


def scored(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every document."""
    small_batches(docs.sparkSession, 500)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    words = words_of(source.select("text"), shape)
    stored = stored_ids(source, words, shape)
    weights = trained(stored, words.totals, shape)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            n = token_counts(lists)
            total, bounds = batch.column("shares").to_numpy().copy(), np.cumsum(n)
            for first, ids, context in _windowed(lists, shape):
                value = log_probabilities(weights, context, ids, shape)
                document = np.searchsorted(bounds, np.arange(first, first + len(ids)), side="right")
                total += np.bincount(document, value, len(n))
            mean = np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "n_tokens": pa.array(n),
                    "log_likelihood": pa.array(total),
                    "mean_log_likelihood": pa.array(mean, mask=n == 0), "row": batch.column("row"),
                }
            )

    told = stored.select("doc_id", "ids", "shares", "row").mapInArrow(
        score, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double, row long"
    )
    if words.unsent is None:
        return told.drop("row")
    told = told.join(unsent_shares(stored, words.unsent).hint("merge"), "row", "left")
    total = F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))
    return told.select(
        "doc_id", "n_tokens", total.alias("log_likelihood"),
        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"),
    )
