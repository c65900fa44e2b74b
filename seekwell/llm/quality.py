"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good; all other text is unlabelled. A small network
minimises the non-negative unbiased risk: `prior * R_p(+) + max(0, R_u(-) - prior *
R_p(-))`, where R_p and R_u are mean sigmoid losses over positives and unlabelled
text. When the bracket turns negative, the step goes against it, as the method asks.
The class prior is the share of positives among the labelled rows that may be learnt
from. Scores are calibrated on nothing: 0.5 is the network's own boundary.

Trusted positives are a bounded sample: at most `sample`, those of the smallest hashes of
doc_id. The unlabelled side is every document that may be learnt from: a pass over whole
texts writes their features (88 bytes each) to the shared folder, dealt by hash, and the
network learns from them in rounds. In a round each task starts from the last weights
and goes over all of its rows; the weights, weighted by rows, are averaged in a tree of
Spark stages. Scores cover all documents, whole texts, in one narrow pass.

Features describe the shape of a text only; labels, lang, source and doc_id are not
among them. A null or empty text has the features of an empty one and gets a score
too. Labels that are null, repeated or for unknown documents do no harm; a doc_id with
both labels counts as not positive. Without positives, or without documents, the score
is 0.5 everywhere. Extra columns are passed on by `scored`."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import materialize
from .chunk_table import let_go
from .common import small_batches
from .pseudo_likelihood import averaged, flat, shaped

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ENDERS = (".", "!", "?", ":", ";", '"', "'", ")", "…")
_LICENCE = re.compile(r"licen[sc]e|copyright|all rights reserved|terms of use|cookie", re.I)
N_FEATURES = 22


def features(text: str | None) -> list[float]:
    """What a text looks like, each value about 0 to 10."""
    text = text or ""
    words = text.split()
    n = len(words)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(int(raw.sum()), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(len(lines), 1)
    letters, upper = int(raw[_LETTERS].sum()), int(raw[_UPPER].sum())
    marks = int(raw[33:127].sum()) - int(raw[_LETTERS][:52].sum()) - int(raw[_DIGIT].sum())
    calm = int(raw[[44, 46, 39, 45]].sum())
    again = sum(map(str.__eq__, words, words[1:]))
    distinct = len(set(words))
    counted = np.fromiter(map(len, words), np.int32, n) if n else np.zeros(1, np.int32)
    ended = sum(x.rstrip().endswith(_ENDERS) for x in lines)
    share = raw[raw > 0] / size
    k = max(n, 1)
    return [
        np.log1p(n), np.log1p(size) / 2, letters / size * 5, upper / max(letters, 1) * 10,
        int(raw[_DIGIT].sum()) / size * 10, (marks - calm) / size * 20, calm / k * 5,
        int(raw[124]) / k * 10, int(raw[33]) / k * 10, int(raw[[35, 36, 37, 38, 42, 64, 94, 95, 126]].sum()) / k * 5,
        again / k * 10, distinct / k * 3, distinct / np.sqrt(k), counted.mean() / 3, counted.std() / 3,
        np.log1p(counted.max()), len(set(lines)) / m * 3, np.log1p(k / m), ended / m * 3,
        int(raw[46]) / k * 20, -float((share * np.log(share)).sum()), 3.0 * bool(_LICENCE.search(text)),
    ]


def feature_matrix(texts: list) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), N_FEATURES)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def started(mean: np.ndarray, scale: np.ndarray, hidden: int = 24, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    return Model(mean, scale, [
        rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden),
        rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1),
    ])


def risk_gradients(
    weights: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float
) -> tuple[float, list[np.ndarray]]:
    """The negative part R_u(-) - prior * R_p(-), and gradients: of the whole risk
    where that is not negative, else of its opposite."""
    x = np.concatenate([p, u])
    w1, b1, w2, b2 = weights
    h = np.tanh(x @ w1 + b1)
    s = _sigmoid(h @ w2 + b2[0])
    negative = s[len(p) :].mean() - prior * s[: len(p)].mean()  # sigmoid loss of the answer "bad"
    slope = s * (1 - s)
    if negative >= 0:
        g = np.concatenate([-2 * prior / len(p) * slope[: len(p)], slope[len(p) :] / len(u)])
    else:  # step against the negative part
        g = np.concatenate([prior / len(p) * slope[: len(p)], -slope[len(p) :] / len(u)])
    back = np.outer(g, w2) * (1 - h * h)
    return negative, [x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]


def improved(
    model: Model, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int, *,
    done: float = 0.0, share: float = 1.0, batch: int = 512, rate: float = 5e-3, decay: float = 1e-4, seed: int = 5,
) -> Model:
    """The model after so many steps (Adam). `done` is the part of all learning that lies
    behind, `share` the part of these steps; the rate falls with both."""
    rng = np.random.default_rng(seed)
    model = Model(model.mean, model.scale, [np.array(w, np.float64) for w in model.weights])
    first = [np.zeros_like(w) for w in model.weights]
    second = [np.zeros_like(w) for w in model.weights]
    order, at = rng.permutation(len(unlabelled)), 0
    for step in range(1, steps + 1):
        now = rate * (1 - done - share * (step - 1) / steps) + rate / 50
        if at >= len(order):
            order, at = rng.permutation(len(unlabelled)), 0
        rows = (positive[rng.integers(0, len(positive), min(batch, len(positive)))], unlabelled[order[at : at + batch]])
        at += batch
        p, u = (np.clip((x - model.mean) / model.scale, -8, 8) for x in rows)
        _, grads = risk_gradients(model.weights, p, u, prior)
        grads[0] += decay * model.weights[0]
        grads[2] += decay * model.weights[2]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            model.weights[i] = model.weights[i] - now * move
    return model


def fit(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, epochs: int = 60, batch: int = 512
) -> Model:
    """The classifier of rows in one place."""
    every = np.concatenate([positive, unlabelled])
    model = started(every.mean(0), every.std(0) + 1e-6)
    return improved(model, positive, unlabelled, prior, epochs * -(-len(unlabelled) // batch), batch=batch)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model | None:
    """The classifier from the rows that may be learnt from; None if there are no
    trusted positives or no texts."""
    labelled = (
        labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .filter(remainder(F.col("doc_id")) != 1)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    totals = labelled.agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("good")).first()
    if not totals["good"]:
        return None
    prior = min(totals["good"] / totals["n"], 0.99)
    rows = _learnable(docs)
    order = F.xxhash64("doc_id", F.lit(17))
    # At most `sample` ids: bounded by the parameter, whatever the input.
    chosen = F.broadcast(labelled.filter("quality = 1").orderBy(order).limit(sample).select("doc_id"))
    trusted = rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
    if not trusted:
        return None
    positive = np.stack([np.frombuffer(r["x"], np.float32) for r in trusted])
    mean, deviation = _moments(rows)
    return _learnt(rows, positive, prior, started(mean, deviation + 1e-6))


_ROWS_A_TASK = 50_000
_ROUNDS = 4
_PASSES = 8  # over a task's rows in a round
_LEAST_STEPS = 150  # of a task in a round


def _learnable(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of all documents that may be learnt from, in no order of the input.
    x holds the features as 32-bit floats."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            values = feature_matrix(batch.column("text").to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "x": pa.array([v.tobytes() for v in values], pa.binary())}
            )

    small_batches(docs.sparkSession, 500)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    source = source.filter(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 1))
    rows = materialize(source.mapInArrow(describe, "doc_id long, x binary"), "quality-features")
    parts = -(-max(rows.count(), 1) // _ROWS_A_TASK)
    return materialize(rows.repartition(parts, F.xxhash64("doc_id", "x")), "quality-dealt")


def _features_in(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES)


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features_in(batch).astype(np.float64)
            yield pa.RecordBatch.from_pydict(
                {
                    "k": np.arange(N_FEATURES), "n": np.full(N_FEATURES, len(x)),
                    "first": x.sum(0), "second": (x * x).sum(0),
                }
            )

    found = (
        rows.select("x").mapInArrow(sums, "k long, n long, first double, second double")
        .groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n", "first", "second"))).orderBy("k").toPandas()
    )
    mean = (found["first"] / found["n"]).to_numpy()
    return mean, np.sqrt(np.maximum((found["second"] / found["n"]).to_numpy() - mean**2, 0))


def _learnt(rows: DataFrame, positive: np.ndarray, prior: float, model: Model) -> Model:
    for round_ in range(_ROUNDS):
        start = model

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            parts = [_features_in(batch) for batch in batches if batch.num_rows]
            if parts:
                x = np.concatenate(parts)
                x = x[np.lexsort(x.T)]  # whatever order they arrive in
                steps = max(_LEAST_STEPS, _PASSES * -(-len(x) // 512))
                better = improved(
                    start, positive, x, prior, steps, done=round_ / _ROUNDS, share=1 / _ROUNDS, seed=5 + round_
                )
                yield pa.RecordBatch.from_pydict(
                    {
                        "task": pa.array([TaskContext.get().partitionId()], pa.int64()),
                        "n": [float(len(x))], "values": [flat(better.weights)],
                    }
                )

        stored = materialize(rows.select("x").mapInArrow(learn, "task long, n double, values binary"), "quality-learnt")
        model = Model(model.mean, model.scale, shaped(averaged(stored, 32)[0], model.weights))
    return model


def scored(docs: DataFrame, model: Model | None, score: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 in a further column."""
    if model is None:
        return docs.withColumn(score, F.lit(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            values = model.score(feature_matrix(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, score]
            )

    small_batches(docs.sparkSession, 500)
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    return docs.mapInArrow(run, schema)


def classified(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = scored(docs.select("doc_id", "text"), train(docs, labels, sample))
    return rows.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def kept(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    names = docs.columns
    score = next(f"_score{i}" for i in range(len(names) + 1) if f"_score{i}" not in names)
    rows = scored(docs, train(docs, labels, sample), score)
    return rows.filter(F.col(score) >= 0.5).select(*names)
