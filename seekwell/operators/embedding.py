"""Embedding: chunk texts to unit vectors, in Arrow batches.

A model is anything with `dim`, `name` and `load()`, which is called once per
task and returns a function from a list of texts to a matrix. The default model
needs no download: it hashes words into buckets and counts them, so it matches
shared words, not meaning. Plug in a real model for semantic search.
"""

import hashlib
import re
from dataclasses import dataclass
from itertools import chain
from typing import Callable, Iterator, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    EMBEDDING_DIM,
    MAX_CHUNKS_PER_REQUEST,
    MAX_TOKENS_PER_REQUEST,
    ROWS_PER_UPSERT,
)
from ..functions import text as text_fn
from ..schemas import VECTOR
from .packing import request_numbers

EmbedTexts = Callable[[list[str]], np.ndarray]


class Embedder(Protocol):
    name: str
    dim: int

    def load(self) -> EmbedTexts: ...


@dataclass(frozen=True)
class RequestBudget:
    """Limits of one call to a model: texts and tokens. A model that has them
    carries one as `budget`."""

    count_tokens: Callable[[str], int]
    max_texts: int = MAX_CHUNKS_PER_REQUEST
    max_tokens: int = MAX_TOKENS_PER_REQUEST


class HashedWords:
    """Bag of words; a word counts in bucket `first 8 hex of md5 mod dim`."""

    def __init__(self, dim: int = EMBEDDING_DIM):
        self.dim = dim
        self.name = f"hashed-words-{dim}"

    def load(self) -> EmbedTexts:
        dim = self.dim
        find = re.compile(r"\w+").findall
        bucket_of = _Buckets(dim).__getitem__

        def embed(texts: list[str]) -> np.ndarray:
            words = [find(text.lower()) for text in texts]
            rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
            buckets = np.fromiter(map(bucket_of, chain.from_iterable(words)), np.int64, len(rows))
            counts = np.bincount(rows * dim + buckets, minlength=len(texts) * dim)
            return counts.reshape(len(texts), dim).astype(np.float64)

        return embed


class _Buckets(dict):
    """Buckets of the words a task has met, forgotten when they grow too many."""

    _LIMIT = 500_000

    def __init__(self, dim: int):
        super().__init__()
        self._dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= self._LIMIT:
            self.clear()
        bucket = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self._dim
        self[word] = bucket
        return bucket


class FunctionEmbedder:
    """A model given as `Iterator[pd.Series] -> Iterator[ndarray]`, one matrix for each
    series, in order. The function is started once per task."""

    def __init__(
        self,
        embed_fn: Callable[[Iterator[pd.Series]], Iterator[np.ndarray]],
        dim: int,
        name: str = "custom",
        budget: RequestBudget | None = None,
    ):
        self._embed_fn = embed_fn
        self.budget = budget
        self.dim = dim
        self.name = name

    def load(self) -> EmbedTexts:
        waiting: list[pd.Series] = []

        def feed() -> Iterator[pd.Series]:
            while waiting:
                yield waiting.pop()

        answers: Iterator[np.ndarray] | None = None

        def embed(texts: list[str]) -> np.ndarray:
            nonlocal answers
            waiting.append(pd.Series(texts))
            if answers is None:
                answers = iter(self._embed_fn(feed()))
            return next(answers)

        return embed


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows at unit length in double precision; zero rows stay as they are."""
    matrix = np.asarray(matrix, dtype=np.float64)
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(lengths > 0, lengths, 1.0)[:, None]


def list_array(matrix: np.ndarray) -> pa.ListArray:
    """A matrix as an Arrow list column of float32, without a per-row loop."""
    n, dim = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(
        offsets, pa.array(matrix.astype(np.float32).reshape(-1), pa.float32())
    )


def calls(texts: list[str], budget: RequestBudget | None, texts_per_call: int) -> list[list[str]]:
    """Consecutive texts cut into calls: by the budget, else by number."""
    if budget is None:
        return [texts[at : at + texts_per_call] for at in range(0, len(texts), texts_per_call)]
    tokens = np.array([budget.count_tokens(t) for t in texts], dtype=np.int64)
    ones = np.ones(len(texts), dtype=np.int64)
    numbers = request_numbers(tokens, ones, budget.max_tokens, budget.max_texts)
    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(texts)]
    return [texts[a:b] for a, b in zip(cuts, cuts[1:])]


def _parts(batch: pa.Array, budget: RequestBudget | None, texts_per_call: int) -> Iterator[list[str]]:
    """The texts of a batch as calls. Without a budget those of one call are made at a time."""
    if budget is not None:
        yield from calls(["" if t is None else t for t in batch.to_pylist()], budget, texts_per_call)
        return
    for at in range(0, len(batch), texts_per_call):
        yield ["" if t is None else t for t in batch.slice(at, texts_per_call).to_pylist()]


def embed(
    text: Column, embedder: Embedder, texts_per_call: int = ROWS_PER_UPSERT
) -> Column:
    """Unit float vectors of a text column."""

    @F.arrow_udf(VECTOR)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = embedder.load()
        for batch in batches:
            if len(batch) == 0:
                yield pa.array([], pa.list_(pa.float32()))
                continue
            done = []  # as float32; doubles are held for one call at a time
            for part in _parts(batch, getattr(embedder, "budget", None), texts_per_call):
                matrix = model(part)
                if matrix.shape != (len(part), embedder.dim):
                    raise ValueError(
                        f"model {embedder.name} gave {matrix.shape}, "
                        f"expected {(len(part), embedder.dim)}"
                    )
                done.append(list_array(unit_rows(matrix)))
            yield pa.concat_arrays(done)

    return run(text)


def word_bucket(word: Column, dim: int) -> Column:
    """The bucket of a word, as a SQL expression equal to `HashedWords`."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(dim))


def hashed_words_sparse(
    table: DataFrame, key: str, text_column: str, dim: int = EMBEDDING_DIM
) -> DataFrame:
    """The default embedding as rows `(key, bucket, n)`, unscaled. Counting
    combines on the map side before the shuffle."""
    return (
        table.select(key, F.explode(text_fn.words(F.col(text_column))).alias("word"))
        .groupBy(key, word_bucket(F.col("word"), dim).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
