"""Packing against a straight greedy loop."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from seekwell.operators import packing


def greedy(tokens, chunks, max_tokens, max_chunks):
    numbers, number, t, c, members = [], 0, 0, 0, 0
    for doc_tokens, doc_chunks in zip(tokens, chunks):
        if members and (c + doc_chunks > max_chunks or t + doc_tokens > max_tokens):
            number, t, c, members = number + 1, 0, 0, 0
        t, c, members = t + doc_tokens, c + doc_chunks, members + 1
        numbers.append(number)
    return numbers


docs = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 7)), max_size=60)


@settings(max_examples=300, deadline=None)
@given(docs)
def test_request_numbers(documents):
    tokens = np.array([d[0] for d in documents], dtype=np.int64)
    chunks = np.array([d[1] for d in documents], dtype=np.int64)
    found = packing.request_numbers(tokens, chunks, 100, 5)
    assert list(found) == greedy(tokens, chunks, 100, 5)


@settings(max_examples=300, deadline=None)
@given(docs, st.lists(st.integers(1, 9), max_size=30))
def test_blocks_compose(documents, sizes):
    """Blocks of any size, summed up and composed, number the whole sequence."""
    tokens = np.array([d[0] for d in documents], dtype=np.int64)
    chunks = np.array([d[1] for d in documents], dtype=np.int64)
    ends = [e for e in np.cumsum([0, *sizes]) if e < len(tokens)] + [len(tokens)]
    parts, names = [], ["first", "with_tokens", "with_chunks", "requests", "open_tokens", "open_chunks"]
    for block, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        columns = packing.block_function(tokens[a:b], chunks[a:b], 100, 5)
        parts.append(pd.DataFrame({"block": block, **dict(zip(names, columns))}))
    found = []
    begun = packing.compose(pd.concat(parts), 100, 5) if parts else pd.DataFrame()
    for row, a, b in zip(begun.itertuples(), ends[:-1], ends[1:]):
        rest = packing.request_numbers(tokens[a + row.first : b], chunks[a + row.first : b], 100, 5)
        found += [row.before] * row.first + list(row.before + 1 + rest)
    assert found == greedy(tokens, chunks, 100, 5)


def test_pack_in_order(spark, monkeypatch):
    monkeypatch.setattr(packing, "_BLOCK_BITS", 4)
    rows = [(f"f{i % 3}", f"p{i * 37 % 211:03}", 17 * i % 90, i % 4) for i in range(300)]
    rows += [("f", "p100", 101, 1), ("f", "p101", 5, 9)]  # over one budget, over the other
    documents = spark.createDataFrame(rows, "folder string, path string, n_tokens long, n_chunks long")
    got = packing.pack_in_order(documents.repartition(5), 100, 5).collect()
    line = sorted((r for r in rows if r[2] <= 100), key=lambda r: (r[1], r[0]))
    want = greedy([r[2] for r in line], [r[3] for r in line], 100, 5)
    assert sorted(map(tuple, got)) == sorted((*r, n) for r, n in zip(line, want))
    assert packing.pack_in_order(documents.limit(0), 100, 5).count() == 0


def test_limits():
    assert list(packing.request_numbers(np.array([1, 1]), np.array([25, 1]))) == [0, 1]
    assert list(packing.request_numbers(np.array([100_000, 100_000, 1]), np.array([1, 1, 1]))) == [0, 0, 1]
    assert list(packing.request_numbers(np.array([1] * 25), np.ones(25, dtype=int))) == [0] * 24 + [1]
    assert list(packing.request_numbers(np.array([]), np.array([]))) == []


def test_pack_requests(spark):
    rows = [("f", f"p{i:03}", 10 * i, 1 + i % 3) for i in range(200)]
    rows += [("f", "big", 200_001, 25), ("f", "edge", 200_000, 25)]
    documents = spark.createDataFrame(rows, "folder string, path string, n_tokens int, n_chunks int")
    packed = packing.pack_requests(packing.with_shards(documents, per_shard=50)).collect()
    assert {r["path"] for r in packed} == {r[1] for r in rows} - {"big"}
    for shard in {r["shard"] for r in packed}:
        members = sorted((r for r in packed if r["shard"] == shard), key=lambda r: r["path"])
        expected = greedy(
            [r["n_tokens"] for r in members], [r["n_chunks"] for r in members], 200_000, 24
        )
        assert [r["request_no"] for r in members] == expected


def test_fixed_batches(spark):
    rows = spark.range(0, 250).withColumnRenamed("id", "x").selectExpr("x", "1 as shard")
    counts = packing.fixed_batches(rows, "shard", ["x"]).groupBy("batch_no").count().collect()
    assert {r["batch_no"]: r["count"] for r in counts} == {0: 100, 1: 100, 2: 50}
