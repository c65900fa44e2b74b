"""Scoring against brute force."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seekwell.operators import ann, render, scoring
from seekwell.schemas import VECTOR

DIM = 8
CHUNKS = "folder string, path string, chunk_id string, chunk_index int, vector array<float>"
QUERIES = "query_id long, folder string, cutoff double, vector array<double>"


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(900, DIM)).astype(np.float32)
    # a third of all chunks are copies of one vector and sit in one folder
    vectors[:300] = vectors[0]
    vectors[400] = 0.0
    vectors[401, 2] = np.nan
    folders = ["hot" if i < 450 else f"f{i % 7}" for i in range(900)]
    chunks = [
        (folders[i], f"p{i // 3}", f"c{(i * 7919) % 900:04}", i % 3, vectors[i].tolist())
        for i in range(900)
    ]
    queries = [
        (q, [None, "hot", "f3", "none"][q % 4], [None, 0.2, 0.9][q % 3], rng.normal(size=DIM).tolist())
        for q in range(23)
    ]
    queries[1] = (1, "hot", None, vectors[0].astype(float).tolist())
    queries[2] = (2, None, None, [0.0] * DIM)
    return chunks, queries


def brute_force(chunks, queries, metric, k):
    v = unit(np.array([c[4] for c in chunks], dtype=np.float64))
    expected = []
    for query_id, folder, cutoff, vector in queries:
        q = unit(np.array([vector], dtype=np.float64))[0]
        scored = []
        for chunk, row in zip(chunks, v):
            score = float(row @ q)
            if metric == "l2sim":
                score = 1 / (1 + (2 - 2 * score))
            if np.isnan(score) or folder not in (None, chunk[0]):
                continue
            scored.append((-round(score, 9), chunk[2]))
        best = sorted(scored)[:k]
        expected += [
            (query_id, c, -s, rank + 1)
            for rank, (s, c) in enumerate(best)
            if cutoff is None or -s >= cutoff
        ]
    return sorted(expected)


def found(top):
    return sorted((r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in top.collect())


def same(a, b):
    assert [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b]
    assert np.allclose([x[2] for x in a], [x[2] for x in b], atol=2e-9)


def tables(spark, data):
    return (
        spark.createDataFrame(data[0], CHUNKS).repartition(6),
        spark.createDataFrame(data[1], QUERIES),
    )


@pytest.mark.parametrize("metric", scoring.METRICS)
@pytest.mark.parametrize("k", [1, 10, 100, 2000])
def test_top_chunks(spark, data, metric, k):
    chunks, queries = tables(spark, data)
    top = scoring.top_chunks(chunks, queries, DIM, metric, k)
    same(found(top), brute_force(*data, metric, k))


def test_merge_in_parts_changes_nothing(spark, data):
    chunks, queries = tables(spark, data)
    one = scoring.top_chunks(chunks, queries, DIM, k=20, parts=1)
    many = scoring.top_chunks(chunks, queries, DIM, k=20, parts=5)
    assert found(one) == found(many)


def test_many_blocks_equal_one(spark, data, monkeypatch):
    chunks, queries = tables(spark, data)
    whole = found(scoring.top_chunks(chunks, queries, DIM, k=20))
    monkeypatch.setattr(scoring, "MAX_KEPT_HITS", 4 * 20)
    for dealt in (queries, queries.repartition(7)):
        store = scoring.store_requests(dealt, DIM, 20)
        blocks = [scoring.read_block(f, DIM) for f in store.files]
        assert store.rows == 23 and max(len(b.ids) for b in blocks) <= 4
        assert sorted(i for b in blocks for i in b.ids) == list(range(23))
    monkeypatch.setattr(scoring, "_SEGMENT_BYTES", 4000)
    assert found(scoring.top_chunks(chunks, queries, DIM, k=20)) == whole


@pytest.mark.parametrize("repeated", [False, True])
def test_tasks_that_take_requests(spark, data, tmp_path, monkeypatch, repeated):
    """With many requests no more hits leave the tasks than there are in the result."""
    spark.createDataFrame(data[0], CHUNKS).repartition(3).write.parquet(f"{tmp_path}/chunks")
    asked = [*data[1], *(data[1][:5] if repeated else [])]
    chunks, queries = spark.read.parquet(f"{tmp_path}/chunks"), spark.createDataFrame(asked, QUERIES).coalesce(1)
    whole = found(scoring.top_chunks(chunks, queries, DIM, k=20))
    monkeypatch.setattr(scoring, "MAX_KEPT_HITS", 10 * 20)
    monkeypatch.setattr(scoring, "_QUERIES_PER_TASK", 4)
    store, left = scoring.store_requests(queries, DIM, 20), []
    assert scoring._takes_requests(chunks, store, 20)
    of_requests = scoring.best_of_requests
    monkeypatch.setattr(scoring, "best_of_requests", lambda *a: left.append(of_requests(*a)) or left[0])
    top = scoring.top_chunks(chunks, queries, DIM, k=20)
    assert found(top) == whole
    assert left[0].groupBy("query_id").count().filter(f"count > {40 if repeated else 20}").isEmpty()


def test_many_requests_are_taken_however_many_chunks_there_are(spark, data, monkeypatch):
    """A hit that leaves a task costs more than a few read bytes, so tasks of chunks do not
    give `k` hits each for hundreds of thousands of requests."""
    chunks, _ = tables(spark, data)
    cores = spark.sparkContext.defaultParallelism
    for size in (2**26, 2**30, 2**33, 2**36):
        monkeypatch.setattr(scoring, "input_bytes", lambda df: size)
        monkeypatch.setattr(scoring, "expected_tasks", lambda df: -(-size // 2**27))
        many = scoring.RequestStore(("a", "b"), 500_000, 384, None, None)
        assert scoring._takes_requests(chunks, many, 100)
        few = scoring.RequestStore(("a", "b"), 512 * (cores // 4) - 600, 384, None, None)
        assert not scoring._takes_requests(chunks, few, 100)  # too few tasks for the cores


@pytest.mark.parametrize("metric", scoring.METRICS)
@pytest.mark.parametrize("k", [1, 3, 50])
def test_single_precision_only_looks(spark, metric, k):
    """Scores that single precision cannot tell apart, around the cutoff and the `k`-th best."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=DIM)
    vectors = (base + rng.normal(size=(700, DIM)) * 2e-4).astype(np.float32)
    chunks = [("all", f"p{i}", f"c{i:04}", 0, v.tolist()) for i, v in enumerate(vectors)]
    cosines = np.sort(unit(vectors.astype(np.float64)) @ unit(base[None])[0])
    score = (lambda c: 1 / (3 - 2 * c)) if metric == "l2sim" else float
    queries = [(i, None, float(score(cosines[c])) - 3e-9, base.tolist()) for i, c in enumerate([-1, -3, -20, 350, 0])]
    frame = spark.createDataFrame(chunks, CHUNKS).repartition(2)
    top = scoring.top_chunks(frame, spark.createDataFrame(queries, QUERIES), DIM, metric, k)
    same(found(top), brute_force(chunks, queries, metric, k))


def test_requests_of_one_id_still_part(spark, data, monkeypatch):
    _, queries = tables(spark, data)
    alike = queries.withColumn("query_id", F.lit(1).cast("long"))
    monkeypatch.setattr(scoring, "MAX_KEPT_HITS", 100)
    store = scoring.store_requests(alike, DIM, 10)
    assert sorted(len(scoring.read_block(f, DIM).ids) for f in store.files) == [3, 10, 10]


def test_folders_asked_for_are_counted_while_stored(spark, data):
    _, queries = tables(spark, data)
    some = queries.filter("folder IS NOT NULL")
    names = sorted({r["folder"] for r in some.collect()})
    store = scoring.store_requests(some, DIM, 10)
    assert store.between == (names[0], names[-1])
    assert set(store.parts) == {zlib.crc32(n.encode()) % 64 for n in names}
    everywhere = some.limit(1).withColumn("folder", F.lit(None).cast("string")).unionByName(some)
    assert scoring.store_requests(everywhere, DIM, 10).parts is None
    assert scoring.store_requests(some.limit(0), DIM, 10).files == ()


def test_thousands_of_requests_take_one_scan(spark, data, monkeypatch):
    chunks, queries = tables(spark, data)
    copies = F.explode(F.sequence(F.lit(0), F.lit(129))).alias("copy")
    many = queries.select("*", copies).select(
        (F.col("query_id") + 100 * F.col("copy")).alias("query_id"), "folder", "cutoff", "vector"
    )
    top = scoring.top_chunks(chunks, many, DIM, k=20)
    assert top._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    expected = found(scoring.top_chunks(chunks, queries, DIM, k=20))
    assert found(top.filter("query_id BETWEEN 5000 AND 5099")) == [(q + 5000, *r) for q, *r in expected]
    assert top.count() == 130 * len(expected)


def test_small_arrow_batches_and_pruning(spark, data, monkeypatch):
    chunks, queries = tables(spark, data)
    whole = found(scoring.top_chunks(chunks, queries, DIM, k=5))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert found(scoring.top_chunks(chunks, queries, DIM, k=5)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_best_keeps_ties_by_id():
    """A run of equal scores longer than the room of a task keeps the small ids."""
    import pyarrow as pa

    best = scoring._Best(1, 3, np.array([0.5]))
    best.room = 10
    for start in range(0, 60, 6):
        ids = [f"c{59 - i:02}" for i in range(start, start + 6)]
        batch = pa.record_batch({
            "folder": ["f"] * 6, "path": ["p"] * 6, "chunk_id": ids, "chunk_index": [0] * 6,
        })
        best.offer(batch, np.arange(6), np.zeros(6, dtype=np.int64), np.ones(6))
    assert best.shrink()["chunk_id"].to_pylist() == ["c00", "c01", "c02"]
    assert best.bars[0] == 1.0


def test_batch_equals_single_queries(spark, data):
    chunks, queries = tables(spark, data)
    whole = found(scoring.top_chunks(chunks, queries, DIM, k=10))
    single = []
    for query_id in (0, 1, 5):
        single += found(
            scoring.top_chunks(chunks, queries.filter(F.col("query_id") == query_id), DIM, k=10)
        )
    assert single == [r for r in whole if r[0] in (0, 1, 5)]


def test_cutoff_is_inclusive(spark, data):
    chunks, _ = tables(spark, data)
    exact = spark.createDataFrame([(7, "hot", 1.0, data[0][0][4])], QUERIES)
    assert scoring.top_chunks(chunks, exact, DIM, k=1000).count() == 300


def test_no_queries_and_bad_arguments(spark, data):
    chunks, queries = tables(spark, data)
    none = scoring.top_chunks(chunks, queries.limit(0), DIM)
    assert none.count() == 0 and "rank" in none.columns
    with pytest.raises(ValueError):
        scoring.top_chunks(chunks, queries, DIM, metric="dot")
    with pytest.raises(ValueError):
        scoring.top_chunks(chunks, queries, DIM, k=0)


def test_wrong_dimension_fails(spark, data):
    _, queries = tables(spark, data)
    short = spark.createDataFrame([("f", "p", "c", 0, [1.0, 2.0])], CHUNKS)
    with pytest.raises(Exception, match="entries"):
        scoring.top_chunks(short, queries, DIM).count()


def test_best_files(spark, data):
    chunks, queries = tables(spark, data)
    top = brute_force(*data, "cosine", 30)
    path = {c[2]: (c[0], c[1]) for c in data[0]}
    best = {}
    for query_id, chunk, score, _ in top:
        key = (query_id, *path[chunk])
        best[key] = max(best.get(key, -9), score)
    files = scoring.best_files(scoring.top_chunks(chunks, queries, DIM, k=30)).collect()
    assert {(r["query_id"], r["folder"], r["path"]) for r in files} == set(best)
    for query_id in {r["query_id"] for r in files}:
        rows = sorted((r for r in files if r["query_id"] == query_id), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        keys = [(-r["score"], r["path"], r["folder"]) for r in rows]
        assert keys == sorted(keys)


@pytest.mark.parametrize("n_probe", [12, 3])
def test_cells(spark, data, n_probe, tmp_path):
    chunks, queries = tables(spark, data)
    chunks = chunks.filter(~F.exists("vector", F.isnan))
    centroids = ann.train_cells(chunks, 12)
    celled = ann.write_cells(chunks, centroids, str(tmp_path / "cells"))
    assert celled.count() == chunks.count()
    near = ann.top_chunks_in_cells(celled, queries, centroids, n_probe, k=20)
    exact = scoring.top_chunks(chunks, queries, DIM, k=20)
    if n_probe == 12:
        assert found(near) == found(exact)
    else:
        assert {r[:2] for r in found(near)} <= {
            r[:2] for r in found(scoring.top_chunks(chunks, queries, DIM, k=2000))
        }
        shares = [r["recall"] for r in ann.recall(near, exact).collect()]
        assert all(0 <= s <= 1 for s in shares) and np.mean(shares) > 0.3


@pytest.mark.parametrize("metric", scoring.METRICS)
@pytest.mark.parametrize("k", [3, 40])
def test_bounded_cells_are_exact(spark, data, metric, k, tmp_path):
    chunks, queries = tables(spark, data)
    centroids = ann.train_cells(chunks.filter(~F.exists("vector", F.isnan)), 12)
    celled = ann.write_cells(chunks, centroids, str(tmp_path / "cells"))
    widths = ann.cell_widths(celled, centroids)
    newer = spark.createDataFrame([("hot", "new", "c-new", 0, data[0][5][4])], CHUNKS)
    for more in (None, newer):
        near = ann.top_chunks_bounded(celled, queries, centroids, widths, 2, metric, k, uncelled=more)
        every = chunks if more is None else chunks.unionByName(more)
        same(found(near), found(scoring.top_chunks(every, queries, DIM, metric, k)))


def test_cells_that_cannot_matter_stay_unread(spark, tmp_path, monkeypatch):
    """Twenty bundles of vectors, one cell each: a query next to one reads few of them."""
    rng = np.random.default_rng(6)
    centres = unit(rng.normal(size=(20, 16)))
    vectors = np.repeat(centres, 50, axis=0) + rng.normal(size=(1000, 16)) * 0.03
    chunks = spark.createDataFrame(
        [("f", f"p{i}", f"c{i:04}", 0, v.tolist()) for i, v in enumerate(vectors)], CHUNKS
    )
    queries = spark.createDataFrame([(i, None, None, vectors[50 * i].tolist()) for i in range(4)], QUERIES)
    celled = ann.write_cells(chunks, centres, str(tmp_path / "cells"))
    read = []
    probed = ann.probed
    monkeypatch.setattr(ann, "probed", lambda *a: read.append(probed(*a)) or read[-1])
    widths = ann.cell_widths(celled, centres)
    near = ann.top_chunks_bounded(celled, queries, centres, widths, 1, k=10)
    same(found(near), found(scoring.top_chunks(chunks, queries, 16, k=10)))
    assert {c for cells in read for c in cells} == {0, 1, 2, 3}
    wide = ann.top_chunks_bounded(celled, queries, centres, np.full(20, np.pi), 1, k=10)
    same(found(wide), found(near))
    assert len(read[-1]) == 20 and ann.cell_widths(celled.limit(0), centres).tolist() == [-1.0] * 20


@pytest.mark.parametrize("metric", scoring.METRICS)
def test_floors_change_nothing_but_the_rows_that_move(spark, metric):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(12_800, 16)).astype(np.float32)
    frame = pd.DataFrame({"folder": "f", "path": "p", "chunk_id": [f"c{i:05}" for i in range(len(vectors))],
                          "chunk_index": 0, "vector": vectors.tolist()})
    chunks = spark.createDataFrame(frame, CHUNKS).repartition(64)
    queries = spark.createDataFrame(
        [(i, None, [None, 0.3][i % 2], rng.normal(size=16).tolist()) for i in range(40)], QUERIES
    )
    want = found(scoring.top_chunks(chunks, queries, 16, metric, 10))
    assert found(scoring.top_chunks(chunks, queries, 16, metric, 10, share=0.2)) == want
    store = scoring.store_requests(queries, 16, 10)
    before = scoring.local_best(chunks, store, metric, 10).count()
    raised = scoring.with_floors(chunks, store, metric, 10, 0.2)
    assert scoring.local_best(chunks, raised, metric, 10).count() * 10 <= before


def test_floors_are_sought_in_large_tables(spark, data, monkeypatch):
    chunks, _ = tables(spark, data)
    assert scoring.floor_share(chunks) is None  # of unknown size
    for tasks, share in ((63, None), (64, 0.2), (10_000, 0.02)):
        monkeypatch.setattr(scoring, "expected_tasks", lambda df: tasks)
        assert scoring.floor_share(chunks) == share


def test_nearest_cells_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    rows, centroids = unit(rng.normal(size=(50, DIM))), rng.normal(size=(7, DIM))
    centroids[4] = centroids[2]  # a tie goes to the smaller number
    away = ((rows[:, None, :] - centroids[None]) ** 2).sum(axis=2).round(9)
    expected = np.argsort(away, axis=1, kind="stable")
    monkeypatch.setattr(ann, "_DISTANCES_AT_ONCE", 20)
    for n in (1, 3, 7):
        found = ann.nearest_cells(rows, centroids, n)
        assert (found[:, :1] == expected[:, :1]).all() and found.shape == (50, n)
        assert (np.sort(found, axis=1) == np.sort(expected[:, :n], axis=1)).all()


def test_given_cells(spark):
    table = spark.createDataFrame([(2, [0.0, 1.0]), (1, [1.0, 0.0])], "cell long, vector array<double>")
    assert ann.given_cells(table).tolist() == [[1.0, 0.0], [0.0, 1.0]]


def test_rendering(spark):
    queries = spark.createDataFrame([(1, "q", 0.5), (2, "none", 0.3)], "query_id long, query string, cutoff double")
    files = spark.createDataFrame(
        [(1, 'a"b\\c.md', 0.75, 2), (1, "é/x.md", 1.0, 1)], "query_id long, path string, score double, rank int"
    )
    listed = render.ranked_lists(queries, files)
    rows = {
        r["query_id"]: r
        for r in listed.select(
            "query_id",
            render.pairs_json(F.col("files")).alias("pairs"),
            render.object_json(F.col("query"), F.col("cutoff"), F.col("files")).alias("object"),
            render.prompt_text(F.col("files")).alias("prompt"),
            render.add_commands(F.col("files")).alias("add"),
        ).collect()
    }
    import json

    assert json.loads(rows[1]["pairs"]) == {
        "files_by_relevance": [[1.0, "é/x.md"], [0.75, 'a"b\\c.md']]
    }
    assert json.loads(rows[2]["pairs"]) == {"files_by_relevance": []}
    assert json.loads(rows[1]["object"]) == {
        "query": "q", "cutoff": 0.5,
        "files_by_relevance": [
            {"file": "é/x.md", "relevance": 1.0}, {"file": 'a"b\\c.md', "relevance": 0.75},
        ],
    }
    assert json.loads(rows[2]["object"])["files_by_relevance"] == []
    assert rows[1]["prompt"] == 'The relevant data may be in these files:\n- é/x.md\n- a"b\\c.md'
    assert rows[1]["add"] == '/add é/x.md\n/add a"b\\c.md'


def test_chunks_are_not_shuffled(spark, tmp_path):
    """Between the stored chunks and the scorer there is no exchange, and only
    the needed columns are read."""
    path = str(tmp_path / "chunks")
    rows = spark.createDataFrame(
        [("f", "p", "h", 0, "c", "t", [1.0] * DIM)],
        "folder string, path string, hash string, chunk_index int, chunk_id string, text string, vector array<float>",
    )
    rows.write.parquet(path)
    queries = spark.createDataFrame([(0, "f", 0.3, [1.0] * DIM)], QUERIES)
    top = scoring.top_chunks(spark.read.schema(rows.schema).parquet(path), queries, DIM)
    plan = top._jdf.queryExecution().executedPlan().toString()
    scorer = plan.index("MapInArrow")
    assert "Exchange" not in plan[scorer:]
    assert plan[:scorer].count("Exchange") == 1
    assert "EqualTo(folder,f)" in plan or "GreaterThanOrEqual(folder" in plan
    scan = plan[plan.index("ReadSchema"):]
    assert "text" not in scan and "hash" not in scan
    assert rows.schema["vector"].dataType.simpleString() == VECTOR.simpleString()
