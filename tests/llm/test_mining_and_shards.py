"""Hard negatives, whitening and shards against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekwell.llm import hard_negatives, shards, whitening
from seekwell.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, row long, part long, whole long, x long"
BAD = [None, [], [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7]


def _vectors(n=240, size=8, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, size))
    rows = [
        (i, [float(x) for x in centre[i % 12] + rng.normal(size=size) * 0.4], i % 5, 0, 0, 0, 0) for i in range(n)
    ]
    rows += [(n + i, rows[7][1], i % 2, 0, 0, 0, 0) for i in range(90)]  # copies of one vector
    rows += [(1000 + i, v, 1, 0, 0, 0, 0) for i, v in enumerate(BAD)]
    rows += [(1010, [0.0] * size, 2, 0, 0, 0, 0), rows[5], rows[5], (1050, rows[9][1], None, 0, 0, 0, 0)]
    return rows + [(None, rows[11][1], 3, 0, 0, 0, 0)]


def _finite(rows):
    return [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all()]


# -- hard negatives -------------------------------------------------------------------


@pytest.mark.parametrize("largest", [1, 300, 2**20, 2**28 - 1])
def test_products_are_exact(largest):
    rng = np.random.default_rng(0)
    left, right = (rng.integers(-largest, largest + 1, (n, 64)) for n in (9, 13))
    left[0], right[0], right[1] = largest, largest, -largest
    primes = hard_negatives.primes_for(64, 64 * largest**2)
    got = hard_negatives.products(*(hard_negatives.residues(m, primes) for m in (left, right)), primes)
    assert (got == left.astype(object) @ right.astype(object).T).all()


def _mined(rows, label_of, asked):
    taken = {(i, label_of(i, label), tuple(np.float32(v).astype(float))) for i, v, label, *_ in _finite(rows)
             if i is not None and label is not None}
    known = [(i, label, np.floor(256 * np.array(v)).astype(int)) for i, label, v in taken]
    out = []
    for anchor, label, v in known:
        if not asked(anchor):
            continue
        scored = sorted((-int(v @ w), i, other) for i, other, w in known if i != anchor)
        for minus, positive, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus][:3]
            out += [(anchor, positive, k + 1, i, -minus, -s) for k, (s, i, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("settings", [hard_negatives.Mining(), hard_negatives.Mining(block=3, part=16)])
def test_hard_negatives(spark, settings):
    rows = _vectors()
    frame = spark.createDataFrame(rows, VECTORS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, label, settings).collect()
    want = _mined(rows, lambda i, x: (x + 1) % 10 if i % 7 == 0 else x, lambda i: i % 10 == 0)
    assert len(want) > 200
    assert sorted(map(tuple, got)) == want
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    empty = hard_negatives.hard_negatives(frame.limit(0), F.col("vec_id") % 10 == 0)
    assert empty.columns == columns and empty.count() == 0
    assert hard_negatives.hard_negatives(frame, F.lit(False)).count() == 0
    one = hard_negatives.hard_negatives(frame.filter("vec_id = 10"), F.lit(True))
    assert one.count() == 0


def test_hard_negatives_of_negative_and_large_scores(spark):
    rows = [(i, [1e5 * x, 1.0], i % 2, 0, 0, 0, 0) for i, x in enumerate([1, -1, -1, 0.7, 0.6, 0.9, -0.5])]
    rows += [(99, [1e30, 1.0], 1, 0, 0, 0, 0)]  # no long holds its scores
    frame = spark.createDataFrame(rows, VECTORS)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") >= 0).collect()
    assert sorted(map(tuple, got)) == _mined(rows[:-1], lambda i, x: x, lambda i: True)


# -- whitening ------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["plain", "few rows", "equal values", "zeros", "pairs", "graded"])
def test_leading_values(kind):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(90, 24))
    if kind == "few rows":
        a = a[:6]
    if kind == "zeros":
        a[:, 9:] = 0
    if kind == "graded":
        a *= 10.0 ** -np.arange(24)
    matrix = a.T @ a
    if kind == "equal values":
        matrix = np.eye(24) * 3
    if kind == "pairs":
        q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
        matrix = (q * np.repeat(np.arange(12, 0, -1.0), 2)) @ q.T
        matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading(matrix, 16)
    want = np.linalg.eigvalsh(matrix)[::-1]
    scale = want[0]
    assert len(values) == min(16, int((want > 1e-13 * scale).sum()))
    assert np.abs(values - want[: len(values)]).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * scale
    for shift in (-1.0, 0.5 * scale, 2 * scale, want[3] * 1.001):
        assert whitening.above(matrix, shift) == (want > shift).sum()


def test_inertia_of_matrices_without_a_leading_pivot():
    rng = np.random.default_rng(1)
    for n in range(1, 9):
        for _ in range(30):
            m = rng.integers(-2, 3, (n, n)).astype(float)
            m = np.triu(m, 1) + np.triu(m, 1).T  # nothing on the diagonal
            want = np.linalg.eigvalsh(m)
            if np.abs(want).min() > 1e-9:
                assert whitening.above(m, 0.0) == (want > 0).sum()


def test_whitened(spark):
    rows = _vectors()
    good = _finite(rows)
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS), 16).collect()
    x = np.floor(64 * np.float32([r[1] for r in good]).astype(float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 8 * len(good)
    white = (x - total / n) @ vectors / np.sqrt(values)
    for component in range(8):
        mine = [r for r in got if r["component"] == component + 1]
        by_id = sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["whitened"], r["deviation"]) for r in mine)
        plain = sorted(
            ((r[0] is None, r[0] or 0), w, int(((n * v - total) ** 2).sum()))
            for r, w, v in zip(good, white[:, component], x)
        )
        a, b = (np.array([y[1] for y in z]) for z in (by_id, plain))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert [y[2] for y in by_id] == [y[2] for y in plain]
        assert {r["n"] for r in mine} == {n}
        assert {r["explained"] for r in mine} == {mine[0]["explained"]}
        assert mine[0]["explained"] == pytest.approx(values[component] / np.trace(covariance), rel=1e-12)
    assert 0 <= got[0]["identity_error"] < 1e-12


def test_whitened_of_little(spark):
    frame = spark.createDataFrame(_vectors(), VECTORS)
    assert whitening.whitened(frame.limit(0)).count() == 0
    assert whitening.whitened(frame.filter("vec_id BETWEEN 240 AND 260")).count() == 0  # equal vectors
    two = whitening.whitened(frame.filter("vec_id < 2")).collect()
    assert [(r["component"], round(abs(r["whitened"]), 9), round(r["explained"], 12)) for r in two] == [(1, 1.0, 1.0)] * 2
    huge = spark.createDataFrame([(1, [3e35, 1.0]), (2, [1.0, 2.0]), (3, [5.0, 9.0])], "vec_id long, embedding array<float>")
    assert {r["deviation"] for r in whitening.whitened(huge).collect()} == {None}


def test_sums_are_added_in_tasks(spark):
    frame = spark.createDataFrame(_vectors(), VECTORS).filter("vec_id IS NOT NULL").repartition(70, "vec_id")
    few = whitening.whitened(frame.coalesce(1)).orderBy("vec_id", "component").collect()
    many = whitening.whitened(frame).orderBy("vec_id", "component").collect()
    assert [r["deviation"] for r in few] == [r["deviation"] for r in many]
    assert {r["explained"] for r in few} == {r["explained"] for r in many}  # exact sums: not a rounding apart
    assert np.abs(np.array([r["whitened"] for r in few]) - [r["whitened"] for r in many]).max() < 1e-12


# -- shards ---------------------------------------------------------------------------


def _walk(sizes, capacity):
    count, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return len(sizes) + 1
        if s > room:
            count, room = count + 1, capacity
        room -= s
    return count


def _smallest(sizes, count):
    return next(c for c in range(max(sizes), sum(sizes) + 1) if _walk(sizes, c) <= count)


@pytest.mark.parametrize("seed", range(8))
def test_cuts_of_a_line(seed):
    """Cells of many units give the same cuts as the whole line in one list."""
    rng = np.random.default_rng(seed)
    keys = np.sort(rng.choice(4000, 90, replace=False))
    sizes = rng.integers(1, 40, 90) ** (1 + seed % 2)
    units = list(zip(keys.tolist(), sizes.tolist()))
    asked = []

    def cells(some, bits):
        out = {}
        for k, s in some:
            size, n = out.get(k >> bits, (0, 0))
            out[k >> bits] = size + s, n + 1
        return [shards._Cell(c << bits, bits, size, n) for c, (size, n) in out.items()]

    def finer(doubtful):
        asked.append(len(doubtful))
        return [x for c in doubtful for x in cells([u for u in units if u[0] >> c.bits == c.start >> c.bits], c.bits // 2)]

    count = 3 + seed
    line = shards.Line([], cells(units, 8), finer)
    plan = shards.cut_line(line, count)
    want = _smallest(sizes.tolist(), count)
    place = np.searchsorted(plan.cuts, keys, side="right")
    of_shard = np.bincount(place, sizes, minlength=count)
    assert plan.capacity == want == of_shard.max()
    assert plan.first == 0 and len(of_shard) == count and asked


def test_sharded(spark):
    rng = np.random.default_rng(2)
    texts = ["word " * int(n) for n in rng.integers(1, 40, 60)] + [f"text {i} ä" for i in range(90)]
    rows = [(i, texts[int(rng.integers(len(texts)))], 1, 0, 0) for i in range(300)]
    rows += [(1000 + i, "hot " * 20, 1, 0, 0) for i in range(150)]
    rows += [(5, None, 1, 0, 0), (6, "", 1, 0, 0), (None, "x" * 5000, 1, 0, 0), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, shard int, size int")
    got = shards.sharded(docs, 7).collect()
    assert len(got) == len(rows)
    import zlib

    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted(
        (size(t), zlib.crc32((t or "").encode())) for _, t, *_ in rows
    )
    of_text, of_shard = {}, {}
    for r in got:
        of_text.setdefault(r["text_crc32"], set()).add(r["shard"])
        of_shard.setdefault(r["shard"], []).append(r)
    assert all(len(s) == 1 for s in of_text.values())
    for members in of_shard.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    # no cut of the same line has a smaller largest shard
    keyed = docs.select(shards.key_of().alias("key"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    units = keyed.groupBy("key").agg(F.sum(F.col("n") + 16).alias("size")).collect()
    total = sum(u["size"] for u in units)
    line = sorted(units, key=lambda u: (-u["size"], 0) if u["size"] > total // 7 else (0, u["key"]))
    largest = max(sum(r["size"] for r in members) for members in of_shard.values())
    assert largest == _smallest([u["size"] for u in line], 7)
    assert set(of_shard) == set(range(7))
    assert shards.sharded(docs.limit(0)).count() == 0
    few = shards.sharded(docs.filter("doc_id = 6 OR doc_id IS NULL"), 5).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0)]


def test_write_shards(spark, tmp_path):
    rows = [(i, f"some text {i % 40}", 3) for i in range(200)] + [(900, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    shards.write_shards(docs, str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = {(r["doc_id"], r["shard"]) for r in shards.sharded(docs, 4).collect()}
    assert {(r["doc_id"], r["shard"]) for r in got.collect()} == want
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == sorted((i, t or "") for i, t, _ in rows)


def test_registered():
    assert {"op11_hard_negatives", "op12_whitening", "op13_shards"} <= set(QUERIES)
