"""Whitening of embeddings, with the eigenvalues found by slicing the spectrum.

Entries become whole numbers x = floor(64 c) + 1,000,000. The fit list is each distinct
x vector once. Its number, its sums and its products are added up exactly: entries are
taken relative to whole numbers next to the mean, multiplied in blocks of doubles whose
sums stay below 2^53 (Python's integers where entries are too large for that) and added
as integers; what the whole numbers lack of the mean is taken off in exact fractions. So
the covariance is right to the last bit and does not depend on the order of rows. Tasks
send one matrix each; these are added in tasks, too, until at most `_TO_DRIVER` are left.

The matrix has the size of a vector squared, whatever the table holds, and its spectrum
is cut up in the driver: an LDL' factorisation of V - s I with symmetric pivots has as
many positive pivots as V has eigenvalues above s. Bisection with these counts puts each
leading eigenvalue in an interval of its own, where Rayleigh quotient iteration converges
cubically; the counts on both sides of the value found certify its number. Eigenvalues
that differ by less than rounding share an interval; their vectors come from iteration of
a whole subspace, and any basis of it is as good as another.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped; zero
vectors and null ids are kept, repeated rows give repeated results, other columns are
ignored, an empty table gives no rows. Vectors must have one length. Components whose
eigenvalue is zero up to rounding (equal vectors, more dimensions than rows) cannot be
whitened and are left out. Whole numbers beyond 2^52 are cut to it. A deviation that a
long cannot hold is null."""

import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .vectors import finite

SCALE, SHIFT = 64, 1_000_000
_LIMIT = 2.0**52
_TO_DRIVER = 16


def whole(column: pa.Array) -> np.ndarray:
    """The entries of a list column as whole numbers, one row per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) == 0:
        return np.empty((0, 0), np.int64)
    if len(flat) % len(column) or len(set(column.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors differ in length")
    scaled = np.floor(np.clip(flat * SCALE, -_LIMIT, _LIMIT)).astype(np.int64) + SHIFT
    return scaled.reshape(len(column), -1)


def _products(y: np.ndarray) -> np.ndarray:
    """y'y, exact."""
    largest = int(np.abs(y).max(initial=0))
    if largest == 0:
        return np.zeros((y.shape[1], y.shape[1]), object)
    rows = 2**53 // largest**2
    if rows == 0:
        y = y.astype(object)
        return y.T @ y
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for start in range(0, len(y), min(rows, 8192)):
        part = y[start : start + min(rows, 8192)].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _added(parts: DataFrame) -> list:
    """The sum of the pickled values of `part`, added in tasks while they are many."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column("part").to_pylist():
                value = pickle.loads(value)
                total = value if total is None else [a + b for a, b in zip(total, value)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(total)], pa.binary())})

    parts = materialize(parts, "whitening-sums")
    many = parts.count()
    while many > _TO_DRIVER:
        few = max(_TO_DRIVER, int(np.sqrt(many)))
        parts = materialize(parts.repartition(few).mapInArrow(add, "part binary"), "whitening-sums")
        many = parts.count()
    values = [pickle.loads(bytes(r["part"])) for r in parts.collect()]
    return [sum(column[1:], column[0]) for column in zip(*values)]


def _summed(vectors: DataFrame, of_rows) -> list:
    """The sum of `of_rows(x)` over blocks of the whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                value = of_rows(batch.column("x"))
                total = value if total is None else [a + b for a, b in zip(total, value)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(total)], pa.binary())})

    return _added(vectors.select("x").mapInArrow(run, "part binary"))


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = set(column.value_lengths().to_pylist())
    if len(lengths) > 1:
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy().reshape(len(column), -1)


def moments(fit: DataFrame) -> tuple[int, list[int], np.ndarray] | None:
    """(n, sums, covariance) of the distinct whole vectors `fit(x)`."""

    def first(x: pa.Array) -> list:
        m = _matrix(x)
        return [len(m), (m >> 26).sum(axis=0).astype(object) * 2**26 + (m & (2**26 - 1)).sum(axis=0)]

    if fit.isEmpty():
        return None
    n, sums = _summed(fit, first)
    n, sums = int(n), [int(s) for s in sums]
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def second(x: pa.Array) -> list:
        return [_products(_matrix(x) - near)]

    (products,) = _summed(fit, second)
    off = [s - n * int(c) for s, c in zip(sums, near)]  # of the sums, at most n / 2 each
    size = len(sums)
    covariance = np.empty((size, size))
    for i in range(size):
        for j in range(i, size):
            exact = Fraction(n * int(products[i, j]) - off[i] * off[j], n * n)
            covariance[i, j] = covariance[j, i] = float(exact)
    return n, sums, covariance


# -- the spectrum ----------------------------------------------------------------------


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed `shift`: the positive pivots of
    an LDL' factorisation of matrix - shift I, with pivots of one or two rows (Bunch and
    Kaufman)."""
    a = matrix - shift * np.eye(len(matrix))
    tiny = np.finfo(float).eps * max(np.abs(a).max(initial=0.0), np.finfo(float).tiny)
    alpha, positive, k, n = (1 + np.sqrt(17)) / 8, 0, 0, len(a)

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        width, below = 1, np.abs(a[k + 1 :, k])
        if len(below) and below.max() > 0 and abs(a[k, k]) < alpha * below.max():
            r = k + 1 + int(below.argmax())
            others = np.abs(np.delete(a[k:, r], r - k)).max()
            if abs(a[k, k]) * others >= alpha * below.max() ** 2:
                pass
            elif abs(a[r, r]) >= alpha * others:
                swap(k, r)
            else:
                width = 2
                swap(k + 1, r)
        if width == 1:
            pivot = a[k, k] if abs(a[k, k]) > tiny * 1e-3 else -tiny * 1e-3
            positive += pivot > 0
            column = a[k + 1 :, k].copy()
            if column.any():
                a[k + 1 :, k + 1 :] -= np.outer(column / pivot, column)
        else:  # one eigenvalue of each sign, as its determinant is negative
            positive += 1
            block, columns = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= columns @ np.linalg.solve(block, columns.T)
        k += width
    return int(positive)


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    size, step = len(matrix), np.finfo(float).eps * np.abs(matrix).max()
    for attempt in range(8):
        try:
            out = np.linalg.solve(matrix - (shift + step * attempt * 2**attempt) * np.eye(size), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all():
            return out
    return right


def _intervals(matrix: np.ndarray, count: int, rounding: float) -> list[tuple[float, float, int, int]]:
    """(low, high, first number, how many) of the intervals, from the top, that hold the
    `count` leading eigenvalues: one each, unless several are within rounding."""
    radius = np.abs(matrix).sum(axis=1).max()
    top, bottom = radius * (1 + 1e-12) + rounding, -radius * (1 + 1e-12) - rounding
    waiting, out = [(bottom, top, len(matrix), 0)], []  # eigenvalues above low, above high
    while waiting:
        low, high, over_low, over_high = waiting.pop()
        many = over_low - over_high
        if many == 0 or over_high >= count:
            continue
        middle = (low + high) / 2
        if many == 1 and (high - low) < 0.05 * max(abs(low), abs(high)) or high - low <= rounding:
            out.append((low, high, over_high + 1, many))
            continue
        over_middle = min(max(above(matrix, middle), over_high), over_low)
        waiting.append((low, middle, over_low, over_middle))
        waiting.append((middle, high, over_middle, over_high))
    return sorted(out, key=lambda x: x[2])


def _one_vector(matrix: np.ndarray, low: float, high: float, number: int, known: np.ndarray, rounding: float):
    """The eigenvector of the only eigenvalue in the interval. The interval is halved
    until Rayleigh quotient iteration from inside it stays inside."""
    rng = np.random.default_rng(number)
    while True:
        shift = (low + high) / 2
        v = rng.normal(size=len(matrix))
        for _ in range(3):  # towards the eigenvalues next to the middle
            v = _solve(matrix, shift, v)
            v -= known @ (known.T @ v)
            v /= np.linalg.norm(v)
        value = float(v @ matrix @ v)
        for _ in range(12):
            v = _solve(matrix, value, v)
            v /= np.linalg.norm(v)
            after = float(v @ matrix @ v)
            done = abs(after - value) <= rounding
            value = after
            if done:
                break
        residual = np.linalg.norm(matrix @ v - value * v)
        edge = 4 * rounding
        if low - edge <= value <= high + edge and residual <= 64 * rounding or high - low <= rounding:
            return value, v
        if above(matrix, shift) >= number:
            low = shift
        else:
            high = shift


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a positive semidefinite matrix, falling, and
    their unit vectors as columns. Values that are zero up to rounding are left out."""
    size = len(matrix)
    scale = float(np.abs(matrix).max(initial=0.0))
    if scale == 0.0:
        return np.empty(0), np.empty((size, 0))
    rounding = np.finfo(float).eps * scale * size
    values, vectors = [], np.empty((size, 0))
    for low, high, number, many in _intervals(matrix, min(count, size), rounding):
        if many == 1:
            value, v = _one_vector(matrix, low, high, number, vectors, rounding)
            found, basis = np.array([value]), v[:, None]
        else:
            basis = np.random.default_rng(number).normal(size=(size, many))
            for _ in range(6):
                basis = _solve(matrix, (low + high) / 2, basis)
                basis -= vectors @ (vectors.T @ basis)
                basis = np.linalg.qr(basis)[0]
            # inside the subspace all values agree up to rounding, so any basis will do
            found = np.einsum("ij,ik,kj->j", basis, matrix, basis)
            order = np.argsort(-found)
            found, basis = found[order], basis[:, order]
        edge = 64 * rounding
        if above(matrix, found.min() - edge) < number + many - 1 or above(matrix, found.max() + edge) >= number:
            raise ArithmeticError(f"eigenvalue {number} is not where its count says")
        values += found.tolist()
        vectors = np.hstack([vectors, basis])
    kept = [i for i, value in enumerate(values) if value > 16 * rounding][:count]
    return np.array(values)[kept], vectors[:, kept]


# -- the operator ----------------------------------------------------------------------


def _deviations(off: np.ndarray) -> pa.Array:
    """Sums of squares of whole numbers, null where a long cannot hold one."""
    if int(np.abs(off).max(initial=0)) ** 2 * max(off.shape[1], 1) < 2**63:
        return pa.array((off * off).sum(axis=1).astype(np.int64))
    sums = [sum(int(x) ** 2 for x in row) for row in off]
    return pa.array([s if s < 2**63 else None for s in sums], pa.int64())


def whitened(table: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per
    row of `table` that remains and component."""
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    rows = finite(table)

    def to_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column("vector"))
            lists = pa.ListArray.from_arrays(
                np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)[: len(x) + 1], pa.array(x.ravel())
            )
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], ["vec_id", "x"])

    stored = materialize(rows.mapInArrow(to_whole, "vec_id long, x array<long>"), "whitening-rows")
    fit = materialize(stored.select("x").distinct(), "whitening-fit")
    found = moments(fit)
    if found is None:
        return stored.sparkSession.createDataFrame([], schema)
    n, sums, covariance = found
    values, vectors = leading(covariance, components)
    share = values / np.trace(covariance) if len(values) else values
    scaled = vectors / np.sqrt(values)
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([float(Fraction(s, n) - int(c)) for s, c in zip(sums, near)])

    def project(x: pa.Array) -> np.ndarray:
        return ((_matrix(x) - near).astype(np.float64) - rest) @ scaled

    if len(values):

        def measure(x: pa.Array) -> list:
            z = project(x)
            return [z.T @ z, z.sum(axis=0)]

        second, first = _summed(fit, measure)
        measured = second / n - np.outer(first, first) / n**2
        error = float(np.abs(measured - np.eye(len(values))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, k = batch.num_rows, len(values)
            if many == 0 or k == 0:
                continue
            x = _matrix(batch.column("x"))
            if n * int(np.abs(x - near).max()) < 2**61:
                off = n * (x - near) - np.array([s - n * int(c) for s, c in zip(sums, near)], np.int64)
            else:
                off = n * x.astype(object) - np.array(sums, object)
            where = pa.array(np.repeat(np.arange(many), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(where),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * k, n)),
                    _deviations(off).take(where),
                    pa.array(project(batch.column("x")).ravel()),
                    pa.array(np.tile(share, many)),
                    pa.array(np.full(many * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return stored.mapInArrow(run, schema)
