"""Whitening of embeddings by a bidiagonal qd solver.

Tasks reduce blocks of centred rows to triangles by QR, and triangles are
reduced in groups until one is left. On the driver Householder reflections
bidiagonalise it, the dqds iteration finds the squared singular values to high
relative accuracy, and twisted factorisations of the shifted bidiagonal give
their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .topk import is_finite, whole_numbers

_EPS = np.finfo(float).eps
#: Added to every whole number, and the scale before rounding down.
OFFSET, SCALE = 1_000_000, 64
#: Triangles that one task reduces to one; rows of a block.
GROUP, ROWS = 8, 4096
#: Eigenvalues closer than this, relative to their size, are told apart from a shift nearby.
CLOSE = 1e-6


# Bidiagonal form.
def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right vectors (as columns) of a square matrix, by Householder reflections."""
    a = r.astype(float).copy()
    n = len(a)
    right = np.eye(n)
    for k in range(n):
        x = a[k:, k]
        if np.abs(x[1:]).max(initial=0.0) > 0:
            v = _reflector(x)
            a[k:, k:] -= np.outer(v, v @ a[k:, k:])
        if k + 2 < n and np.abs(a[k, k + 2 :]).max(initial=0.0) > 0:
            v = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray:
    """v with |v|^2 = 2, so that x - v (v.x) is a multiple of the first unit vector."""
    v = x / np.abs(x).max()
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v * (np.sqrt(2.0) / np.linalg.norm(v))


# Singular values.
def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues, falling, of B^T B by differential quotient-difference steps with shifts.

    ``q`` are the squared diagonal and ``e`` the squared superdiagonal of B.
    A step whose shift turns out too large is done again with a smaller one.
    """
    found, blocks = [], [(q.astype(float).tolist(), e.astype(float).tolist(), 0.0)]
    while blocks:
        q, e, sigma = blocks.pop()
        shift = 0.0
        while q:
            n = len(q)
            if n == 1:
                found.append(sigma + q[0])
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= _EPS * _EPS * max(q[i] + sigma, q[i + 1] + sigma) or e[i] <= _EPS * _EPS * sigma), None)
            if cut is not None:
                blocks.append((q[cut + 1 :], e[cut + 1 :], sigma))
                q, e, shift = q[: cut + 1], e[:cut], 0.0
                continue
            if q[0] < q[-1] and shift == 0.0:  # large ones belong at the top
                q, e = q[::-1], e[::-1]
            while True:
                d, new_q, new_e, least = q[0] - shift, [], [], None
                if d < 0:
                    least = -1.0
                else:
                    least = d
                    for i in range(n - 1):
                        new_q.append(top := d + e[i])
                        if top <= 0.0:
                            new_e.append(0.0)
                            d = q[i + 1] - shift
                        else:
                            new_e.append(e[i] * (q[i + 1] / top))
                            d = d * (q[i + 1] / top) - shift
                        least = min(least, d)
                        if d < 0 or d != d:
                            least = -1.0
                            break
                if least >= 0:
                    new_q.append(d)
                    break
                shift = shift / 4 if shift > _EPS * sigma and shift > 1e-300 else 0.0
            sigma += shift
            q, e = new_q, new_e
            # What is left at the end is about the smallest value; a part of it is safe as the next shift.
            shift = max(0.0, min(least, q[-1]) * (1 - 4 * np.sqrt(min(1.0, e[-1] / max(q[-1], 1e-300)))) * 0.98) if q[-1] > 0 else 0.0
    return np.sort(np.array(found))[::-1]


# Vectors.
def _stationary(d: np.ndarray, low: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L+ D+ L+^T = L D L^T - shift from the top: D+, L+ and the auxiliary values."""
    n = len(d)
    plus, lower, s = np.empty(n), np.empty(n - 1), np.empty(n)
    s[0] = -shift
    for i in range(n - 1):
        plus[i] = d[i] + s[i]
        if plus[i] == 0.0:
            plus[i] = _EPS * _EPS * max(abs(d[i]), 1e-300)
        lower[i] = d[i] * low[i] / plus[i]
        s[i + 1] = lower[i] * low[i] * s[i] - shift
    plus[-1] = d[-1] + s[-1]
    return plus, lower, s


def _progressive(d: np.ndarray, low: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U- D- U-^T = L D L^T - shift from the bottom."""
    n = len(d)
    minus, upper, p = np.empty(n), np.empty(n - 1), np.empty(n)
    p[-1] = d[-1] - shift
    for i in range(n - 2, -1, -1):
        minus[i + 1] = d[i] * low[i] * low[i] + p[i + 1]
        if minus[i + 1] == 0.0:
            minus[i + 1] = _EPS * _EPS * max(abs(d[i]), 1e-300)
        t = d[i] / minus[i + 1]
        upper[i] = low[i] * t
        p[i] = p[i + 1] * t - shift
    minus[0] = p[0]
    return minus, upper, p


def twisted(d: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Unit vector of L D L^T for a value, from the twisted factorisation of the least pivot, and a correction of the value."""
    n = len(d)
    if n == 1:
        return np.ones(1), 0.0
    plus, lower, s = _stationary(d, low, value)
    minus, upper, p = _progressive(d, low, value)
    pivot = np.append(s[:-1] + d[:-1] / minus[1:] * p[1:], plus[-1])
    pivot[0] = minus[0]
    pivot[~np.isfinite(pivot)] = np.inf
    k = int(np.abs(pivot).argmin())
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -upper[i] * z[i]
    size = float(z @ z)
    return z / np.sqrt(size), float(pivot[k] / size) if np.isfinite(pivot[k]) else 0.0


def _below(d: np.ndarray, low: np.ndarray, shift: float) -> int:
    """How many eigenvalues of L D L^T are below a shift."""
    return int((_stationary(d, low, shift)[0] < 0).sum())


def _located(d: np.ndarray, low: np.ndarray, rank: int, low_end: float, high_end: float) -> float:
    """The eigenvalue of a rank (from the smallest, 0) of L D L^T between two bounds, by bisection."""
    for _ in range(200):
        middle = (low_end + high_end) / 2
        if middle in (low_end, high_end) or abs(high_end - low_end) <= 4 * _EPS * max(abs(low_end), abs(high_end)):
            break
        if _below(d, low, middle) > rank:
            high_end = middle
        else:
            low_end = middle
    return (low_end + high_end) / 2


def _vectors(d: np.ndarray, low: np.ndarray, values: list[float], ranks: list[int], depth: int = 0) -> list[np.ndarray]:
    """Vectors of the falling values of one L D L^T; close ones are told apart from a shift near them."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(values):
        to = at + 1
        while to < len(values) and values[to - 1] - values[to] <= CLOSE * abs(values[to - 1]):
            to += 1
        if to - at == 1 or depth == 4:
            for value in values[at:to]:
                z, more = twisted(d, low, value)
                for _ in range(2):
                    value += more
                    z, more = twisted(d, low, value)
                out.append(z)
        else:
            high, least = values[at], values[to - 1]
            width = max(high - least, 8 * len(d) * _EPS * abs(high))
            shift = least - width  # below all of them, and much nearer than their size
            plus, lower, _ = _stationary(d, low, shift)
            reach = (high - least) + 4 * width
            local = [_located(plus, lower, rank, 0.0 - width, reach) for rank in ranks[at:to]]
            out += _vectors(plus, lower, local, ranks[at:to], depth + 1)
        at = to
    return out


def eigenvectors(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues of r^T r, falling, and unit vectors (as columns) of the first k of them that aren't zero to double precision."""
    n = len(r)
    if not n or not np.abs(r).max(initial=0.0):
        return np.zeros(n), np.zeros((n, 0))
    scale = np.abs(r).max()
    a, b, right = bidiagonal(r / scale)
    b[np.abs(b) <= _EPS * max(np.abs(a).max(), np.abs(b).max(initial=0.0))] = 0.0
    pairs, values = [], []
    cuts = [0, *(np.flatnonzero(b == 0.0) + 1).tolist(), n]
    for lo, hi in zip(cuts, cuts[1:]):  # blocks that don't touch each other
        own = dqds(a[lo:hi] ** 2, b[lo : hi - 1] ** 2)
        values += own.tolist()
        pairs += [(v, lo, hi, hi - lo - 1 - i) for i, v in enumerate(own.tolist())]
    values = np.sort(np.array(values))[::-1]
    floor = values[0] * (n * _EPS) ** 2
    chosen = sorted(pairs, key=lambda x: -x[0])[:k]
    chosen = [x for x in chosen if x[0] > max(floor, 0.0) and x[0] > values[0] * 1e-24]
    found: dict[tuple, np.ndarray] = {}
    for lo, hi in {(x[1], x[2]) for x in chosen}:
        own = [x for x in chosen if x[1:3] == (lo, hi)]
        diagonal, above = a[lo:hi], b[lo : hi - 1]
        safe = np.where(diagonal == 0.0, _EPS * max(np.abs(a).max(), 1e-300), diagonal)
        for x, z in zip(own, _vectors(safe**2, above / safe[:-1], [x[0] for x in own], [x[3] for x in own])):
            found[x] = z
    out = np.zeros((n, len(chosen)))
    for j, x in enumerate(chosen):
        own = np.zeros(n)
        own[x[1] : x[2]] = found[x]
        for _ in range(2):  # what rounding has left of the vectors before
            own -= out[:, :j] @ (out[:, :j].T @ own)
        out[:, j] = own / np.linalg.norm(own)
    return values * scale * scale, right @ out


# The operator.
@dataclass(frozen=True)
class Whitening:
    """``mean`` is S div n and ``rest`` S mod n, so that no large number is rounded; ``basis`` has a column per component."""

    n: int
    mean: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    trace: float
    basis: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean).astype(float) - (self.rest.astype(float) / self.n)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        k = self.basis.shape[1]
        return self.centred(x) @ self.basis / np.sqrt(self.values[:k])


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)``: rows of finite vectors as whole numbers; others are left out."""
    vector = F.col(vector_col)
    numbers = F.transform(whole_numbers(vector, SCALE), lambda v: v + OFFSET)
    return rows.where(is_finite(vector)).select(F.col(id_col).alias("vec_id"), numbers.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Vectors of blocks of rows; shorter ones are filled up with what a zero becomes."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            column = part.column(part.schema.get_field_index("x"))
            length = column.value_lengths().to_numpy()
            out = np.full((part.num_rows, dim), OFFSET, np.int64)
            out[np.arange(dim)[None, :] < length[:, None]] = column.flatten().to_numpy()
            yield part, out


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """Whitening of the distinct vectors ``x``; None without a vector.

    Each distinct vector counts once. Sums are whole numbers; rows are centred
    by them before anything is multiplied. The driver gets two numbers per
    dimension, one triangle and one small matrix, whatever the number of rows.
    """
    spark = vectors.sparkSession
    rows = materialise(vectors.select("x").distinct(), "distinct")
    n, dim = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not dim:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for _, x in _matrices(batches, dim):
            wide = np.abs(x).max(initial=0) >= (1 << 62) // ROWS
            total = [a + int(b) for a, b in zip(total, x.astype(object).sum(axis=0) if wide else x.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(v) for v in total])], names=["i", "s"])

    sums = dict(rows.mapInArrow(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string")).collect())
    sums = [int(sums[i]) for i in range(dim)]
    base = Whitening(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64), np.zeros(dim), 0.0, np.zeros((dim, 0)))
    sent = spark.sparkContext.broadcast(base)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, dim))
        for _, x in _matrices(batches, dim):
            r = np.linalg.qr(np.concatenate([r, sent.value.centred(x)]), mode="r")
        if len(r):
            yield _triangle(TaskContext.get().partitionId(), r)

    def merge(table: pa.Table) -> pa.Table:
        r = np.concatenate([np.frombuffer(x, float).reshape(-1, dim) for x in table.column("r").to_pylist()])
        return pa.Table.from_batches([_triangle(table.column("i")[0].as_py(), np.linalg.qr(r, mode="r"))])

    triangles = materialise(rows.mapInArrow(reduce, "i long, r binary"), "triangles")
    left = triangles.count()
    while left > 1:
        numbered = triangles.withColumn("i", F.expr(f"i div {GROUP}"))
        triangles = materialise(numbered.groupBy("i").applyInArrow(merge, "i long, r binary"), "triangles")
        left = triangles.count()
    r = np.frombuffer(triangles.first().r, float).reshape(-1, dim)
    r = np.concatenate([r, np.zeros((max(0, dim - len(r)), dim))])[:dim]
    values, basis = eigenvectors(r, min(components, dim))
    found = Whitening(n, base.mean, base.rest, values / n, float((r * r).sum()) / n, basis)
    return Whitening(n, base.mean, base.rest, found.values, found.trace, basis, _identity_error(rows, found, dim))


def _triangle(i: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["i", "r"])


def _identity_error(rows: DataFrame, w: Whitening, dim: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = w.basis.shape[1]
    if not k:
        return 0.0
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for _, x in _matrices(batches, dim):
            y = sent.value.whitened(x)
            total += y.sum(axis=0)
            products += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), pa.array(np.concatenate([products.ravel(), total]))], names=["i", "v"])

    found = dict(rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect())
    flat = np.array([found[i] for i in range(k * k + k)]) / w.n
    mean = flat[k * k :]  # rows are centred already: what rounding has left
    return float(np.abs(flat[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, w: Whitening | None) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is exact, and null where it is beyond 64 bits. Rows with equal
    or null ids are rows of their own.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None:
        return vectors.sparkSession.createDataFrame([], out)
    sent = vectors.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Whitening = sent.value
        k, dim = own.basis.shape[1], len(own.mean)
        for part, x in _matrices(batches, dim):
            if not k:
                continue
            deviation = pa.array(_deviations(x, own))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            arrays = [
                part.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, own.n, np.int64)),
                deviation.cast(pa.int64()).take(each),
                pa.array(own.whitened(x).ravel()),
                pa.array(np.tile(own.values[:k] / own.trace, len(x))),
                pa.array(np.full(len(x) * k, own.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, out)


def _deviations(x: np.ndarray, w: Whitening) -> list[int | None] | np.ndarray:
    """Sum over dimensions of (n x - S)^2, in whole numbers."""
    away = np.abs((x - w.mean).astype(float)).max(initial=0.0) + 1
    if (w.n * away) ** 2 * max(x.shape[1], 1) < 2.0**62:
        d = w.n * (x - w.mean) - w.rest
        return (d * d).sum(axis=1)
    d = w.n * (x - w.mean).astype(object) - w.rest.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def whitened(rows: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors of ``rows`` on the first components of their covariance, each with variance one.

    A vector that is null or holds null, NaN or infinity is left out; one with a
    component that no 64-bit number holds raises an error. A shorter vector
    counts as filled up with zeros. Copies of a vector count once in the fit and
    all come out. A component of which the eigenvalue is zero to double precision
    can't have variance one and is left out, so equal vectors alone give no rows,
    as does an empty table. Vectors of any length are read whole; of long ones
    the driver holds one triangle, eight bytes per pair of dimensions. Other
    columns, whatever their names, are left out.
    """
    vectors = whole_vectors(rows, id_col, vector_col)
    return whiten(vectors, fit(vectors, components))
