import math

import numpy as np
import pytest

from inkwell.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, component string, x int"


def run(spark, rows, **options):
    return whitening.whitened(spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA).repartition(3), **options).toPandas()


def brute(rows):
    """Ids, whole vectors, distinct ones, and eigenvalues of their covariance, falling."""
    own = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max(len(v) for _, v in own)
    x = [[math.floor(64 * a) + 1_000_000 for a in [*v, *[0.0] * (dim - len(v))]] for _, v in own]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.array((n * fit - s), dtype=float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in own], np.array(x, dtype=object), n, s, values[::-1], vectors[:, ::-1]


def check(spark, rows, k=16, distinct=True):
    got = run(spark, rows, components=k)
    ids, x, n, s, values, vectors = brute(rows)
    k = min(k, int((values > values[0] * 1e-12).sum()))
    assert len(got) == len(ids) * k and set(got.n) == {n}
    assert got.identity_error.max() < 1e-9
    dev = {(i, int(v)) for i, v in zip(ids, ((n * x - s) ** 2).sum(axis=1))}
    assert set(zip(got.vec_id, got.deviation)) == dev
    for c in range(1, k + 1):
        own = got[got.component == c]
        assert own.explained.to_numpy() == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        if distinct:  # eigenvalues apart: vectors are the same but for their sign
            want = (np.array(n * x - s, dtype=float) / n) @ vectors[:, c - 1] / math.sqrt(values[c - 1])
            mine = own.sort_values("vec_id", kind="stable").whitened.to_numpy()
            want = want[np.argsort(ids, kind="stable")]
            sign = np.sign(mine @ want)
            assert np.sort(mine) == pytest.approx(np.sort(sign * want), abs=1e-7)


def vectors(seed, n, d):
    r = np.random.default_rng(seed)
    return [(i, v) for i, v in enumerate((r.standard_normal((n, d)) @ np.diag(np.linspace(0.2, 3, d)) + 5).tolist())]


def test_against_numpy(spark):
    check(spark, vectors(1, 300, 9), k=4)
    check(spark, vectors(2, 50, 3))
    check(spark, vectors(3, 8, 30))  # fewer vectors than dimensions


def test_copies_and_odd_rows(spark):
    rows = vectors(4, 60, 5)
    rows += [(100 + i, rows[0][1]) for i in range(80)] + [(3, rows[3][1])]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [math.nan] * 5), (303, [math.inf] * 5), (304, [1.0, 2.0]), (305, []), (0, rows[9][1])]
    check(spark, rows)
    assert run(spark, [(1, [1.0, 2.0])] * 5).empty  # no variance
    assert run(spark, [(1, None)]).empty and run(spark, [(1, [])]).empty
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_eigenvalues(spark):
    """Unit vectors of an orthant: all eigenvalues but one are the same."""
    rows = [(i, [float(i == j) for j in range(12)]) for i in range(12)]
    check(spark, rows, distinct=False)


def test_large_numbers(spark):
    """Sums and deviations that doubles would round."""
    rows = [(i, [2.0**30 + i * 0.5, 2.0**29 - i * i * 0.25, float(i % 7)]) for i in range(200)]
    check(spark, rows, k=2, distinct=False)
    with pytest.raises(Exception, match="beyond 64 bits"):
        run(spark, [(1, [1e300]), (2, [1.0])])


@pytest.mark.parametrize("gap", [1e-3, 1e-7, 1e-11, 1e-14, 0.0])
def test_close_values(gap):
    r = np.random.default_rng(5)
    q, _ = np.linalg.qr(r.standard_normal((40, 40)))
    p, _ = np.linalg.qr(r.standard_normal((40, 40)))
    own = np.sqrt(np.concatenate([1 + gap * np.arange(6), np.linspace(0.1, 0.6, 34)]))
    a = (q * own) @ p
    values, vec = whitening.eigenvectors(a, 16)
    assert values == pytest.approx(np.sort(own**2)[::-1], rel=1e-12)
    assert np.abs(vec.T @ vec - np.eye(16)).max() < 1e-13
    assert np.abs(a.T @ a @ vec - vec * values[:16]).max() < 1e-13


def test_dqds_is_accurate_for_tiny_values():
    a, b = np.array([1.0, 1e-3, 1e-7, 1e-12]), np.array([1e-2, 1e-6, 1e-9])
    exact = whitening.dqds(a**2, b**2)
    # The product of the values is that of the squared diagonal, whatever their sizes.
    assert np.prod(exact / np.sort(a**2)[::-1]) == pytest.approx(1, rel=1e-12)
    assert (exact > 0).all()


def test_query(spark):
    got = queries.op12_whitening(spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == 500 * 16 and got.identity_error.max() < 1e-9 and got.isna().sum().sum() == 0
