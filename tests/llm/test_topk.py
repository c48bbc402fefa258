import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from llm_oracle import same

from inkwell.llm import queries, topk

SCHEMA = "vec_id long, embedding array<double>, rank int, score string"


def brute(rows, k, every):
    own = [(i, v, r) for r, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, r in own:
        if i % every == 0:
            found = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), j) for j, w, s in own if s != r)[:k]
            out += [(i, n + 1, j, -score) for n, (score, j) in enumerate(found)]
    return sorted(out)


def check(spark, rows, k=5, every=3, **options):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, k=k, **options).collect())
    assert got == brute(rows, k, every)


def vectors(n, d, spread, seed):
    return np.random.default_rng(seed).integers(-spread, spread + 1, (n, d)).astype(float).tolist()


def test_against_brute_force(spark):
    rows = list(enumerate(vectors(300, 9, 8, 1)))
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # copies: ties
    rows += [(3000, None), (3003, [1.0, None]), (3006, [float("nan")] * 9), (3009, [float("inf")] * 9), (None, rows[1][1]), (3012, []), (3015, [7.0]), (3, rows[7][1]), (3, rows[7][1])]
    check(spark, rows, query_block=40, candidate_block=64)
    check(spark, rows, k=1, depths=(0.1, 0.3, 0.6), query_block=500, candidate_block=500)


def test_few_rows_and_large_numbers(spark):
    check(spark, list(enumerate(vectors(4, 3, 2, 2))))
    check(spark, [(0, [1.0])])
    check(spark, [])
    check(spark, list(enumerate(vectors(60, 5, 40_000_000, 3))))


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 37)
    test_against_brute_force(spark)
    test_few_rows_and_large_numbers(spark)


def test_beyond_double_precision(spark):
    """Scores over 2 ** 53 are exact, ones over 2 ** 63 are refused."""
    rows = [(0, [2.0**26 + 1] * 64), (1, [2.0**27 + 2] * 64), (2, [2.0**27 + 1] * 64), (3, [2.0**27 + 2] * 63 + [2.0**27 + 1]), (6, [-(2.0**27)] * 64), (4, [1.0] * 64)]
    check(spark, rows, k=4)
    check(spark, rows, k=2, candidate_block=2)
    df = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(df, F.col("vec_id") == 0).collect()
    with pytest.raises(Exception, match="beyond 64 bits"):
        df.select(topk.whole_numbers(F.array(F.lit(1e300)))).collect()


def test_many_components(spark):
    """Sums that single precision would round."""
    check(spark, list(enumerate(vectors(80, 1024, 300, 6))), k=7)
    check(spark, list(enumerate(vectors(40, 2048, 3_000_000, 7))), k=7, candidate_block=16)


def test_gains_are_what_scores_are_made_of():
    values, q = np.array(vectors(50, 6, 9, 4)), np.array(vectors(10, 6, 9, 5))
    lists = topk.Lists(values)
    weights = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
    assert (lists.gain.T[:6] >= 0).all() and (lists.gain.T[6:] <= 0).all()
    assert (weights @ lists.gain.T + (weights @ lists.worst)[:, None] == q @ values.T).all()
    for j in range(12):  # what a list holds, in the order of reading: never better than before
        order = np.argsort(lists.place[:, j])
        assert (lists.gain[order, j] == lists.read_values[:, j]).all()
        assert (np.diff(np.abs(lists.read_values[:, j])) <= 0).all()


def test_structured_vectors_stop_early():
    """A few strong components: the best candidates stand at the beginning of their lists."""
    r = np.random.default_rng(8)
    values = np.round(r.pareto(1.2, (2000, 12)) * np.array([400, 200, 50, *[1] * 9]))
    queries = np.abs(np.round(r.standard_normal((40, 12)) * 10 + 20))
    opened, ids = [], np.arange(2000)
    q, c, score = topk.search_block(queries, np.full(40, -1), topk.Lists(values), ids, ids, 10, opened=opened)
    want = np.sort(queries @ values.T, axis=1)[:, :-11:-1]
    assert (score.reshape(40, 10) == want).all()
    assert max(depth for depth, _, _ in opened) < 0.5


def test_least_scores_of_other_blocks():
    values, q, ids = np.array(vectors(60, 5, 9, 1)), np.array(vectors(7, 5, 9, 2)), np.arange(60)
    scores = q @ values.T
    least = np.sort(scores, axis=1)[:, -3].astype(np.int64)
    i, j, got = topk.search_block(q, np.full(7, -1), topk.Lists(values), ids, ids, 10, least)
    assert all(set(got[i == x]) >= set(np.sort(scores[x])[-3:]) for x in range(7))


def test_sql(spark):
    same(queries.op9_top_k(spark, "/root/testdata/sf0.01"), queries.ORACLE_SQL["op9_top_k"], "/root/testdata/sf0.01")
