import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_oracle import same

from inkwell.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, size int, target string, c0 int"


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - most * sizes[s]) for s in free)
        for s in names:
            target[s] = min(target[s], most * sizes[s])
        free = {s for s in free if target[s] < most * sizes[s]}
    return target


def rows_of(n=400, seed=3):
    rnd = random.Random(seed)
    sources = ["b", "a", "Z", "é", None, "", "a10", "a9"]
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 30])) + "\tx\n", rnd.choice(sources[:2] if i % 3 else sources)) for i in range(n)]
    return rows + [(7, None, "a"), (7, "", "tiny"), (9000, "one", "small"), (None, "no id", "a"), (None, "no id", "a"), (5, "same row", "b"), (5, "same row", "b"), (6, "long " * 20_000, "b")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA)


def test_budgets(spark):
    rows = rows_of()
    got = mixing.mix(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, len((t or "").split())) for d, t, _ in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    target = fill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert taken[s] == round(target[s])
    by = defaultdict(list)
    for r in got:
        if r.size:
            by[r.source].append(r.taken / r.size)
    for shares in by.values():  # whole epochs for all, one more for some, a part for the one at the cut
        low = int(min(shares))
        assert sum(x not in (low, low + 1) for x in shares) <= 1
    again = mixing.mix(frame(spark, rows).repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_rows(spark):
    rows = rows_of()
    df = frame(spark, rows)
    got = mixing.mixed(df)
    assert got.columns == df.columns
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[(r.doc_id, r.size)] += r.taken
    copies = Counter((r.doc_id, len((r.text or "").split())) for r in got.collect())
    off = [k for k in taken if abs(copies[k] * k[1] - taken[k]) > 0 and k[1]]
    assert len(off) <= 9 and all(abs(copies[k] * k[1] - taken[k]) <= k[1] / 2 for k in off)  # at most one of each source
    assert copies[(7, 0)] == 2


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == []


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    test_budgets(spark)


def test_sql(spark, tmp_path):
    frame(spark, [r for r in rows_of() if r[0] is not None]).write.parquet(f"{tmp_path}/documents.parquet")
    for sf in (str(tmp_path), "/root/testdata/sf0.01"):
        same(queries.op1_mixing(spark, sf), queries.ORACLE_SQL["op1_mixing"], sf)


def test_equal_rows_at_a_cut(spark):
    rows = [(1, "w " * 7, "a")] * 40 + [(i, "w " * 5, "b") for i in range(100)]
    got = Counter(r.source for r in mixing.mixed(frame(spark, rows)).collect())
    target = fill({"a": 280, "b": 500})
    assert abs(got["a"] * 7 - target["a"]) <= 3.5 and abs(got["b"] * 5 - target["b"]) <= 2.5


def test_many_sources_with_different_limits(spark):
    """Sources of all sizes, most of which are full at another share."""
    rows = [(1000 * i + j, "w " * (1 + i % 5), f"s{i:03}") for i in range(120) for j in range(1 + i * i % 37)]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target, taken = fill(sizes), Counter()
    for r in mixing.mix(frame(spark, rows)).collect():
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert taken == {s: round(t) for s, t in target.items()}
