import random

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import quality_net as qn
from inkwell.llm import queries
from inkwell.llm.textkit import blocks

SMALL = qn.Settings(steps=80, filters=8, hidden=4, chunk=96, hop=64, batch=32)


def test_chunks_overlap_and_cover():
    s = qn.Settings(chunk=40, hop=30)
    offsets = np.cumsum([0, 0, 1, 40, 41, 70, 71, 500])
    text, first, length = qn.chunks(offsets, s)
    for i, n in enumerate(np.diff(offsets)):
        own = [(a - offsets[i], k) for t, a, k in zip(text, first, length) if t == i]
        assert sorted({x for a, k in own for x in range(a, a + k)}) == list(range(n))
        assert all(b < a + k for (a, k), (b, _) in zip(own, own[1:])) and own


def test_every_byte_is_seen():
    s = qn.Settings(chunk=40, hop=30, reach=7, step=3)
    net = qn.Network.new(s)
    for n in (0, 1, 6, 7, 8, 39, 40, 41, 200):
        data = 1 + np.arange(n) % 255
        _, first, length = qn.chunks(np.array([0, n]), s)
        seen, start = net._places(data.astype(np.uint8), first, length)
        assert set(seen.ravel()) - {256} == set(data) and len(start) == len(first)


def test_gradients():
    net = qn.Network.new(qn.Settings(width=2, reach=5, step=2, filters=3, hidden=3, chunk=12, hop=8))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(1)
    data, offsets, labels = r.integers(97, 110, 80).astype(np.uint8), np.array([0, 30, 33, 80]), np.array([0, 1, 1.0])
    text, first, length = qn.chunks(offsets, net.s)
    begins = np.searchsorted(text, np.arange(3))

    def loss():
        z = net.combine(net.describe(data, first, length), begins)
        return (np.logaddexp(0, z) - labels * z).mean()

    g = net.gradients(data, first, length, begins, labels)
    for k, p in net.p.items():
        for at in r.choice(p.size, min(p.size, 12), replace=False):
            i, step = np.unravel_index(at, p.shape), 1e-5
            was = p[i]
            p[i] = was + step
            up = loss()
            p[i] = was - step
            down = loss()
            p[i] = was
            assert (up - down) / 2 / step == pytest.approx(g[k][i], abs=1e-5)


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randrange(2, 6))) for _ in range(300)]
    return [(i, " ".join(r.choice(words) + r.choice(["##", "%%", "&&"]) * (i % 3 == 0) for _ in range(r.randrange(5, 120))), int(i % 3 > 0)) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = corpus(700, 1)
    docs = spark.createDataFrame([(i, t, "clash", "x") for i, t, _ in rows], "doc_id long, text string, label string, quality_score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:500]] + [(None, 1), (5000, None), (1, 7)], "doc_id long, quality int")
    net = qn.fit(docs, labels, s=SMALL)
    got = {r.doc_id: r.quality_score for r in qn.score(docs, net).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, _, y in rows[500:]]) > 0.97
    again = {r.doc_id: r.quality_score for r in qn.score(docs, qn.fit(docs.repartition(3), labels, s=SMALL)).collect()}
    assert again == pytest.approx(got, abs=1e-4)
    long = " ".join(t for _, t, y in rows if y)
    odd = [(1, long), (2, long + rows[0][1] * 3), (3, None), (4, ""), (5, ""), (6, "é" * 3)]
    found = {r.doc_id: r.quality_score for r in qn.score(spark.createDataFrame(odd, "doc_id long, text string"), net).collect()}
    assert found[1] >= 0.7 and [found[4], found[5]] == pytest.approx([found[3]] * 2, abs=1e-5) and all(0 <= x <= 1 for x in found.values())
    assert found[2] < found[1]  # a bad end of a long text counts


def test_score_is_a_rows_own():
    net = qn.Network.new(qn.Settings())
    texts = ["", "a", "ΟΔΟΣ", None, "word " * 500, "ΒΓ", "x" * 5000]
    alone = []
    for t in texts:
        ((_, data, offsets),) = blocks(iter([pa.RecordBatch.from_arrays([pa.array([t], pa.string())], names=["text"])]), "text")
        alone += net.log_odds(data, offsets).tolist()
    ((_, data, offsets),) = blocks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]), "text")
    assert net.log_odds(data, offsets).tolist() == pytest.approx(alone, abs=1e-5)
    assert net.log_odds(data, offsets, limit=2).tolist() == pytest.approx(alone, abs=1e-5)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    for own in ([], [(1, 0)], [(1, 1)]):
        net = qn.fit(docs, spark.createDataFrame(own, "doc_id long, quality int"), s=SMALL)
        assert [r.quality_score for r in qn.score(docs, net).collect()] == pytest.approx([0.7, 0.7])
    assert qn.score(docs.limit(0), net).collect() == []


def test_long_texts_are_read_in_part(spark, monkeypatch):
    taken = {}
    monkeypatch.setattr(qn, "train", lambda texts, labels, s: taken.update(texts=texts, labels=labels.tolist()))
    docs = [(1, "short"), (1, "a short one"), (2, "x " * 500), (3, None)]
    qn.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int"), s=qn.Settings(max_chars=100))
    assert taken["labels"] == [0, 1, 1] and taken["texts"][0] == "a short one" and len(taken["texts"][1]) == 100 and taken["texts"][2] == ""


def test_query(spark):
    got = queries.op13_quality_net(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.quality == got.predicted).mean() > 0.85 and got.score.between(0, 1).all()
