import random
import re

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import toxicity as tx
from inkwell.llm.textkit import blocks

SMALL = tx.Settings(words=1 << 10, grams=1 << 10, warm_steps=60, rounds=2, round_steps=60, batch=64)


def read(texts, s, limit=1 << 22):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    return [(data, tx.read_words(data, offsets, s)) for _, data, offsets in blocks(iter([batch]), "text", limit=limit)]


def test_words_and_grams():
    texts = ["Ab, c3 İx-ab", None, "", "!!", "日本 ab", "AB"]
    for limit in (4, 1 << 22):
        words = [[len(w.index[a:b]) for a, b in zip(w.bounds, w.bounds[1:])] for _, w in read(texts, SMALL, limit)]
        assert [x for own in words for x in own] == [4, 0, 0, 0, 2, 1]
    ((_, w),) = read(texts, SMALL)
    assert w.index[0] == w.index[3] == w.index[5] == w.index[6] and len(w.bucket) == 4
    sizes = {len(x): sum(max(0, len(x) + 2 - k + 1) for k in SMALL.sizes) for x in ("ab", "abcd")}
    assert np.diff(w.cut)[w.index[0]] == sizes[2]


def test_windows_overlap_and_cover():
    s = tx.Settings(window=40, stride=30)
    bounds = np.cumsum([0, 0, 1, 40, 41, 70, 71, 500])
    text, first, length = tx.windows(bounds, s)
    for i in range(7):
        own = [(a - bounds[i], n) for t, a, n in zip(text, first, length) if t == i]
        size = bounds[i + 1] - bounds[i]
        assert sorted({x for a, n in own for x in range(a, a + n)}) == list(range(size))
        assert all(b < a + n for (a, n), (b, _) in zip(own, own[1:]))


def test_gradients():
    net = tx.Network.new(tx.Settings(words=64, grams=64, hidden=3, width=2, attention=2))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    gates = np.concatenate([rng.standard_normal((6, 18)), np.zeros((1, 18))])
    index = rng.integers(0, 6, (4, 5))
    index[1, 3:] = index[2, 1:] = 6
    y, weight = np.array([0, 1, 1, 0.0]), np.array([1, 2, 1, 1.0])

    def loss():
        out = net.forward(gates, index)
        return (weight * (np.logaddexp(0, out) - y * out)).sum() / weight.sum()

    g, d_gates = net.gradients(gates, index, y, weight)
    for where, grad in [*((net.p[k], g[k]) for k in g), (gates, d_gates)]:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in grad.shape)
            was, step = where[at], 1e-3
            where[at] = was + step
            up = loss()
            where[at] = was - step
            down = loss()
            where[at] = was
            assert (up - down) / 2 / step == pytest.approx(grad[at], abs=1e-4)


def corpus(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(2, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        own = [rnd.choice(words) for _ in range(rnd.randrange(5, 150))]
        bad = i % 3 == 0
        for _ in range(2 * bad):
            own.insert(rnd.randrange(len(own)), "zorg" + rnd.choice(words))
        rows.append((i, " ".join(own), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "clash", "x") for i, t, _ in rows], "doc_id long, text string, label string, toxicity string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:600]] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    net = tx.fit(docs, labels, s=SMALL)
    got = {r.doc_id: r.toxicity for r in tx.score(docs, net).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, t, y in rows[600:] if re.search(r"\w", t)]
    assert np.mean(right) > 0.95
    again = {r.doc_id: r.toxicity for r in tx.score(docs, tx.fit(docs.repartition(3), labels, s=SMALL)).collect()}
    assert again == pytest.approx(got, abs=1e-4)
    # A long text is scored to its end, and empty ones have a score too.
    long = [(1, " ".join(t for _, t, y in rows if not y)), (2, " ".join(t for _, t, y in rows if not y) + " zorgabc zorgfed"), (3, None), (4, "  "), (5, "")]
    got = {r.doc_id: r.toxicity for r in tx.score(spark.createDataFrame(long, "doc_id long, text string"), net).collect()}
    assert got[2] >= 0.5 and got[2] > got[1] and got[3] == got[4] == got[5] == 0


def test_sample(spark, monkeypatch):
    """One text of each id; of a long clean text a part, a long toxic one not at all; repeated labels count once."""
    taken = {}

    def keep(texts, labels, s):
        taken.update(texts=texts, labels=labels.tolist())

    monkeypatch.setattr(tx, "train", keep)
    docs = [(1, "clean"), (1, "a clean one"), (2, "toxic"), (3, "x " * 500), (4, "y " * 500), (5, None)]
    labels = [(1, 0), (1, 0), (2, 1), (2, 1), (3, 0), (4, 1), (5, 0), (6, 1), (None, 1), (2, None), (2, 7)]
    tx.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), s=tx.Settings(max_chars=100))
    assert taken["labels"] == [0, 1, 0, 0] and taken["texts"][:2] == ["a clean one", "toxic"] and taken["texts"][3] == ""
    assert len(taken["texts"][2]) == 100 and set(taken["texts"][2]) == {"x", " "}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    for own in ([], [(1, 0)], [(1, 1)]):
        net = tx.fit(docs, spark.createDataFrame(own, "doc_id long, toxic int"), s=SMALL)
        assert [r.toxicity for r in tx.score(docs, net).collect()] == [0, 0]
    assert tx.score(docs.limit(0), net).collect() == []


def test_a_text_is_read_alone_as_among_others():
    texts = ["ΟΔΟΣ", "ΒΓ", "İx", "é ́", "हिन्दी में", "ΣΑΣ ΟΣ", "", "a", "ς σ Σ"]

    def found(own):
        ((_, w),) = read(own, SMALL)
        return [[(int(w.bucket[i]), w.grams[w.cut[i] : w.cut[i + 1]].tolist()) for i in w.index[a:b]] for a, b in zip(w.bounds, w.bounds[1:])]

    for one in texts:
        (alone,) = found([one])
        for other in texts:
            assert found([one, other])[0] == alone == found([other, one])[1]
    assert len(found(["हिन्दी में"])[0]) == 2
