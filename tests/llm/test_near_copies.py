import random
from itertools import combinations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

import numpy as np

from inkwell.llm import near_copies

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, percent=80):
    """{doc_id: component} and the similar pairs, from all pairs of rows."""
    sets = {}
    for d, text in rows:
        own = (text or "").lower().split()
        sets[d] = {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()
    pairs = {(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    label = {d: d for d in sets}
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label, pairs


def corpus(n=240, seed=2):
    """Texts with copies that differ in up to a tenth of their words, and lines that many texts hold."""
    rnd = random.Random(seed)
    lines = [" ".join(rnd.choice("abcdefgh") * 3 + str(i) for i in range(12)) for _ in range(4)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.5:
            own = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randrange(1 + len(own) // 25)):
                own[rnd.randrange(len(own))] = f"w{rnd.randrange(500)}"
        else:
            own = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([4, 25, 60, 200, 900]))]
            own += rnd.choice(lines).split() * rnd.randrange(2)
        rows.append((i * 7 % n, " ".join(own)))
    return rows


def test_no_pair_is_lost(spark, monkeypatch):
    rows = corpus() + [(1000, None), (1001, ""), (1002, " \n"), (1003, "Hi"), (1004, "hi"), (1005, "a b c d e"), (1006, "A b c d\ne")]
    want, pairs = brute(rows)
    assert len(pairs) > 60
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    for ranked in (near_copies.RANKED, 5):
        monkeypatch.setattr(near_copies, "RANKED", ranked)
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == want
    kept = near_copies.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_crowded_groups_are_sliced(spark, monkeypatch):
    """One original with hundreds of near copies of itself, and a line that most texts hold."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(400)}" for _ in range(80)]
    line = "this very line stands in most of all the texts here"
    rows = []
    for i in range(260):
        own = list(base) if i % 2 else [f"v{rnd.randrange(900)}" for _ in range(rnd.choice([12, 40]))]
        for _ in range(rnd.randrange(4)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(300)}"
        rows.append((i, " ".join(own) + "\n" + line * (i % 5 != 0)))
    want, _ = brute(rows)
    assert len(set(want.values())) < 200
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    for slice_, crowd in ((1024, 4096), (20, 16)):
        monkeypatch.setattr(near_copies, "SLICE", slice_)
        monkeypatch.setattr(near_copies, "CROWD", crowd)
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == want


def test_group_without_a_large_part(spark, monkeypatch):
    """Sets that hang together by false candidates alone, in many small families over all slices."""
    monkeypatch.setattr(near_copies, "SLICE", 16)
    rng, rows = np.random.default_rng(4), []
    for family in range(50):
        base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
        for i in range(3):
            own = base.copy()
            own[i] = rng.integers(0, 1 << 63, dtype=np.uint64)
            rows.append((7, 1000 * family + i, bytearray(np.unique(own).astype("<u8").tobytes())))
    rows.append((8, 5, rows[0][2]))  # another group: not compared with this one
    links = near_copies.grouped_links(spark.createDataFrame(rows, "root long, key long, shingles binary"), 80)
    label = {r.node: r.root for r in near_copies.component_labels(links).collect()}
    assert label == {k: k - k % 1000 for _, k, _ in rows[:-1]}


def test_first_shingles_lose_no_pair():
    """Sets of similarity 0.8 meet in a trie, whatever part of them is common."""
    rnd = np.random.default_rng(3)
    for n in (5, 40, 300, 3000):
        for common in (0.0, 0.5, 0.78, 1.0):
            for _ in range(30):
                a = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
                m = int(n * 0.2)
                b = np.concatenate([a[m:], a[:0]])  # a part of the other: the worst case
                a, b, ranked = np.unique(a), np.unique(b), np.unique(a[n - int(common * n) :])
                counts = np.full(len(ranked), 9)
                x, y = (near_copies.first_shingles(s, ranked, counts, 80)[0] for s in (a, b))
                assert len(np.intersect1d(x, y))


def test_stage_takes_similarity(spark):
    """The pipeline's stage on copies of which the fingerprints differ in more than three bits."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 200")
    want, _ = brute([(r.doc_id, r.text) for r in docs.collect()])
    kept = dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_empty_table_and_ids(spark):
    assert near_copies.keep_first(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c", ""), (4, "a b c", ""), (4, "a b c", ""), (None, "q", "")]
    assert sorted(r.doc_id or -1 for r in near_copies.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()) == [-1, -1, 4]


def test_all_shingles_are_counted(spark):
    """Counts are those of all texts, in a table of more than a sample would hold."""
    rows = [(i, f"a b c d e{' u' + str(i) if i % 3 else ''}") for i in range(24_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes, counts = near_copies.common_shingles(df, 5, 42)
    assert hashes.tolist() == near_copies._set(b"a b c d e", 5, 42).tolist() and counts.tolist() == [24_000]


def test_comparisons_in_steps(monkeypatch):
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.integers(0, 9) :], rng.integers(0, 1 << 63, 3, dtype=np.uint64)])) for _ in range(40)]
    keys, sides = np.arange(40), np.zeros(40, np.int64)
    want = near_copies.exact_links(keys, sides, keys, sets, 80)
    monkeypatch.setattr(near_copies, "COMPARED", 100)
    assert want and near_copies.exact_links(keys, sides, keys, sets, 80) == want
