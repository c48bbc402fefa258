import random

import numpy as np
import xxhash

from inkwell.llm import simhash
from inkwell.llm.components import component_labels

SCHEMA = "doc_id long, text string, fp string, least long, _gone long"


def brute(rows):
    """{doc_id: (fingerprint, component)} from all pairs of rows."""
    fps = []
    for _, text in rows:
        own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        shingles = [b" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, fps[i], least[find(i)]) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in df.collect())


def corpus(n=150, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.5:
            t = rnd.choice(rows)[1].split(" ")
            if rnd.random() < 0.7:
                t[rnd.randrange(len(t))] = rnd.choice(words)
            text = " ".join(t)
        else:
            text = " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 60, 200, 900])))
        rows.append((i * 7 % n, text))
    return rows


def test_against_brute_force(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, " \n"), (1003, "Hi"), (1004, "hi"), (1005, "a b"), (1005, "a b"), (1006, "É b c d")]
    df = spark.createDataFrame([(*r, "x", 1, 5) for r in rows], SCHEMA)
    assert result(simhash.near_duplicates(df)) == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b c", "", 1, 5), (4, "a b c", "", 1, 5), (None, "q", "", 1, 5)], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 4), (4, 4)]


def test_long_text(spark):
    text = " ".join(f"{i % 977}q{i}" for i in range(60_000))
    rows = [(1, text), (2, text + " end"), (3, "other")]
    assert result(simhash.near_duplicates(spark.createDataFrame([(*r, "", 1, 5) for r in rows], SCHEMA))) == brute(rows)


def test_crowded_block_is_sliced(spark):
    """Fingerprints that share blocks are dealt out in slices and lose no link."""
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(8))) for _ in range(400)}
    fps = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.node: r.root for r in component_labels(simhash.near_links(df, most=16)).collect()}
    u = np.array(fps).view(np.uint64)
    label = np.arange(len(u))
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], len(u)).min(axis=1)
        if (new == label).all():
            break
        label = new
    for i, f in enumerate(fps):
        assert found.get(f, f) == fps[label[i]]


def test_one_stays_of_each_component(spark):
    df = spark.createDataFrame([(2, "a b c", "", 1, 5), (1, "a b c", "", 1, 5), (5, "q r s t", "", 1, 5), (None, "a b c", "", 1, 5), (1, "a b c", "", 1, 5)], SCHEMA)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 5]
