"""The stages of the pipeline, one after another, against plain Python."""

import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))
import test_fertility
import test_line_dedup
import test_near_copies

import corpus_pipeline
from inkwell.llm import fertility, mixing
from inkwell.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    results = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        results.append([docs.collect(), (docs := spark.read.parquet(f"{tmp_path}/{i}")).collect()])
        assert docs.columns == columns or i == 4

    before, after = results[0]
    kept = {r.doc_id for r in after}
    for r in before:
        n, _, _, _, repeated = test_fertility.brute(r.text)
        failed = n < 20 or 100 * repeated > 30 * n
        assert not (failed and r.doc_id in kept)
    found = fertility.measure(spark.createDataFrame(before))
    ok = fertility.kept(lang_col="lang", norms=fertility.INVENTED_PROSE).alias("ok")
    verdict = {r.doc_id: r.ok for r in found.select("doc_id", ok).collect()}
    assert kept == {d for d, ok in verdict.items() if ok} and {tuple(r) for r in after} <= {tuple(r) for r in before}

    before, after = results[1]
    want = test_line_dedup.brute([(r.doc_id, r.text, r.source) for r in before], 0.02, 5)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in after) == sorted((d, t, len(t)) for d, t, _, _ in want)

    before, after = results[2]
    component, _ = test_near_copies.brute([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(component.values()))

    before, after = results[3]
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    taken = Counter()
    for r in after:
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    targets = {r.source: r.target for r in mixing.mix(spark.createDataFrame(before)).select("source", "target").distinct().collect()}
    longest = max(len(r.text.split()) for r in before)
    assert all(abs(taken[s] - targets[s]) <= longest for s in sizes)
    assert all(n <= 3 for n in Counter(r.doc_id for r in after).values())

    before, after = results[4]
    want = Counter()
    for r in before:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        cut = [0] + list(range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024))
        want.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want
    used = len({r.sequence_id for r in after})
    assert used <= 1.05 * sum(r.length for r in after) / 1024 + 1


ODD = "doc_id long, text string, lang string, source string, n_chars long, quality string, c0 int, size int, `key` int, doc int"


def odd_rows(rnd):
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(60)), "en", f"s{i % 3}") for i in range(12)]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None), (None, None, None, None), (3, None, "en", "s0"), (20, "", "de", "s1"), (21, " \n\n ", "de", "s1"), (22, "few words", "xx", "tiny")]
    rows += [(30, "\n".join(" ".join(rnd.choice(WORDS) for _ in range(12)) for _ in range(3000)), "en", "s2")]
    return [(*r, len(r[1] or ""), "clash", 1, 2, 3, 4) for r in rows]


WORDS = "the committee met on tuesday to discuss a proposal and after long debate its members agreed that further study was needed before anyone could decide what should be done".split()


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the stages use themselves."""
    import random

    rows = odd_rows(random.Random(1))
    docs = spark.createDataFrame(rows, ODD)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        got = found.collect()
        if name == "packing":
            assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and sum(r.piece == 0 for r in got) == len(rows)
            continue
        assert found.columns == docs.columns
        assert all(tuple(r)[4:] == tuple(r)[4:5] + ("clash", 1, 2, 3, 4) for r in got)
        ids = Counter(r.doc_id for r in got)
        if name == "quality rules":
            assert not {20, 21, 22} & set(ids) and ids[0] == 3 and ids[3] == 1 and ids[30] == 1
        if name == "line dedup":
            assert len(got) == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
        if name == "near dedup":
            assert ids[0] == 1 and ids[None] == 2 and len({3, 20, 21} & set(ids)) == 1
        if name == "mixing":
            assert all(r.text for r in got if r.doc_id == 30)
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count()


def test_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
