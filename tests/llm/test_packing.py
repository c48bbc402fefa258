import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import packing
from inkwell.llm.textkit import blocks
from inkwell.llm.tokens import byte_level, vocabulary

SCHEMA = "doc_id long, text string, piece string, start int"
ODD = [None, "", " ", "\n", "a", "a b", " a", "a ", "a  b", "a\nb", "a\n\nb", "a\n b", "it's 's don't", "x y  z", "　a b", "a\tb", "é1²½ ⅷ", "<|endoftext|> a<|endoftext|>", "日本 語。", "a\r\nb", "\x1c a", "don',it's", "é,ê×.÷!", "a”,b"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def texts(n=300, seed=5):
    rnd = random.Random(seed)
    bits = [" ", "\n", "a", "b'", "1", "\t", " ", "é", "'s", "!!", "word", ",", "🙂", "ß", "“", "x"]
    return ODD + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("ranks", [None, "byte_bpe_50k.tiktoken"])
def test_ids_equal_the_tokenizers(tokenizer, ranks):
    own = texts()
    model = byte_level(vocabulary("byte_bpe_50k.json"), ranks and vocabulary(ranks))
    batch = pa.RecordBatch.from_arrays([pa.array(own)], names=["text"])
    for _ in range(2):  # the second time from the table
        got = [x.tolist() for _, data, offsets in blocks([batch], "text", limit=200) for x in model.encode(data, offsets)]
        assert got == [tokenizer(t) for t in own]


@pytest.mark.parametrize("n", [1024, 8192])
def test_words_of_one_hash_are_told_apart(tokenizer, n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    own = [a, b, f"{a} {b} {a}", f"{b}\n{a}", f"x {b}"]
    model = byte_level(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    for limit in (1 << 20, 1):
        got = [x.tolist() for _, data, offsets in blocks([pa.RecordBatch.from_arrays([pa.array(own)], names=["text"])], "text", limit=limit) for x in model.encode(data, offsets)]
        assert got == [tokenizer(t) for t in own]


def test_documents_come_back_whole(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(texts(60))] + [(900, "word " * 5000), (901, "x" * 4000), (3, "again"), (None, "no id")]
    rows += [(902, " ".join(["the"] * 1023)), (903, " ".join(["the"] * 1024))]
    found = packing.pack(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), group_pieces=50).toPandas()
    assert (found.groupby("sequence_id").length.sum() <= 1024).all()
    for _, own in found.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
    want = []
    for d, t in rows:
        ids = tokenizer(t) + [2]
        cut = [0] + list(range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024))
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            want.append((-1 if d is None else d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = found.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype("int64")
    assert sorted(map(tuple, got.values.tolist())) == sorted(want)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def brute(lengths, capacity):
    """Bins by trying every open bin and computing the whole sum."""
    gaps = []
    for size in lengths:
        best = None
        for g in sorted(set(gaps)):
            if g >= size:
                after = list(gaps)
                after.remove(g)
                after.append(g - size)
                total = sum(after.count(x) ** 2 for x in set(after) if x)
                if best is None or total < best[0]:
                    best = (total, after)
        gaps = best[1] if best else [*gaps, capacity - size]
    return sorted(gaps)


def test_placement_against_brute_force():
    rnd = np.random.default_rng(2)
    for capacity in (1, 7, 20):
        lengths = rnd.integers(1, capacity + 1, 60)
        bins, offsets = packing.sum_of_squares(lengths, capacity)
        fill = np.bincount(bins, weights=lengths)
        assert sorted((capacity - fill).tolist()) == brute(lengths.tolist(), capacity)
        assert ((offsets + lengths) <= capacity).all()


def test_few_sequences():
    lengths = np.sort(np.random.default_rng(0).integers(1, 1025, 8000))[::-1]
    bins, _ = packing.sum_of_squares(lengths, 1024)
    assert bins.max() + 1 <= 1.01 * lengths.sum() / 1024


def test_queries_take_the_tokenizers_call(spark, tmp_path):
    """Texts with an added token have the ids of the tokenizer with nothing but add_special_tokens=False."""
    import sys
    from pathlib import Path

    from tokenizers import Tokenizer

    from inkwell.llm import queries

    sys.path.insert(0, str(Path(__file__).parents[2]))
    from inkwell.llm import stages

    own = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in enumerate([*texts(60), "a <|endoftext|> b", "a <|endof", "text|> b", "x<|endoftext|>", "<|endoftext|><|endoftext|>y  z"])]
    assert own.encode("a <|endoftext|> b", add_special_tokens=False).ids.count(50256) == 1
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((d, zlib.crc32(np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t in rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for found in (queries.op2_best_fit_packing(spark, str(tmp_path)), stages.pack_sequences(spark, docs, "")):
        assert sorted((r.doc_id, r.ids_crc32) for r in found.collect()) == want


def test_a_workers_words_are_bounded_and_held_once():
    """Over two million distinct words: the table's whole size is bounded, and queries of one vocabulary share it."""
    names = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    model = byte_level(*names, True)
    assert model.table is byte_level(*names, False).table
    most = 0
    for i in range(0, 2_000_000, 20_000):
        text = " ".join(f"{k:x}" for k in range(i, i + 20_000)).encode()
        model.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        most = max(most, model.table.nbytes)
    assert 10 << 20 < most < 28 << 20
