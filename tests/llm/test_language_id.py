import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa

from inkwell.llm import language_id as li
from inkwell.llm import queries
from inkwell.llm.textkit import blocks

SCHEMA = "doc_id long, text string, lang string, score int"
SMALL = "/root/testdata/sf0.01"


def grams(text, sizes):
    text = "".join("i" if c == "İ" else "σ" if c == "ς" else c.lower() for c in text or "")
    own = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text)
    while "  " in own:
        own = own.replace("  ", " ")
    return Counter(own[i : i + n] for n in sizes for i in range(len(own) - n + 1))


TEXTS = [None, "", "1 2", "Ab", "aB,  c", "\nx\n", "Éa É", "Straße", "İx", "日本 語", "हिन्दी में", "ภาษาไทย ที่", "\u0301", "e\u0301 \u0301", "a" * 50_000]


def test_grams_per_text():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])
    for limit in (8, 1 << 22):
        out = []
        for _, data, offsets in blocks([batch], "text", limit=limit):
            got, at, letters = li.ngrams(data, offsets, (1, 2, 3), 1 << 30)
            out += [(Counter(Counter(got[a:b].tolist()).values()), n) for a, b, n in zip(at[:-1], at[1:], letters.tolist())]
        assert [n for _, n in out] == [sum(c.isalpha() for c in (t or "").replace("İ", "i").lower()) for t in TEXTS]
        assert [c for c, _ in out] == [Counter(grams(t, (1, 2, 3)).values()) for t in TEXTS]


def test_posteriors_against_brute_force(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([("the cat sat", "en"), ("der hund und", "de"), ("le chat est", "fr"), ("the end of it", "en"), ("zzz", None), (None, "en")])]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes, buckets = (1, 2), 1 << 30
    model = li.fit(df, sizes=sizes, buckets=1 << 14, smoothing=0.5)
    assert model.languages == ["de", "en", "fr"]
    counts = {lang: Counter() for lang in model.languages}
    for _, t, lang, _ in rows:
        if lang:
            counts[lang] += grams(t, sizes)
    probe = ["the dog", "und der", "le", "q", "1 2", None, ""]
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(spark.createDataFrame([(i, t) for i, t in enumerate(probe)], "doc_id long, text string"), model).collect()}
    prior = {"de": 1 / 5, "en": 3 / 5, "fr": 1 / 5}
    for i, t in enumerate(probe):
        g = grams(t, sizes)
        if not any(c.isalpha() for c in t or ""):
            assert got[i] == ("und", 0.0)
            continue
        logs = {lang: math.log(prior[lang]) + sum(k * math.log((counts[lang][x] + 0.5) / (sum(counts[lang].values()) + 0.5 * (1 << 14))) for x, k in g.items()) for lang in prior}
        best = max(sorted(logs), key=logs.get)
        assert got[i][0] == best
        assert abs(got[i][1] - math.exp(logs[best]) / sum(map(math.exp, logs.values()))) < 1e-3


def test_copies_are_drawn_once(spark):
    """One text of which most rows are copies counts for the prior, not for the sample."""
    rows = [(i, "the cat sat on the mat", "en", 1) for i in range(400)] + [(1000 + i, f"une phrase {i} en français", "fr", 1) for i in range(100)]
    rows += [(2000 + i, f"some other sentence {i} of english words", "en", 1) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = li.fit(df, per_language=50)
    assert np.exp(model.priors).round(3).tolist() == [0.833, 0.167]
    got = li.predict(spark.createDataFrame([(1, "english words of a sentence"), (2, "phrase en français")], "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "en", 2: "fr"}


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "some text", None, 1)], SCHEMA)
    assert li.fit(df) is None
    rows = li.predict(df, None).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
    assert li.predict(spark.createDataFrame([], "doc_id long, text string"), None).collect() == []


def test_held_out_accuracy(spark):
    got = queries.op6_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 150 and (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


NEIGHBOURS = ["ΟΔΟΣ", "ΒΓ", "İx", "é ́", "हिन्दी में", "ΣΑΣ ΟΣ", "", "a", "ς σ Σ"]


def test_a_text_is_read_alone_as_among_others():
    """Lower case doesn't depend on what stands behind, nor at the end of a block."""

    def found(texts):
        ((_, data, offsets),) = blocks([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])], "text")
        got, at, letters = li.ngrams(data, offsets, (1, 2, 3), 1 << 30)
        return [(sorted(got[a:b].tolist()), n) for a, b, n in zip(at[:-1], at[1:], letters.tolist())]

    for one in NEIGHBOURS:
        (alone,) = found([one])
        for other in NEIGHBOURS:
            assert found([one, other])[0] == alone == found([other, one])[1]


def test_bytes_that_are_no_text(spark):
    docs = spark.createDataFrame([(1, bytearray(b"the cat \xff\xfe sat")), (2, bytearray(b"\xc3"))], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) as text")
    model = li.fit(spark.createDataFrame([(1, "the cat sat", "en", 1), (2, "der hund", "de", 1)], SCHEMA))
    assert {r.doc_id: r.lang_pred for r in li.predict(docs, model).collect()} == {1: "en", 2: "und"}


def test_many_languages_share_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(li, "MODEL_BYTES", 2 * 4 * 2048)
    model = li.fit(spark.createDataFrame([(1, "the cat sat", "en", 1), (2, "der hund und", "de", 1)], SCHEMA))
    assert model.log_probs.shape == (2048, 2)
    got = li.predict(spark.createDataFrame([(1, "cat sat")], "doc_id long, text string"), model)
    assert got.first().lang_pred == "en"
