"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .characters import LETTER, MARK, lower_codes
from .common import without
from .textkit import blocks, mix, sums_between

#: Largest model that is broadcast: languages times buckets, four bytes each. A task counts in twice as much at most,
#: and the driver holds five times as much while it makes the model.
MODEL_BYTES = 64 << 20


@dataclass(frozen=True)
class Model:
    """``log_probs`` has a row per bucket and a column per language; ``priors`` are their logarithms."""

    languages: list[str]
    log_probs: np.ndarray
    priors: np.ndarray
    sizes: tuple[int, ...]


#: Marks such as vowel signs belong to the words that they stand in.
_IN_WORD = LETTER | MARK


def ngrams(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of the texts of a block, those of a text together: buckets, bounds per text, letters per text.

    Each character is lower-cased by itself; a run of others than letters and their marks counts as one space.
    """
    codes, at = lower_codes(data), np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    letters, inside = sums_between(LETTER[codes], at), _IN_WORD[codes]
    # One space for each run of other characters.
    lead = np.zeros(len(codes), dtype=bool)
    lead[at[:-1][at[:-1] < len(codes)]] = True
    stay = inside.copy()
    if len(codes):
        stay[0] = True
        stay[1:] |= inside[:-1] | lead[1:]
    own = np.where(inside, codes, np.uint32(0x20))[stay].astype(np.uint64)
    at = np.append(0, np.cumsum(stay))[at]
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    grams, docs = [], []
    rolled = np.zeros(len(own), dtype=np.uint64)
    for n in range(1, max(sizes) + 1):
        if n > len(own):
            break
        rolled = rolled[: len(own) - n + 1] * np.uint64(0x100000001B3) + own[n - 1 :]
        if n in sizes:
            within = doc[: len(rolled)] == doc[n - 1 :]
            grams.append((mix(rolled[within] + np.uint64(n)) & np.uint64(buckets - 1)).astype(np.int32))
            docs.append(doc[: len(rolled)][within])
    if not grams:
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64), letters
    docs = np.concatenate(docs)
    order = np.argsort(docs, kind="stable")
    return np.concatenate(grams)[order], np.append(0, np.cumsum(np.bincount(docs, minlength=len(at) - 1))), letters


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sizes: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 15, smoothing: float = 0.5, per_language: int = 4000) -> Model | None:
    """Learn from the rows of ``labelled`` that have a language; None if there are none.

    The classifier is fitted on a sample of about ``per_language`` distinct
    texts of each language (all of them, if fewer), drawn by a hash of the text,
    so every run draws the same; the priors count all rows. Null and empty texts
    count for the priors alone, texts of any length are read whole. ``buckets``
    is a power of two. Counts are added up by Spark per language and bucket; the
    driver gets languages times buckets numbers. So many languages that the model
    would be over MODEL_BYTES share fewer buckets, 1,024 at least.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("lang is not null")
    n_languages = rows.select("lang").distinct().count()
    if not n_languages:
        return None
    while n_languages * buckets * 4 > MODEL_BYTES and buckets > 1024:
        buckets //= 2
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts")).collect()
    total, texts = {r["lang"]: r["n"] for r in found}, {r["lang"]: r["texts"] for r in found}
    languages = sorted(total)
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / max(1, texts[lang])))))
    drawn = F.pmod(F.xxhash64("text", F.lit("language")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    index = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), buckets), dtype=np.int64)
        for rows, data, offsets in blocks(batches, "text"):
            grams, at, _ = ngrams(data, offsets, sizes, buckets)
            lang = np.array([index[x] for x in rows.column(0).to_pylist()], dtype=np.int64)
            counts += np.bincount(np.repeat(lang, np.diff(at)) * buckets + grams, minlength=counts.size).reshape(counts.shape)
        lang, bucket = np.nonzero(counts)
        if len(lang):
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])], names=["lang", "bucket", "n"])

    found = rows.where(drawn).dropDuplicates(["lang", "text"]).mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((buckets, len(languages)), smoothing)
    counts[found["bucket"], found["lang"]] += found["n"]
    log_probs = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    whole = np.array([total[lang] for lang in languages], dtype=float)
    return Model(languages, log_probs, np.log(whole / whole.sum()), sizes)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of that language.

    Texts that are null or have no letter are ``und`` with score 0, as is every
    text where nothing was learned. Ties go to the first language by code point.
    Texts of any length are read whole; repeated rows all stay, with equal
    results. An empty table gives no rows. Columns of these names are replaced.
    """
    docs = without(docs, ["lang_pred", "score"], [text_col])
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        names = np.array([*m.languages, "und"], dtype=object)
        for rows, data, offsets in blocks(batches, text_col):
            grams, at, letters = ngrams(data, offsets, m.sizes, len(m.log_probs))
            sums = np.zeros((len(letters), len(m.languages)))
            filled = np.flatnonzero(np.diff(at))
            for j in range(len(m.languages) if len(filled) else 0):
                sums[filled, j] = np.add.reduceat(m.log_probs[:, j][grams], at[:-1][filled], dtype=np.float64)
            sums += m.priors
            best = sums.argmax(axis=1)
            score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            none = letters == 0
            best[none], score[none] = len(m.languages), 0.0
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names[best], type=pa.string()), pa.array(score)], names=[*rows.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{docs.schema.toDDL()}, lang_pred string, score double")
