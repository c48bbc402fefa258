"""Quality rules on words and lines, and on how public vocabularies cut the text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, materialise, without
from .textkit import NOT_SPACE, blocks, byte_table, distinct_spans, runs, sums_between
from .tokens import PieceCounts, byte_level, piece_counts, vocabulary


@dataclass(frozen=True)
class Band:
    """What a text must keep to; ``byte_share`` is of the tokens that the piece vocabulary cuts its words into."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float  # least token entropy, as a part of the most that so many tokens of this vocabulary can have


#: Bands by script. Scripts of which the byte-level vocabulary has few merges have lower bounds on characters per token.
BANDS = {
    "latin": Band((1.5, 7.0), 0.1, 0.35),
    "greek": Band((0.6, 6.0), 0.3, 0.25),
    "cyrillic": Band((0.6, 6.0), 0.3, 0.25),
    "hebrew": Band((0.4, 5.0), 0.5, 0.25),
    "arabic": Band((0.4, 5.0), 0.5, 0.25),
    "indic": Band((0.25, 4.0), 0.9, 0.2),
    "kana": Band((0.3, 4.0), 0.6, 0.25),
    "han": Band((0.3, 4.0), 0.8, 0.25),
    "hangul": Band((0.25, 4.0), 0.9, 0.2),
    # Scripts of few merges, and texts without letters: digits and punctuation have more characters per token.
    # The piece vocabulary lacks some of these scripts whole, so a byte share of 1 is no fault there.
    "other": Band((0.2, 1.2), 1.0, 0.2),
}
#: Bands by language, ahead of those by script; a text of script "other" has to keep to that one as well. The first
#: four start between random letters (1.77 to 1.83 characters per token) and the least of the language's texts in sf0.1
#: (2.22, 2.09, 1.94, 1.89); Vietnamese and Yoruba prose has about one character per token.
LANGUAGE_BANDS: dict[str, Band] = {
    "en": Band((2.0, 7.0), 0.1, 0.35),
    "de": Band((1.95, 7.0), 0.1, 0.35),
    "fr": Band((1.87, 7.0), 0.1, 0.35),
    "es": Band((1.85, 7.0), 0.1, 0.35),
    "vi": Band((0.7, 4.0), 0.2, 0.3),
    "yo": Band((0.7, 4.0), 0.2, 0.3),
}

#: A fence stands SPREAD quartile distances off a norm's quartiles, more for texts of under SHORT words.
SPREAD, SHORT = 3.0, 200
#: A norm speaks for texts whose characters per token are within this part of its middle; others are of another kind.
KIND = 0.4


@dataclass(frozen=True)
class Norm:
    """What texts of one language and script look like; quartiles of a measure."""

    chars_per_token: tuple[float, float]
    bits: tuple[float, float, float]  # token entropy in bits, as a polynomial of the binary logarithm of the tokens (highest power first)
    off: tuple[float, float]  # of the entropy's distances from that


#: Norms of the invented prose of the tables that this repository is tested on, fitted on the whole
#: sf0.1, for callers that want a fixed set; the queries fit norms to all rows of the table that they read.
INVENTED_PROSE = {
    ("de", "latin"): Norm((2.3526, 2.4113), (-0.0340, 0.8240, 1.7825), (-0.0569, 0.0366)),
    ("en", "latin"): Norm((2.6239, 2.6872), (-0.0403, 0.9869, 0.9898), (-0.0611, 0.0415)),
    ("es", "latin"): Norm((2.0591, 2.1126), (-0.0342, 0.8373, 1.5455), (-0.0762, 0.0617)),
    ("fr", "latin"): Norm((2.1698, 2.2250), (-0.0317, 0.7673, 1.9879), (-0.0589, 0.0434)),
}

_SCRIPTS = list(BANDS)
_SCRIPT_OF = np.full(256, -1, dtype=np.int64)
for _name, _bytes in {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "greek": [0xCE, 0xCF],
    "cyrillic": [*range(0xD0, 0xD5)],
    "hebrew": [0xD6, 0xD7],
    "arabic": [*range(0xD8, 0xDC)],
    "indic": [0xE0],
    "kana": [0xE3],
    "han": [*range(0xE4, 0xEA)],
    "hangul": [*range(0xEA, 0xEE)],
    "other": [0xE1, 0xF0, 0xF1, 0xF2, 0xF3, 0xF4],
}.items():
    _SCRIPT_OF[_bytes] = _SCRIPTS.index(_name)  # by a character's first byte

_SYMBOL = byte_table([ord(c) for c in "#*$%&|<>"])
_WINDOW = 8


def _codes(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 for the distinct values, and how many there are."""
    codes, own = pd.factorize(values)
    return codes, len(own)


def _byte_shares(data, offsets, starts, ends, point, first, words, doc, pieces: PieceCounts) -> np.ndarray:
    """Share of byte tokens of each text: 0 without an unknown character, else from the tokens of its words."""
    raw = data.tobytes()
    codes = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)
    unknown = sums_between(~pieces.known[codes] & (codes > 0x20), np.append(0, np.cumsum(point))[offsets])
    out = np.zeros(len(offsets) - 1)
    some = np.flatnonzero(unknown[doc] > 0)
    if len(some):
        own, back = np.unique(words[some], return_inverse=True)
        tokens, fallen = pieces.counts([raw[a:b] for a, b in zip(starts[first[own]].tolist(), ends[first[own]].tolist())])
        np.add.at(out, doc[some], fallen[back])
        out /= np.maximum(np.bincount(doc[some], tokens[back], len(out)), 1)
    return out


def _per_text(data: np.ndarray, offsets: np.ndarray, pieces: PieceCounts) -> dict[str, np.ndarray]:
    """The counts on words, lines and pieces of every text of a block."""
    n = len(offsets) - 1
    inside, point = NOT_SPACE[data], (data & 0xC0) != 0x80
    starts, ends = runs(inside, offsets)
    cut = np.append(np.searchsorted(starts, offsets[:-1]), len(starts))
    out = {
        "n_words": np.diff(cut),
        "word_chars": sums_between(inside & point, offsets),
        "n_symbols": sums_between(_SYMBOL[data], offsets),
    }
    feeds = np.flatnonzero(data == 0x0A)
    line_starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    line_ends = np.sort(np.concatenate([feeds, offsets[1:]]))
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    doc = np.searchsorted(offsets, line_starts, side="right") - 1
    _, line, _ = distinct_spans(data, line_starts, line_ends)
    again = pd.Series(line.astype(np.int64) * n + doc).duplicated().to_numpy()
    out["n_dup_lines"] = np.bincount(doc[again], minlength=n)

    first, words, _ = distinct_spans(data, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(cut))
    out["byte_share"] = _byte_shares(data, offsets, starts, ends, point, first, words, doc, pieces)
    repeated = np.zeros(len(words) + 1, dtype=np.int64)
    if len(words) >= _WINDOW:
        # Numbers of windows of 2, 4 and 8 words from those of their halves.
        window, k, size = words.astype(np.int64), len(first), 1
        while size < _WINDOW:
            window, k = _codes(window[:-size] * k + window[size:])
            size *= 2
        within = np.flatnonzero(doc[: len(window)] == doc[_WINDOW - 1 :])
        twice = within[pd.Series(window[within] * n + doc[within]).duplicated(keep=False).to_numpy()]
        repeated[twice] += 1
        repeated[twice + _WINDOW] -= 1
    out["n_repeat_words"] = sums_between(np.cumsum(repeated[:-1]) > 0, cut)
    return out


def _entropies(ids: list[np.ndarray]) -> np.ndarray:
    """Shannon entropy in bits of each text's ids."""
    size = np.array([len(x) for x in ids], dtype=np.int64)
    out = np.zeros(len(ids))
    if not size.sum():
        return out
    keys = np.sort((np.repeat(np.arange(len(ids)), size) << 32) | np.concatenate(ids))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(first, len(keys)))
    np.add.at(out, keys[first] >> 32, count * np.log2(count))
    some = size > 0
    out[some] = np.log2(size[some]) - out[some] / size[some]
    return np.maximum(out, 0)


_FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_tokens": "long", "chars_per_token": "double", "byte_share": "double", "entropy": "double", "script": "string",
}


def measure(docs: DataFrame, text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", piece_model: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs`` with one further column ``quality``: a struct of the measures of each whole text.

    A null text counts as empty. A text without tokens has 0 for the three
    vocabulary measures. ``byte_share`` is the share of byte tokens among those
    of its words, each word encoded by itself. ``entropy`` is the entropy of the token ids as a part
    of the most that so many tokens of the vocabulary can have (1 for a single
    token). ``script``
    is that of most letters, by a character's first byte; a tie goes to the
    first in BANDS, a text without letters is "other". Texts of any length are
    read whole, repeated rows are measured alike, an empty table gives no rows. A
    column of this name is replaced.
    """
    docs = without(docs, ["quality"], [text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pieces = byte_level(vocabulary(tokenizer), ranks and vocabulary(ranks)), piece_counts(vocabulary(piece_model))
        for rows, data, offsets in blocks(batches, text_col, limit=1 << 18):
            got = _per_text(data, offsets, pieces)
            ids = model.encode(data, offsets)
            tokens = np.array([len(x) for x in ids], dtype=np.int64)
            point = (data & 0xC0) != 0x80
            chars = sums_between(point, offsets)
            most = np.log2(np.clip(tokens, 2, model.vocabulary_size))
            letters = _SCRIPT_OF[data]
            where = np.flatnonzero(letters >= 0)
            doc = np.searchsorted(offsets, where, side="right") - 1
            counts = np.bincount(doc * len(_SCRIPTS) + letters[where], minlength=len(tokens) * len(_SCRIPTS)).reshape(-1, len(_SCRIPTS))
            script = np.where(counts.any(axis=1), counts.argmax(axis=1), _SCRIPTS.index("other"))
            got |= {
                "n_tokens": tokens,
                "chars_per_token": chars / np.maximum(tokens, 1),
                "entropy": np.where(tokens == 1, 1.0, _entropies(ids) / most),
                "script": np.array(_SCRIPTS, dtype=object)[script],
            }
            arrays = [pa.array(got[k], type={"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[t]) for k, t in _FIELDS.items()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.StructArray.from_arrays(arrays, names=list(_FIELDS))], names=[*rows.schema.names, "quality"])

    schema = f"{docs.schema.toDDL()}, quality struct<{', '.join(f'{k}: {t}' for k, t in _FIELDS.items())}>"
    return docs.mapInArrow(lean(run), schema)


def base_failed(q: str = "quality", min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    """Too few words, or too many of them in repeated windows of eight."""
    return (F.col(f"{q}.n_words") < min_words) | (100 * F.col(f"{q}.n_repeat_words") > max_repeat_percent * F.col(f"{q}.n_words"))


def _outside(band: Band, q: str) -> Column:
    low, high = band.chars_per_token
    return ~F.col(f"{q}.chars_per_token").between(low, high) | (F.col(f"{q}.byte_share") > band.byte_share) | (F.col(f"{q}.entropy") < band.entropy)


def rejected(q: str = "quality", lang_col: str | None = None, bands: dict[str, Band] = BANDS, language_bands: dict[str, Band] = LANGUAGE_BANDS) -> Column:
    """Whether a vocabulary measure is outside its band: the language's, where it has one, else the script's."""
    verdict = F.lit(False)
    for name, band in bands.items():
        verdict = F.when(F.col(f"{q}.script") == name, _outside(band, q)).otherwise(verdict)
    other = (F.col(f"{q}.script") == "other") & verdict
    for name, band in language_bands.items() if lang_col else ():
        verdict = F.when(F.col(lang_col) == name, _outside(band, q) | other).otherwise(verdict)
    return verdict


def _bits(q: str) -> tuple[Column, Column]:
    """Binary logarithm of the number of tokens, and their entropy in bits."""
    size = F.log2(F.greatest(F.col(f"{q}.n_tokens"), F.lit(2)).cast("double"))
    return size, F.col(f"{q}.entropy") * size


def _own(lang: Column, key: tuple[str | None, str], q: str) -> Column:
    return lang.eqNullSafe(F.lit(key[0])) & (F.col(f"{q}.script") == key[1])


def _distance(norms: dict, lang: Column, q: str) -> Column:
    """The entropy's distance from the curve of the row's language and script; null without one."""
    size, bits = _bits(q)
    found = F.lit(None).cast("double")
    for key, curve in norms.items():
        found = F.when(_own(lang, key, q), bits - ((curve[0] * size + curve[1]) * size + curve[2])).otherwise(found)
    return found


def _quartiles(rows: DataFrame, keys: list[str], value: Column) -> dict[tuple[str | None, str], tuple[float, float]]:
    """The quartiles of a measure over all rows of each language and script, to four decimals: rows are counted by its value."""
    each = rows.groupBy(*keys, F.round(value * 10_000).cast("long").alias("at")).agg(F.count("*").alias("n"))
    own = W.partitionBy(*(F.col(k.split(".")[-1]) for k in keys))
    each = each.where("at is not null").select("*", F.sum("n").over(own.orderBy("at")).alias("upto"), F.sum("n").over(own).alias("of"))
    names = [k.split(".")[-1] for k in keys]
    found = each.groupBy(*names).agg(*(F.min(F.when(F.col("upto") * 4 >= F.col("of") * q, F.col("at"))) for q in (1, 3)))
    return {(r[0], r[1]): (r[2] / 10_000, r[3] / 10_000) for r in found.collect()}


def fit_norms(measured: DataFrame, lang_col: str | None = None, q: str = "quality", rounds: int = 4) -> dict[tuple[str | None, str], Norm]:
    """Norms of each language and script of a corpus, over all rows that the base rules keep.

    The curve is fitted by least squares from sums that Spark adds up, a few
    times over, each time without what was far off the one before. The driver
    gets a row of numbers per language and script. Quartiles are two hundredths
    of their values apart at least, so that copies of one text don't make a norm
    of no width.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = measured.where(~base_failed(q) & (F.col(f"{q}.n_tokens") > 1)).select(lang.alias("lang"), F.struct(*(F.col(f"{q}.{c}") for c in ("script", "n_tokens", "entropy", "chars_per_token"))).alias("q"))
    lang, (size, bits), keys = F.col("lang"), _bits("q"), ["lang", "q.script"]
    curves: dict = {}
    kept_rows, off = rows, {}
    for _ in range(rounds):
        sums = [F.sum(F.pow(size, k)).alias(f"s{k}") for k in range(5)] + [F.sum(bits * F.pow(size, k)).alias(f"b{k}") for k in range(3)]
        for r in kept_rows.groupBy(*keys).agg(*sums).collect():
            normal = np.array([[r[f"s{i + j}"] for j in (2, 1, 0)] for i in (2, 1, 0)])
            curves[r[0], r[1]] = tuple(np.linalg.lstsq(normal, np.array([r["b2"], r["b1"], r["b0"]]), rcond=1e-12)[0].tolist())
        far = _distance(curves, lang, "q")
        off = _quartiles(rows, keys, far)
        near = F.lit(False)
        for key, (low, high) in off.items():
            near = F.when(_own(lang, key, "q"), far.between(low - 2 * (high - low), high + 2 * (high - low))).otherwise(near)
        kept_rows = rows.where(near)
    chars = _quartiles(rows, keys, F.col("q.chars_per_token"))

    def wide(low: float, high: float, least: float) -> tuple[float, float]:
        more = max(0.0, least - (high - low)) / 2
        return low - more, high + more

    return {k: Norm(wide(*chars[k], 0.01 * sum(chars[k])), curves[k], wide(*off[k], 0.02)) for k in chars if k in curves and k in off}


def strayed(norms: dict[tuple[str | None, str], Norm], q: str = "quality", lang_col: str | None = None) -> Column:
    """Whether characters per token are beyond the fence of the row's language and script, or token entropy below it; never null.

    Texts that are cut into far longer or shorter tokens than the norm's are not
    of its kind, and are left to the bands.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    x, words = F.col(f"{q}.chars_per_token"), F.greatest(F.col(f"{q}.n_words"), F.lit(1))
    reach = F.greatest(F.lit(1.0), F.sqrt(F.lit(float(SHORT)) / words)) * SPREAD
    far = _distance({k: n.bits for k, n in norms.items()}, lang, q)
    verdict = F.lit(False)
    for key, norm in norms.items():
        (low, high), (least, most) = norm.chars_per_token, norm.off
        middle = (low + high) / 2
        outside = ~x.between(low - reach * (high - low), high + reach * (high - low)) | (far < least - reach * (most - least))
        verdict = F.when(_own(lang, key, q), x.between((1 - KIND) * middle, (1 + KIND) * middle) & outside).otherwise(verdict)
    return verdict


def kept(q: str = "quality", lang_col: str | None = None, norms: dict | None = None, **bands) -> Column:
    """Neither failed by the base rules nor rejected by a band nor astray of ``norms``; never null. A row's verdict is its own."""
    return ~base_failed(q) & ~rejected(q, lang_col, **bands) & ~strayed(norms or {}, q, lang_col)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str | None = None, norms: dict | None = None, own_norms: bool = False, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns, whatever their names.

    Each text is measured once, whole. Null and empty texts have too few words
    and go; repeated rows are judged alike, and no row by the rest of the table,
    unless with ``own_norms``: then the norms are fitted to all rows of
    ``docs``, whose measures are written to the shared folder for it.
    An empty table gives no rows. Languages without a norm have the bands of
    their script.
    """
    names = docs.columns
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))  # any names, also one called quality
    lang = lang_col and f"c{names.index(lang_col)}"
    found = measure(own, f"c{names.index(text_col)}", **options)
    if own_norms:
        found = materialise(found, "measured")
        norms = fit_norms(found, lang)
    return found.where(kept(lang_col=lang, norms=norms)).drop("quality").toDF(*names)
