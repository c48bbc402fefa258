"""Confidence of recognised text, from token logits and from the text itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Fixed values of the scores.
FLOOR, NEUTRAL, BASE, BLANK = 0.01, 0.5, 0.7, 0.1
#: White space as Python's ``strip`` has it.
SPACE = r"[\s\x1c-\x1f\x85\x0b\p{Z}]"


def strip(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")


def token_probability(logits: Column, token: Column) -> Column:
    """Softmax of the logits at a token counted from 0, FLOOR at least; null outside the vocabulary."""
    most = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - most))
    own = F.exp(F.try_element_at(logits, (token + 1).cast("int")).cast("double") - most)
    return F.when((token >= 0) & own.isNotNull(), F.greatest(own / total, F.lit(FLOOR)))


def sequence_confidence(tokens: Column, logits: Column, prompt_length: Column) -> Column:
    """Geometric mean of the probabilities of generated tokens.

    ``tokens`` begins with the prompt; ``logits`` holds one array per generated
    token. As many steps count as both have. NEUTRAL if there is none, or if a
    token is outside the vocabulary.
    """
    made = F.slice(tokens, prompt_length + 1, F.greatest(F.size(tokens) - prompt_length, F.lit(0)))
    n = F.least(F.size(made), F.size(logits))
    pairs = F.arrays_zip(F.slice(made, F.lit(1), n).alias("t"), F.slice(logits, F.lit(1), n).alias("l"))
    logs = F.transform(pairs, lambda p: F.ln(token_probability(p["l"], p["t"])))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / n
    return F.coalesce(F.when(n > 0, F.exp(mean)), F.lit(NEUTRAL))


def mean_confidence(probability: Column) -> Column:
    """The same over rows: an aggregate of token probabilities."""
    return F.coalesce(F.exp(F.avg(F.ln(F.greatest(probability, F.lit(FLOOR))))), F.lit(NEUTRAL))


def heuristic(text: Column, area: Column | None = None) -> Column:
    """A score of the text's looks, and of the image's area in pixels where it is given.

    Short and very long texts, five equal characters in a row, signs other than
    letters, digits and spaces, and small images lower it. Blank and null texts
    have BLANK. It is at most BASE.
    """
    return let(strip(text), lambda own: _looks(own, area))


def _looks(own: Column, area: Column | None) -> Column:
    n = F.length(own)
    length = F.when(n < 10, 0.7).when(n > 5000, 0.9).otherwise(1.0)
    repeated = F.when(own.rlike(r"([^\n])\1{4,}"), 0.6).otherwise(1.0)
    good = F.length(F.regexp_replace(own, r"[^\p{L}\p{N}\s\p{Z}\x1c-\x1f\x85\x0b]", ""))
    score = BASE * length * repeated * (0.5 + good / n * 0.5)
    if area is not None:
        score = score * F.when(area < 50_000, 0.85).otherwise(1.0)
    return F.when(F.coalesce(n, F.lit(0)) == 0, BLANK).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def combine(token: Column, looks: Column, has_scores: Column) -> Column:
    """Seven tenths of the token score and three of the other, where there are token scores."""
    return F.when(has_scores & token.isNotNull(), 0.7 * token + 0.3 * looks).otherwise(looks)


#: How each recognition model scores: with tokens and text, only where token scores exist, or by text alone.
POLICIES = {"deepseek-ocr": "combined", "deepseek-ocr2": "combined", "glm-ocr": "tokens_only", "paddleocr-vl-1.5": "text_only"}


def by_policy(policy: Column, token: Column, looks: Column, has_scores: Column, wanted: Column) -> Column:
    """The score that a model returns; null if none is wanted or none is to be had."""
    score = (
        F.when(policy == "combined", combine(token, looks, has_scores))
        .when(policy == "tokens_only", F.when(has_scores, combine(token, looks, has_scores)))
        .when(policy == "text_only", looks)
    )
    return F.when(wanted, score)


#: Least confidence, level, colour, sign and advice.
BANDS = [
    (0.85, "high", "Высокая", "#28a745", "✅", "Результат можно использовать без дополнительной проверки"),
    (0.70, "medium", "Средняя", "#ffc107", "⚠️", "Рекомендуется проверить критичные поля (суммы, даты, номера)"),
    (None, "low", "Низкая", "#dc3545", "❌", "Обязательна полная ручная проверка документа"),
]


def band(confidence: Column) -> Column:
    """A struct of level, label, colour, sign and advice."""
    *upper, last = (F.struct(*(F.lit(v).alias(k) for k, v in zip(("level", "label", "color", "sign", "advice"), row[1:]))) for row in BANDS)
    chosen = last
    for (least, *_), struct in reversed(list(zip(BANDS, upper))):
        chosen = F.when(confidence >= least, struct).otherwise(chosen)
    return F.when(confidence.isNotNull(), chosen)


def level(confidence: Column) -> Column:
    return band(confidence)["level"]


def page_value(confidence: Column, failed: Column) -> Column:
    """What a page counts for its document: failed pages BLANK, pages without a score NEUTRAL."""
    return F.when(failed, BLANK).otherwise(F.coalesce(confidence, F.lit(NEUTRAL)))
