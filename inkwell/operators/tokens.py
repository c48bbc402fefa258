"""Confidence from logits in long form: a row per document, step and token of the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import FLOOR, NEUTRAL

#: Logits are added up by bands of this width, relative to the band's lower end, so that no power overflows.
BAND = 32


def step_probabilities(logits: DataFrame, keys: list[str], step: str = "step", token: str = "token", logit: str = "logit", made: str = "made") -> DataFrame:
    """``(keys, step, p)``: the softmax of each step at the token that was made; null if the vocabulary lacks it.

    The rows of a step may come from any number of tasks. A band of logits is a
    pair of its lower end and a sum scaled to it; pairs are added up before the
    shuffle, and a step's few pairs are rescaled to its highest one. No step is
    ever held as a list of its logits, however large the vocabulary. A null logit
    counts nothing.
    """
    x = F.col(logit).cast("double")
    band = F.floor(x / BAND)
    rows = logits.where(F.col(logit).isNotNull())
    pairs = rows.groupBy(*keys, step, band.alias("_band")).agg(F.sum(F.exp(x - band * BAND)).alias("_sum"), F.max(F.when(F.col(token) == F.col(made), x)).alias("_own"))
    steps = pairs.groupBy(*keys, step).agg(F.max("_band").alias("_top"), F.collect_list(F.struct("_band", "_sum")).alias("_pairs"), F.max("_own").alias("_own"))
    total = F.aggregate("_pairs", F.lit(0.0), lambda a, p: a + p["_sum"] * F.exp(((p["_band"] - F.col("_top")) * BAND).cast("double")))
    return steps.select(*keys, step, (F.exp(F.col("_own") - F.col("_top") * BAND) / total).alias("p"))


def confidence(logits: DataFrame, keys: list[str], step: str = "step", token: str = "token", logit: str = "logit", made: str = "made") -> DataFrame:
    """``(keys, steps, confidence)``: the geometric mean of a document's token probabilities, each FLOOR at least.

    ``steps`` counts those whose token is in the vocabulary; a document with
    another one is NEUTRAL.
    """
    p = step_probabilities(logits, keys, step, token, logit, made)
    mean = F.exp(F.avg(F.ln(F.greatest("p", F.lit(FLOOR)))))
    return p.groupBy(*keys).agg(F.count("p").alias("steps"), F.when(F.count_if(F.col("p").isNull()) > 0, NEUTRAL).otherwise(mean).alias("confidence"))
