"""Recognition models as an extension point: a protocol, one load per Python worker, errors as data."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Recognizer(Protocol):
    """What a model has to offer. Prompts, token limits and decoding are its own affair."""

    def infer(self, image: dict, prompt: str) -> tuple[str, list[int] | None, list[list[float]] | None]:
        """Text, generated token ids, and the logits of each; None where the model has no scores."""


#: Token limit of each model, whether its text begins with the prompt, and whether it is stripped.
LIMITS = {"deepseek-ocr": (1024, True, False), "deepseek-ocr2": (2048, True, False), "glm-ocr": (2048, False, True), "paddleocr-vl-1.5": (1024, False, False)}

_loaded: dict[str, tuple[object, float]] = {}


def loaded(name: str, load: Callable[[], Recognizer]) -> tuple[Recognizer, float]:
    """A model of this Python worker and the seconds that its first load took."""
    if name not in _loaded:
        began = time.time()
        model = load()
        _loaded[name] = (model, time.time() - began)
    return _loaded[name]


def recognize(pages: DataFrame, name: str, load: Callable[[], Recognizer], image: str = "image", prompt: str = "Extract all text") -> DataFrame:
    """``pages`` with text, token_ids, logits, error and seconds.

    A page that fails has an error and no text, and the others go on. Scores
    come back as data, so confidence is a native expression beside this and is
    left out where nobody asks for it. ``load`` runs on the executors.
    """
    keys = [c for c in pages.columns if c != image]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for one in batch[image]:
                began = time.time()
                try:
                    model, _ = loaded(name, load)
                    text, tokens, logits = model.infer(one, prompt)
                    rows.append((text, tokens, logits, None, time.time() - began))
                except Exception as e:  # a page's failure is that page's result
                    rows.append((None, None, None, f"{type(e).__name__}: {e}", time.time() - began))
            found = pd.DataFrame(rows, columns=["text", "token_ids", "logits", "error", "seconds"], index=batch.index, dtype=object)
            found["seconds"] = found["seconds"].astype(float)
            yield pd.concat([batch[keys], found], axis=1)

    schema = f"{pages.select(*keys).schema.toDDL()}, text string, token_ids array<int>, logits array<array<float>>, error string, seconds double"
    return pages.mapInPandas(run, schema)


def inventory(spark: SparkSession, names: list[str], in_memory: list[str], accelerated: bool = False) -> DataFrame:
    """``(model, is_loaded, accelerated)`` for each known model."""
    rows = spark.createDataFrame([(n,) for n in names], "model string")
    return rows.withColumn("is_loaded", F.col("model").isin(in_memory)).withColumn("accelerated", F.lit(accelerated))
