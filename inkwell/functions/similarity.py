"""Error rates and similarity of a reference text and a recognised one."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binding import let
from .confidence import strip


def _common(a: Sequence, b: Sequence, n: int) -> int:
    """How many of the first ``n`` elements two sequences share."""
    low = 0
    while low < n:
        middle = (low + n + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle - 1
    return low


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Levenshtein distance of two sequences, a column of the table of prefixes at a time.

    A column is two whole numbers whose bits say where it rises and falls, so 64
    cells take one machine step. Common ends are left out first.
    """
    start = _common(a, b, min(len(a), len(b)))
    a, b = a[start:], b[start:]
    end = _common(a[::-1], b[::-1], min(len(a), len(b)))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    last, full = 1 << (len(a) - 1), (1 << len(a)) - 1
    up, down, distance = full, 0, len(a)
    for x in b:
        equal = where.get(x, 0)
        vertical = equal | down
        flat = (((equal & up) + up) ^ up) | equal
        rise, fall = down | (full & ~(flat | up)), up & flat
        if rise & last:
            distance += 1
        elif fall & last:
            distance -= 1
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | (full & ~(vertical | rise))) & full, rise & vertical & full
    return distance


@F.pandas_udf(T.IntegerType())
def _characters(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else edit_distance(a, b) for a, b in zip(reference, hypothesis)], dtype="Int32")


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("distance", "reference", "hypothesis")]))
def _words(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(reference, hypothesis):
        a, b = (None if x is None else x.split() for x in (a, b))
        rows.append((None,) * 3 if a is None or b is None else (edit_distance(a, b), len(a), len(b)))
    return pd.DataFrame(rows, columns=["distance", "reference", "hypothesis"], dtype="Int32")


def _rate(distance: Column, reference: Column, hypothesis_empty: Column) -> Column:
    return F.when(reference == 0, F.when(hypothesis_empty, 0.0).otherwise(1.0)).otherwise(distance / reference)


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edit distance in characters, by the reference's length; an empty reference gives 0 or 1. It may be over 1.

    The distance is computed in Arrow batches: the built-in one takes a step per cell (62 core seconds where this one
    takes 4.5, for 1,000 pairs of 2,000 characters).
    """
    return _rate(_characters(reference, hypothesis), F.length(reference), hypothesis == "")


def wer(reference: Column, hypothesis: Column) -> Column:
    """Edit distance in words between white space of any kind, by the reference's number of words, with the same rule for an empty one."""
    found = _words(reference, hypothesis)
    return _rate(found["distance"], found["reference"], found["hypothesis"] == 0)


def positional(reference: Column, hypothesis: Column) -> Column:
    """Share of equal characters at equal places, in percent of the longer text; case and outer space don't count.

    Two empty texts are equal.
    """
    pair = F.struct(F.lower(strip(reference)).alias("a"), F.lower(strip(hypothesis)).alias("b"))
    return let(pair, lambda p: _positional(p["a"], p["b"]))


def _positional(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    equal = F.size(F.filter(F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b")), lambda p: p["a"] == p["b"]))
    return F.when(a == b, 100.0).otherwise(F.when((a == "") | (b == ""), 0).otherwise(equal) / n * 100)


def round_trip_passes(reference: Column, hypothesis: Column, least: float = 70.0) -> Column:
    return positional(reference, hypothesis) >= least
