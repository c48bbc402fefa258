"""Checks of parameters: a value, or an error as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(value: Column) -> Column:
    """A whole number as text, or null for anything else; no decimals, no exponents."""
    return F.when(value.rlike(r"^\s*[+-]?[0-9]+(?:_[0-9]+)*\s*$"), F.regexp_replace(F.btrim(value), "_", "").try_cast("long"))


def threshold(value: Column) -> Column:
    """``(value, error)``: ``not_a_number``, or ``out_of_range`` outside 0 to 255."""
    number = _whole(value)
    error = F.when(number.isNull(), "not_a_number").when(~number.between(0, 255), "out_of_range")
    return F.struct(F.when(error.isNull(), number.cast("int")).alias("value"), error.alias("error"))


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    """A whole number moved into a range; anything else is the default."""
    number = _whole(value)  # greatest and least would skip a null
    return F.when(number.isNull(), default).when(number < low, low).when(number > high, high).otherwise(number).cast("int")


def line_params(min_length: Column, max_gap: Column, morphology: Column) -> Column:
    """Parameters of line detection. ``morphology`` is true for any text that isn't empty, also "false"; null is true."""
    return F.struct(
        clamp(min_length, 10, 500, 50).alias("min_line_length"),
        clamp(max_gap, 1, 100, 20).alias("max_line_gap"),
        F.coalesce(morphology != "", F.lit(True)).alias("use_morphology"),
    )


def rotation_angle(value: Column) -> Column:
    """``(value, error)`` of an angle from -360 to 360; NaN passes."""
    number = F.btrim(value).try_cast("double")
    error = F.when(number.isNull(), "not_a_number").when(~F.isnan(number) & ~number.between(-360, 360), "out_of_range")
    return F.struct(F.when(error.isNull(), number).alias("value"), error.alias("error"))


def request_error(threshold: Column | None = None, min_length: Column | None = None, max_gap: Column | None = None) -> Column:
    """422 if a parameter of a request is outside the server's range, else null."""
    bad = F.lit(False)
    for value, low, high in ((threshold, 0, 255), (min_length, 10, 500), (max_gap, 1, 100)):
        if value is not None:
            bad = bad | ~F.coalesce(value.between(low, high), F.lit(False))
    return F.when(bad, 422)


def page_clamp(wanted: Column, low: Column, high: Column) -> Column:
    """The page that a selector starts at."""
    return F.least(F.greatest(low, wanted), high)


def saved_page(saved: Column, pages: Column) -> Column:
    """A remembered page that no longer exists is page 1."""
    return F.when(saved.between(1, pages), saved).otherwise(1)


def zero_page(wanted: Column, pages: Column) -> Column:
    """A page counted from 0; one out of range is page 0."""
    return F.when((wanted >= 0) & (wanted < pages), wanted).otherwise(0)
