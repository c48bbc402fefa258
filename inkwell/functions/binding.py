"""A value that an expression uses several times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``. Inside, the value is a variable, also in branches and in lambdas, where Spark would compute it anew."""
    return F.element_at(F.transform(F.array(value), body), 1)
