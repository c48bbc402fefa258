"""Quality of recognition: a truth table against a table of recognised records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.confidence import strip
from ..functions.documents import json_text
from ..functions.similarity import cer, wer


def values(column: Column, kind: T.DataType) -> Column:
    """The values of a typed record as an array of strings, the last field first, as a stack gives them back.

    Field names and nulls don't count, nor do blank strings. Numbers are written
    as Spark writes them, which for doubles from 0.001 to ten million is the
    shortest decimal form.
    """
    if isinstance(kind, T.StructType):
        parts = [values(column.getField(f.name), f.dataType) for f in reversed(kind.fields)]
        return F.concat(*parts) if parts else F.array().cast("array<string>")
    if isinstance(kind, T.ArrayType):
        own = F.transform(column, lambda x: values(x, kind.elementType))
        return F.coalesce(F.flatten(F.reverse(own)), F.array().cast("array<string>"))
    if isinstance(kind, T.MapType):
        return values(F.map_values(column), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StringType):
        one = strip(column)
    elif isinstance(kind, T.BooleanType):
        one = F.when(column, "True").when(~column, "False")
    elif isinstance(kind, T.NumericType):
        one = column.cast("string")
    else:
        one = F.lit(None).cast("string")
    return F.when(F.coalesce(one, F.lit("")) != "", F.array(one)).otherwise(F.array().cast("array<string>"))


def flat_text(column: Column, kind: T.DataType) -> Column:
    return F.array_join(values(column, kind), " ")


def evenly(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by their keys for work that is heavy per row, which adaptive execution can't tell from small rows."""
    session = rows.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, *keys)


def error_rates(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``pairs`` with cer and wer of two text columns; null texts count as empty."""
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in (reference, hypothesis))
    return pairs.select("*", cer(a, b).alias("cer"), wer(a, b).alias("wer"))


def compare(truth: DataFrame, recognised: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """``(keys, cer, wer)`` for every truth row; a record that wasn't recognised counts as empty.

    A record is a struct, or a JSON text of any shape (``documents.json_values``);
    rows of one table may be of different shapes. Distances are computed where
    the join has brought the rows, in as many tasks as a shuffle has.
    """

    def flat(df: DataFrame, name: str) -> DataFrame:
        kind = df.schema[record].dataType
        text = json_text(F.col(record)) if isinstance(kind, T.StringType) else flat_text(F.col(record), kind)
        return evenly(df.select(*keys, text.alias(name)), *keys)

    both = flat(truth, "reference").join(flat(recognised, "hypothesis"), keys, "left")
    return error_rates(both, "reference", "hypothesis").select(*keys, "cer", "wer")


def tally(results: DataFrame, passed: Column, keys: list[str] = ()) -> DataFrame:
    """``(keys, passed, total, share)`` of checks; a null verdict is no pass, and without checks the share is null."""
    share = F.count_if(passed) / F.nullif(F.count("*"), F.lit(0))
    return results.groupBy(*keys).agg(F.count_if(passed).alias("passed"), F.count("*").alias("total"), share.alias("share"))
