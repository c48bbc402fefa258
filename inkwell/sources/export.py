"""Results as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def download_text(file_type: Column, combined_text: Column, text: Column) -> Column:
    """The text that a user downloads: of a PDF that of all its pages."""
    return F.coalesce(F.when(file_type == "pdf", combined_text).otherwise(text), F.lit(""))


def json_of(*columns: Column | str) -> Column:
    """The columns as one JSON text, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def result_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls included."""
    return df.select(json_of(*df.columns).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    result_json(df).write.mode("overwrite").text(path)


def write_text(df: DataFrame, path: str, text: str = "text") -> None:
    df.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def as_base64(content: Column) -> Column:
    return F.base64(content)


def from_base64(text: Column) -> Column:
    """Bytes, or null for what isn't base64."""
    return F.try_to_binary(text, F.lit("base64"))
