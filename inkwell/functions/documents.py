"""Values of JSON texts whose fields nobody has declared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .confidence import strip

#: A text or a name with its colon, or anything else that stands by itself. Nothing is tried again, so long texts are no harm.
_TOKEN = r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?|[^\s{}\[\],:"]++'


def python_number(token: Column) -> Column:
    """A JSON number as Python prints it: whole numbers as they are, others as the shortest decimal that gives the same double."""
    return let(token.try_cast("double"), lambda x: _printed(token, x))


def _printed(token: Column, x: Column) -> Column:
    size = F.abs(x)
    # 38 digits hold every double of this range with all its digits.
    plain = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,22)").cast("string"), "0+$", ""), r"\.$", ".0")
    # Java: 1.0E22 and 1.5E-5; Python: 1e+22 and 1.5e-05.
    java = x.cast("string")
    power = F.regexp_extract(java, r"E(-?\d+)$", 1)
    signed = F.concat(F.when(power.startswith("-"), "-").otherwise("+"), F.lpad(F.abs(power.try_cast("int")).cast("string"), F.greatest(F.length(F.regexp_replace(power, "-", "")), F.lit(2)), F.lit("0")))
    short = F.concat(F.regexp_replace(F.regexp_extract(java, r"^(.*)E", 1), r"\.0$", ""), F.lit("e"), signed)
    return (
        F.when(token.rlike(r"^-?\d+$"), F.regexp_replace(token, "^-0$", "0"))
        .when(x.isNull() | F.isnan(x), F.lit("nan"))
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when(size == 0, F.when(token.startswith("-"), "-0.0").otherwise("0.0"))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(short)
    )


def json_values(record: Column) -> Column:
    """The values of a JSON text of any shape as an array of strings, the last one first, as a stack gives them back.

    Lists and objects may be nested in any way, and every record may have other
    fields. A stack that takes an object's or list's parts in their order, and
    gives back the last one first, visits the values against the order in which
    the text holds them, so the text's tokens are all that is needed: one pass
    over each record, however deep it is. Names and nulls don't count, nor do
    blank strings; others are stripped. Numbers and booleans are written as
    Python prints them. A text that is no JSON gives null, as does null. Where an
    object has one name twice both values count.
    """
    tokens = F.filter(F.regexp_extract_all(record, F.lit(_TOKEN), F.lit(0)), lambda t: ~t.endswith(":") & (t != "null"))
    quoted = F.transform(
        tokens,
        lambda t: F.when(t.startswith('"'), t).when(t == "true", '"True"').when(t == "false", '"False"').otherwise(F.concat(F.lit('"'), python_number(t), F.lit('"'))),
    )
    # Escapes are the JSON reader's work, once per record.
    plain = F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")
    found = F.filter(F.transform(F.reverse(plain), strip), lambda v: v != "")
    return F.when(F.try_parse_json(record).isNotNull(), found)


def json_text(record: Column) -> Column:
    """The values joined by blanks; empty for what is no JSON."""
    return F.coalesce(F.array_join(json_values(record), " "), F.lit(""))
