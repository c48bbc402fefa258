"""Errors as data: a struct ``(kind, message, status_code, endpoint, model, operation)``.

``kind`` is one of api, ocr_server, preprocessing_server, file, validation,
image, or anything else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "kind string, message string, status_code int, endpoint string, model string, operation string"


def category(error: Column) -> Column:
    """Who has to look at it."""
    kind = error["kind"]
    api = kind.isin("api", "ocr_server", "preprocessing_server")
    ocr = (kind == "ocr_server") | (api & F.coalesce(error["endpoint"].isin("/ocr", "/models"), F.lit(False)))
    preprocessing = (kind == "preprocessing_server") | (api & F.coalesce(error["operation"].isin("convert", "rotate"), F.lit(False)))
    return F.when(ocr, "ocr").when(preprocessing, "preprocessing").when(kind.isin("file", "validation", "image"), kind).otherwise("unknown")


def message(error: Column) -> Column:
    """The text of an error with its status code and what is known of the request."""
    kind, code = error["kind"], error["status_code"]
    base = F.concat(F.lit("APIError"), F.when(F.coalesce(code, F.lit(0)) != 0, F.concat(F.lit(" ("), code.cast("string"), F.lit(")"))).otherwise(""), F.lit(": "), error["message"])

    def named(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}="), value))

    extras = F.concat_ws(" | ", named("endpoint", error["endpoint"]), named("model", error["model"]))
    ocr = F.when(extras != "", F.concat(base, F.lit(" ["), extras, F.lit("]"))).otherwise(base)
    preprocessing = F.concat(base, F.lit(" [operation="), F.coalesce(error["operation"], F.lit("unknown")), F.lit("]"))
    return F.when(kind == "ocr_server", ocr).when(kind == "preprocessing_server", preprocessing).when(kind == "api", base).otherwise(error["message"])


def hint(error: Column) -> Column:
    """What a user can do about it, as a code; null if nothing special."""
    kind, text, code = error["kind"], F.lower(error["message"]), error["status_code"]
    request = (
        F.when(kind == "connection", "start_server").when(kind == "timeout", "smaller_file")
        .when(code == 404, "check_url").when(code == 400, "check_parameters").when(code >= 500, "server_failed")
    )
    file = F.when(text.contains("empty") | text.contains("corrupt"), "other_file").when(text.contains("memory"), "smaller_file").otherwise("other_format")
    image = F.when(text.contains("memory"), "lower_resolution").otherwise("check_image")
    return F.when(kind == "file", file).when(kind == "image", image).when(kind == "validation", "check_value").otherwise(request)


#: Parts of a failed load's text, in the order in which they are sought, and what they mean.
LOAD_FAILURES = [("aistudio_sdk", "dependency_aistudio"), ("paddlenlp", "dependency_paddlenlp"), ("accelerate", "dependency_accelerate")]


def load_failure(text: Column, model: Column) -> Column:
    """Why a model could not be loaded; the text itself where no rule fits."""
    reason = F.when(text.contains("404 Client Error") & model.contains("deepseek-ocr2"), "model_not_published")
    for part, meaning in LOAD_FAILURES:
        reason = reason.when(F.lower(text).contains(part), meaning)
    return reason.otherwise(text)


def shortened(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def encodable(text: Column) -> Column:
    """Valid UTF-8; what isn't is replaced."""
    return F.make_valid_utf8(text)
