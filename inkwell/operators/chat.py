"""Requests to chat models as JSON, and their answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.confidence import strip
from .registry import CODE_STOPS

ANSWER = "message struct<content: string>, eval_count int, response string"


def request(model: str = "model_name", text: str = "text", image: Column | None = None, system: Column | None = None, defaults: str | None = None, vision: bool = False, stops: bool = False, temperature: Column | None = None, max_tokens: Column | None = None) -> Column:
    """The JSON body of a chat request.

    Text models get a system message where they support one, by default the
    model's own prompt. Vision models get one only if it is given, and the
    model's prompt in place of a missing text; their image is base64. ``defaults``
    is the alias of the registry's columns. Code models have stop words.
    """
    own = f"{defaults}." if defaults else ""
    prompt, supports = F.col(f"{own}default_prompt"), F.col(f"{own}supports_system_prompt")
    words = F.coalesce(F.nullif(F.col(text), F.lit("")), prompt) if vision else F.col(text)
    given = system if system is not None else F.lit(None).cast("string")
    head = F.nullif(given, F.lit("")) if vision else F.coalesce(given, prompt)
    images = F.array_compact(F.array(image)) if image is not None else F.lit(None).cast("array<string>")
    images = F.when(F.size(images) > 0, images)

    def message(role: str, content: Column, pictures: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"), pictures.alias("images"))

    none = F.lit(None).cast("array<string>")
    messages = F.array_compact(F.array(F.when(supports & head.isNotNull(), message("system", head, none)), message("user", words, images)))
    options = [
        (temperature if temperature is not None else F.col(f"{own}default_temperature")).alias("temperature"),
        (max_tokens if max_tokens is not None else F.col(f"{own}default_max_tokens")).alias("num_predict"),
    ]
    if stops:
        options.append(F.array(*(F.lit(s) for s in CODE_STOPS)).alias("stop"))
    return F.to_json(F.struct(F.col(model).alias("model"), messages.alias("messages"), F.lit(False).alias("stream"), F.struct(*options).alias("options")))


def answer(body: Column) -> Column:
    """``(text, tokens_used, error)`` of an answer: no message is an empty text, no count is 0; text that isn't JSON is an error."""
    parsed = F.from_json(body, ANSWER)
    broken = body.isNull() | F.get_json_object(body, "$").isNull()
    text = F.coalesce(strip(parsed["message"]["content"]), F.lit(""))
    return F.struct(F.when(~broken, text).alias("text"), F.when(~broken, F.coalesce(parsed["eval_count"], F.lit(0))).alias("tokens_used"), F.when(broken, "not_json").alias("error"))
