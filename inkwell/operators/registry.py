"""The model registry as a small table, and look-ups in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "ordinal int, name string, class string, category string, alias string, model_type string, input_type string, display_name string,"
    " supports_streaming boolean, supports_confidence boolean, supports_multilingual boolean, supports_system_prompt boolean,"
    " default_prompt string, default_temperature double, default_max_tokens int, languages array<string>"
)
TYPES = ["text", "vision", "multimodal", "ocr", "embedding", "specialized"]
INPUTS = ["text_only", "image_only", "text_and_image", "file", "custom"]
CATEGORIES = ["ocr", "text_general", "text_code", "vision", "specialized"]
FALLBACK = "llama3:latest"

# The models known from the start and what they can do.
_TEXT = {"model_type": "text", "input_type": "text_only", "streaming": False, "system": True, "prompt": "You are a helpful assistant.", "temperature": 0.7, "tokens": 2048, "languages": ["en", "ru"]}
MODELS = [
    {"name": "llama3:latest", "class": "Llama3TextModel", "category": "text_general", "alias": "llama3", "display": "Llama 3", **_TEXT},
    {"name": "qwen:latest", "class": "QwenTextModel", "category": "text_general", "alias": "qwen", "display": "Qwen", **_TEXT},
    {"name": "phi3:latest", "class": "Phi3TextModel", "category": "text_general", "alias": "phi3", "display": "Phi 3", **_TEXT},
    {"name": "codellama:latest", "class": "CodeLlamaModel", "category": "text_code", "alias": "codellama", "display": "CodeLlama", **_TEXT},
    {"name": "glm-ocr:latest", "class": "GlmOcrModel", "category": "ocr", "alias": "glm-ocr", "display": "GLM-OCR", "model_type": "ocr", "input_type": "text_and_image", "streaming": False, "system": False, "prompt": "Extract all text from this image. Preserve structure and layout.", "temperature": 0.0, "tokens": 2048, "languages": ["en", "ru", "zh"]},
    {"name": "llava:latest", "class": "LlavaVisionModel", "category": "vision", "alias": "llava", "display": "LLaVA", "model_type": "vision", "input_type": "text_and_image", "streaming": True, "system": True, "prompt": "You are a helpful assistant that can analyze images. Describe what you see.", "temperature": 0.7, "tokens": 1024, "languages": ["en", "ru"]},
    {"name": "moondream:latest", "class": "MoondreamVisionModel", "category": "vision", "alias": "moondream", "display": "Moondream", "model_type": "vision", "input_type": "text_and_image", "streaming": False, "system": True, "prompt": "Describe this image.", "temperature": 0.7, "tokens": 512, "languages": ["en"]},
]
CODE_STOPS = ["```", "def ", "class ", "if ", "for ", "while ", "{", "}"]


def default_category(model_type: Column, display_name: Column) -> Column:
    """Where a model belongs that is registered without a category."""
    text = F.when(F.lower(display_name).contains("code"), "text_code").otherwise("text_general")
    return F.when(model_type == "ocr", "ocr").when(model_type == "text", text).when(model_type.isin("vision", "multimodal"), "vision").otherwise("specialized")


def registry(spark: SparkSession, more: list[dict] = ()) -> DataFrame:
    """The models known from the start and ``more`` of the same form; a later one of the same name takes its place."""
    rows = {}
    for m in [*MODELS, *more]:
        ordinal = rows[m["name"]][0] if m["name"] in rows else len(rows)
        rows[m["name"]] = (
            ordinal, m["name"], m.get("class"), m.get("category"), m.get("alias"), m["model_type"], m["input_type"], m["display"], m["streaming"], m.get("confidence", False), m.get("multilingual", True), m["system"],
            m["prompt"], m["temperature"], m["tokens"], m["languages"],
        )
    table = spark.createDataFrame(list(rows.values()), SCHEMA)
    return table.withColumn("category", F.coalesce("category", default_category(F.col("model_type"), F.col("display_name"))))


def resolve(requests: DataFrame, models: DataFrame, wanted: str = "model") -> DataFrame:
    """``requests`` with ``model_name`` and ``model_class``, by alias or name; null where a model is unknown.

    The registry is a table of a few rows written by hand, so it goes to every task.
    """
    names = models.select(F.explode(F.array_compact(F.array("alias", "name"))).alias("_id"), F.col("name").alias("model_name"), F.col("class").alias("model_class"))
    return requests.join(F.broadcast(names), F.col(wanted) == F.col("_id"), "left").drop("_id")


def refused(requests: DataFrame, models: DataFrame, wanted: str = "model") -> DataFrame:
    """Requests for unknown models, with status 400."""
    return resolve(requests, models, wanted).where("model_name is null").drop("model_name", "model_class").withColumn("status_code", F.lit(400))


def available(models: DataFrame, model_type: str | None = None, category: str | None = None) -> DataFrame:
    for column, value in (("model_type", model_type), ("category", category)):
        if value:
            models = models.where(F.col(column) == value)
    return models


def default_model(models: DataFrame, model_type: str = "text") -> DataFrame:
    """One row ``(name)``: the first registered model of a type, or the fallback."""
    return available(models, model_type).agg(F.coalesce(F.min_by("name", "ordinal"), F.lit(FALLBACK)).alias("name"))


def with_defaults(requests: DataFrame, models: DataFrame) -> DataFrame:
    """``requests`` with ``default_model``: the first registered model of their ``model_type``, or the fallback."""
    first = models.groupBy("model_type").agg(F.min_by("name", "ordinal").alias("default_model"))
    found = requests.join(F.broadcast(first), "model_type", "left")  # a row per type
    return found.withColumn("default_model", F.coalesce("default_model", F.lit(FALLBACK)))


def with_offers(requests: DataFrame, models: DataFrame) -> DataFrame:
    """``requests`` with ``offered``: how many models their ``category`` has."""
    counts = models.groupBy("category").agg(F.count("*").alias("offered"))
    found = requests.join(F.broadcast(counts), "category", "left")  # a row per category
    return found.withColumn("offered", F.coalesce("offered", F.lit(0)))


def by_category(models: DataFrame) -> DataFrame:
    """``(category, models)`` for every category, also the empty ones, in order of registration."""
    all_ = models.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    listed = models.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("models"))
    return all_.join(listed, "category", "left").select("category", F.coalesce("models", F.array().cast("array<string>")).alias("models"))


def on_server(models: DataFrame, server: DataFrame, name: str = "name") -> DataFrame:
    """``models`` with the flag ``available_on_server``."""
    there = server.select(F.col(name).alias("name")).distinct().withColumn("there", F.lit(True))
    return models.join(there, "name", "left").withColumn("available_on_server", F.coalesce("there", F.lit(False))).drop("there")


def load_label(name: Column, loaded: Column) -> Column:
    return F.when(F.array_contains(loaded, name), "loaded").otherwise("not_loaded")


def is_text_model(model_type: Column) -> Column:
    return model_type.isin("text", "multimodal")


def is_vision_model(model_type: Column) -> Column:
    return model_type.isin("vision", "ocr", "multimodal")


def input_error(input_type: Column, text: Column, image: Column) -> Column:
    """What a model's input lacks: ``text``, ``image`` or ``text_or_image``; else null."""
    no_text, no_image = F.coalesce(text, F.lit("")) == "", F.coalesce(image, F.lit("")) == ""
    return (
        F.when((input_type == "text_only") & no_text, "text")
        .when((input_type == "image_only") & no_image, "image")
        .when((input_type == "text_and_image") & no_text & no_image, "text_or_image")
    )
