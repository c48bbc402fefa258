"""From recognised pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.confidence import page_value

#: How the texts of pages are joined.
PAGE_HEAD, PAGE_BREAK = "[Страница %d]\n", "\n\n--- СТРАНИЦА РАЗДЕЛИТЕЛЬ ---\n\n"


def _in_order(value: Column, page: str, keep: Column | None = None) -> Column:
    """The values of a document's pages, by page number."""
    item = F.struct(F.col(page).alias("p"), value.alias("v"))
    listed = F.collect_list(item if keep is None else F.when(keep, item))
    return F.transform(F.array_sort(listed), lambda x: x["v"])


def rollup(pages: DataFrame, keys: list[str], page: str = "page_number", text: str = "text", confidence: str = "confidence", error: str = "error", seconds: str | None = None) -> DataFrame:
    """One row per document.

    ``pages`` has a row per page that was rasterised, so gaps in page numbers
    don't count. A document is as sure as its least sure page. Its text leaves
    out pages without text; a document of such pages alone has an empty text.
    Pages of one document come together in one group, whose size is the
    document's own.
    """
    has_text = F.coalesce(F.col(text) != "", F.lit(False))
    value = page_value(F.col(confidence), F.col(error).isNotNull())
    parts = _in_order(F.concat(F.format_string(PAGE_HEAD, page), F.col(text)), page, has_text)
    columns = {
        "total_pages": F.count("*"),
        "processed_pages": F.count_if(has_text),
        "confidence": F.min(value),
        "confidence_per_page": _in_order(value, page),
        "combined_text": F.array_join(parts, PAGE_BREAK),
        "failed_pages": F.count_if(F.col(error).isNotNull()),
    }
    if seconds:
        columns["seconds_per_page"] = _in_order(F.round(seconds, 2), page)
    return pages.groupBy(*keys).agg(*(c.alias(n) for n, c in columns.items()))


def result_structs(pages: DataFrame, keys: list[str], page: str = "page_number", text: str = "text", confidence: str = "confidence", error: str = "error") -> DataFrame:
    """``(keys, pages)``: each document's pages as an array of structs in page order."""
    item = F.struct(F.col(page).alias("page_number"), F.col(text).alias("text"), F.col(confidence).alias("confidence"), F.col(error).alias("error"))
    return pages.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("pages"))


def pages_with_text(pages: Column) -> Column:
    return F.filter(pages, lambda p: F.coalesce(p["text"] != "", F.lit(False)))


def page_by_number(pages: Column, number: Column) -> Column:
    """The first page with a number, else null."""
    return F.get(F.filter(pages, lambda p: p["page_number"] == number), F.lit(0))


#: Positions that are numbered together.
STRETCH = 4096


def text_pages(items: DataFrame, keys: list[str], order: str, text: str, per_page: int = 30, stretch: int = STRETCH) -> DataFrame:
    """Paragraphs in pages of ``per_page``: page from 1, total, first and last place from 1, the paragraphs.

    Blank and null paragraphs are left out before places are counted. ``order``
    is a number. Places are counted in stretches of it, and go on where the
    stretches before have ended, so a document may hold any part of all rows: no
    group is larger than a stretch or a page. Paragraphs of one number are in the
    order of their texts.
    """
    worded = items.where(F.coalesce(F.col(text).rlike(r"[^\s\p{Z}]"), F.lit(False))).withColumn("_key", F.struct(*keys, F.floor(F.col(order) / stretch).alias("_at")))
    each = worded.groupBy("_key").agg(F.count("*").alias("_n"))
    whole = W.partitionBy(*(f"_key.{k}" for k in keys))
    before = whole.orderBy("_key._at").rowsBetween(W.unboundedPreceding, -1)
    starts = each.select("_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"), F.sum("_n").over(whole).alias("_total"))
    n = (F.col("_from") + F.row_number().over(W.partitionBy("_key").orderBy(order, text))).cast("int")
    placed = worded.join(starts, "_key").select(*keys, F.col(text).alias("_text"), n.alias("_n"), F.col("_total").cast("int").alias("_total"))
    page = F.floor((F.col("_n") - 1) / per_page).cast("int") + 1
    paragraphs = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_text"))), lambda x: x["_text"])
    found = placed.groupBy(*keys, page.alias("page")).agg(F.ceil(F.max("_total") / per_page).cast("int").alias("total_pages"), F.min("_n").alias("first"), F.max("_n").alias("last"), paragraphs.alias("paragraphs"))
    return found.select(*keys, "page", "total_pages", "first", "last", "paragraphs")


def converted(images: DataFrame, keys: list[str], image: str = "image") -> DataFrame:
    """``(keys, image_count)``: how many images a file was converted into; null ones are failures."""
    return images.groupBy(*keys).agg(F.count(image).alias("image_count"))
