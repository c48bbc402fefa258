"""Files, images and documents as DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import files as kinds
from ..functions.params import zero_page


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(path, name, ext, size, modified, content)`` of every file below a path; conditions on size and time reach the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        kinds.suffix("path").alias("ext"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        "content",
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, image, error)``: decoded images, gray ones with one channel; a file that isn't one has an error."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("image.origin").alias("path"), F.when(F.col("image.height") > 0, F.col("image")).alias("image"), F.when(F.col("image.height") <= 0, "undecodable").alias("error"))


#: Turns the bytes of a PDF and a resolution into (page from 1, image struct) pairs; pages that fail are left out.
Rasterizer = Callable[[bytes, int], Iterator[tuple[int, dict]]]


def pdf_pages(files: DataFrame, rasterize: Rasterizer, keys: list[str], dpi: int = kinds.OCR_PIXELS_DPI, first_page_only: bool = False) -> DataFrame:
    """``(keys, page_number, image, error)``: a row per page that ``rasterize`` gives.

    No PDF library comes with this package; ``rasterize`` brings one. A file
    that it can't read gives one row with an error and no page. Gaps in page
    numbers stay.
    """
    kind = files.select(*keys).schema.toDDL()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, content in zip(batch.index, batch["content"]):
                try:
                    for number, image in rasterize(bytes(content), dpi):
                        rows.append((i, number, image, None))
                        if first_page_only:
                            break
                except Exception as e:  # an unreadable file is a result
                    rows.append((i, None, None, f"{type(e).__name__}: {e}"))
            found = pd.DataFrame(rows, columns=["i", "page_number", "image", "error"])
            found["page_number"] = found["page_number"].astype("Int32")
            own = batch.loc[found["i"], keys].reset_index(drop=True)
            yield pd.concat([own, found[["page_number", "image", "error"]]], axis=1)

    image = "struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
    return files.select(*keys, "content").mapInPandas(run, f"{kind}, page_number int, image {image}, error string")


def single_page(pages: DataFrame, keys: list[str], wanted: str) -> DataFrame:
    """The page that is wanted of each file, counted from 0; page 0 where it is out of range."""
    last = pages.groupBy(*keys).agg(F.max("page_number").alias("_n"))
    return pages.join(last, keys).where(F.col("page_number") == zero_page(F.col(wanted), F.col("_n")) + 1).drop("_n")


@F.pandas_udf(T.ArrayType(T.StringType()))
def docx_paragraphs(content: pd.Series) -> pd.Series:
    """Paragraphs of a DOCX file that aren't blank, in order; null for what isn't one."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def read(data) -> list[str] | None:
        try:
            body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{space}body")
            out = []
            for p in body.findall(f"{space}p"):
                parts = {f"{space}t": lambda x: x.text or "", f"{space}tab": lambda x: "\t", f"{space}br": lambda x: "\n"}
                text = "".join(parts[x.tag](x) for x in p.iter() if x.tag in parts)
                if text.strip():
                    out.append(text)
            return out
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError, AttributeError):
            return None

    return content.map(read)

