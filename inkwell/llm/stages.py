"""From documents to training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of the table documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import fertility, line_dedup, mixing, near_copies, packing
from .common import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts, having under 20 words, go.

    Repeated rows are judged alike, by norms of all documents; texts of any length
    are read whole, other columns stay. An empty table gives no rows.
    """
    return fertility.keep_good(docs, lang_col="lang", own_norms=True)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that over 2 % of their source's distinct texts hold, and five texts at least.

    A text of such lines alone becomes empty, a null text stays null. Copies of
    a text count once, so that they don't lose their own lines. Documents
    without a source are a source of their own. Repeated rows all stay, as do
    other columns; n_chars follows the text. An empty table gives no rows.
    """
    found = line_dedup.drop_boilerplate(docs, "text", "source", ratio=0.02, min_pages=5, copies_as_one=True)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts have 0.8 or more of their five-word shingles in common: the one of the smallest id.

    Null, empty and wordless texts are one group. Of repeated rows one stays;
    rows without an id all stay. Texts of any length are compared whole, other
    columns stay. An empty table gives no rows.
    """
    return near_copies.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; those without words, also null texts, come once.

    Documents without a source are a source of their own. Repeated rows are
    rows of their own; of equal ones at a source's cut as many come as fit.
    Other columns stay. An empty table gives no rows.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; a null or empty text is one piece with the end token alone.

    Repeated rows are packed as often as they occur, texts of any length whole.
    Other columns are left out. An empty table gives no rows.
    """
    return packing.pack(docs, added=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the token ids nor the shingles; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
