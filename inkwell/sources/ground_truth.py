"""The store of true records: a table by document type and file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise

_ITEMS = "items array<struct<line_number: int, description: string, unit: string>>"
#: Records by document type, in the order in which their fields are asked for.
RECORDS = {
    "packing_list": f"invoice_number string, invoice_date string, {_ITEMS}",
    "invoice": f"invoice_number string, invoice_date string, {_ITEMS}",
    "payment_order": "payment_order_number string, payment_order_type string, document_date string",
    "account_protocol": "document_number string, document_date string, valid_until string",
}
STORE = "doc_type string, file_name string, record string"


_TEXT = r'"(?:[^"\\]++|\\.)*+"'
#: What stands before the entries of a type: the end of the type before it, types without entries, and the name.
_HEAD = rf"^(?:\s*+[,{{]?\s*+{_TEXT}\s*+:\s*+(?:{_TEXT}|[\w.+-]++)(?=\s*+,))*+\s*+[,{{]\s*+({_TEXT})\s*+:\s*+\{{"


def read_json(spark: SparkSession, path: str, doc_type: str | None = None) -> DataFrame:
    """``(doc_type, file_name, record)`` of JSON files, each of which maps types to names to records; records as JSON text.

    A file is read in byte ranges, cut at closing braces, wherever it has or
    lacks line ends. Whether a brace stands in a text follows from the number of
    quotes before it, and how deep it stands from the braces and brackets before it; both are
    added up per range, from range to range, and within each, without the texts. A record that ends
    closes a piece, which is put together by itself: no task holds more than a
    range and its longest record. With ``doc_type`` only records of that type are
    parsed. Of a name that a type has twice both records come.
    """
    place = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "at": F.monotonically_increasing_id()}
    bare = F.regexp_replace("value", r"\\.", "")  # no escapes

    def net(before: str) -> Column:
        """Opened less closed, outside of texts; braces that end pieces come on top."""
        outside = F.regexp_replace(F.concat(F.lit(before), bare), '"[^"]*+("|$)', "")
        down, back = (F.length(F.regexp_replace(outside, other, "")) for other in (r"[^{\[]", r"[^\]]"))
        return down - back

    # Whether a piece begins within a text shows later, so both cases are counted while its text is at hand.
    counts = {"quotes": F.length(F.regexp_replace(bare, '[^"]', "")), "net_out": net(""), "net_in": net('"')}
    raw = spark.read.option("lineSep", "}").text(path).select("value", *(c.alias(n) for n, c in place.items()))
    raw = materialise(raw.withColumns(counts), "pieces")
    rows = raw.drop("value")  # what is added up goes without the texts
    ends = rows.groupBy("file").agg(F.max(F.struct("block", "at")).alias("end"))
    # A file's last piece has no brace behind it.
    rows = rows.join(ends, "file").withColumn("closed", F.struct("block", "at") != F.col("end")).drop("end")
    rows = _running(rows, {"quotes": "before"})
    open_ = (F.col("before") % 2) == 1  # begins within a text
    still = (F.col("before") + F.col("quotes")) % 2 == 1  # ends within one
    rows = rows.withColumn("up", F.when(F.col("closed") & ~still, 1).otherwise(0))
    rows = _running(rows.withColumn("net", F.when(open_, F.col("net_in")).otherwise(F.col("net_out")) - F.col("up")), {"net": "depth"})
    # A record stands three deep; its end, and that of its type, close a piece.
    rows = rows.withColumn("after", F.col("depth") + F.col("net"))
    rows = rows.withColumn("ends", F.when((F.col("up") == 1) & (F.col("after") <= 2), 1).otherwise(0))
    rows = _running(rows, {"ends": "piece"}).select("at", "closed", "depth", "after", "piece")
    text = F.concat("value", F.when(F.col("closed"), F.lit("}")).otherwise(""))
    # One aggregate, so that names and entries read the same shuffle.
    own = raw.select("value", *place).join(rows, "at").groupBy("file", "piece").agg(F.array_sort(F.collect_list(F.struct("block", "at", text.alias("t"), "depth", "after"))).alias("own"))
    whole = F.array_join(F.transform("own", lambda x: x["t"]), "")
    pieces = own.select("file", "piece", whole.alias("text"), F.element_at("own", 1)["depth"].alias("from"), F.element_at("own", -1)["after"].alias("to"))
    head = F.when(F.col("from") <= 1, F.regexp_extract("text", _HEAD, 1))
    pieces = pieces.withColumns({"name": F.when(head != "", head), "text": F.when(F.col("from") <= 1, F.regexp_replace("text", _HEAD, "")).otherwise(F.col("text"))})
    # A piece is of the last type that was named before it; types are few, and so are the rows that name them.
    names = pieces.where("name is not null").select("file", F.col("piece").alias("since"), F.from_json(F.concat(F.lit("["), "name", F.lit("]")), "array<string>")[0].alias("doc_type"))
    names = names.withColumn("until", F.coalesce(F.lead("since").over(W.partitionBy("file").orderBy("since")), F.lit(1 << 62)))
    if doc_type is not None:
        names = names.where(F.col("doc_type") == doc_type)
    own = pieces.drop("name").join(F.broadcast(names), (pieces["file"] == names["file"]) & (F.col("piece") >= F.col("since")) & (F.col("piece") < F.col("until")))
    # The brace that ends a type belongs to no entry.
    entries = F.when((F.col("to") <= 1), F.regexp_replace("text", r"\}\s*$", "")).otherwise(F.col("text"))
    entries = F.concat(F.lit("{"), F.regexp_replace(entries, r"^\s*,", ""), F.lit("}"))
    return own.select("doc_type", F.explode(F.from_json(entries, "map<string, string>")).alias("file_name", "record"))


def _running(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Running sums of columns over a file's pieces, not counting the row itself; per range, over ranges, and within each."""
    rows = rows.withColumn("_range", F.struct("file", "block"))
    each = rows.groupBy("_range").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    earlier = W.partitionBy("_range.file").orderBy("_range.block").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    starts = each.select("_range", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    within = W.partitionBy("_range").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    local = rows.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_own_{c}") for c in sums)).join(starts, "_range")
    return local.select(*(c for c in rows.columns if c != "_range"), *((F.col(f"_{c}") + F.col(f"_own_{c}")).alias(name) for c, name in sums.items()))


def typed(store: DataFrame, doc_type: str) -> DataFrame:
    """The records of one type with their fields."""
    return store.where(F.col("doc_type") == doc_type).select("file_name", F.from_json("record", RECORDS[doc_type]).alias("record"))


def upsert(store: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """The store after the changes: the last change of each type and name takes the place of what was there.

    The last one is an aggregate, so that many changes of one record are reduced before the shuffle.
    Of changes with one place in the order the one with the greatest values counts.
    """
    keys = ["doc_type", "file_name"]
    rest = [c for c in changes.columns if c not in (*keys, order)]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_last")).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))
    return store.join(last.select(*keys), keys, "left_anti").unionByName(last)


def write(store: DataFrame, path: str) -> None:
    """The whole store as JSON lines, a folder per document type."""
    store.write.mode("overwrite").partitionBy("doc_type").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """What ``write`` wrote; an absent store is empty."""
    try:
        return spark.read.schema(STORE).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORE)


#: A store that changes are written into: when a record was changed last, and the part of its type that it stands in.
KEPT = "doc_type string, file_name string, record string, at long, bucket int"


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("file_name"), F.lit(buckets)).cast("int")


def start(store: DataFrame, path: str, buckets: int = 16) -> None:
    """Write a store with its records' last changes (``at``, null for none), a folder per type and part."""
    at = F.col("at").cast("long") if "at" in store.columns else F.lit(None).cast("long")
    rows = store.select("doc_type", "file_name", "record", at.alias("at"), _bucket(buckets).alias("bucket"))
    rows.repartition("doc_type", "bucket").write.partitionBy("doc_type", "bucket").parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KEPT).parquet(path)


def apply_changes(spark: SparkSession, path: str, changes: DataFrame, order: str = "at", buckets: int = 16) -> int:
    """Write changes ``(doc_type, file_name, record, order)`` into a store of ``start``; the number of records changed.

    A change counts if it is later than what the store has of its record, so
    changes may come in any order, and coming again they change nothing. Only
    parts of the store in which something changes are written. One that fails
    half-way is put right by applying the same changes again.
    """
    keys, parts = ["doc_type", "file_name"], ["doc_type", "bucket"]
    # Of changes with one place in the order the one with the greatest record counts.
    newest = F.max(F.struct(F.col(order).cast("long").alias("at"), "record"))
    last = changes.groupBy(*keys).agg(newest.alias("_last")).select(*keys, "_last.record", "_last.at", _bucket(buckets).alias("bucket"))
    kept = current(spark, path)
    was = kept.select(*keys, F.struct("at", "record").alias("_was"))
    newer = last.join(was, keys, "left").where(F.col("_was").isNull() | F.col("_was.at").isNull() | (F.struct("at", "record") > F.col("_was"))).drop("_was")
    newer = materialise(newer, "newer")
    n = newer.count()
    if n:
        touched = newer.select(*parts).distinct().withColumnsRenamed({"doc_type": "_type", "bucket": "_part"})
        rest = kept.join(F.broadcast(touched), F.col("doc_type").eqNullSafe(F.col("_type")) & (F.col("bucket") == F.col("_part")), "left_semi").join(newer.select(*keys), keys, "left_anti")
        both = rest.unionByName(newer).repartition(*parts)
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    return n


def follow_changes(changes: DataFrame, path: str, checkpoint: str, order: str = "at", buckets: int = 16):
    """A stream of changes written into a store, a batch at a time; a batch that comes again changes nothing."""

    def one(batch: DataFrame, batch_id: int) -> None:
        apply_changes(batch.sparkSession, path, batch, order, buckets)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
