"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every document gets a hash-random key, its source is range-sorted by that key
in buckets of the key's range, and the running sum of sizes is taken in three
steps: sums per bucket, running sums over a source's buckets, running sums
within a bucket. A source's budget is as many whole epochs as fit and the first
documents of one further epoch; the cut is exact, so the document at the cut
counts in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialise, width

_RANGE = 1 << 60
#: Sources up to this number are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def random_key(seed: str, id_col: Column, text: Column) -> Column:
    """60 bits of an MD5 of seed, id and text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), id_col.cast("string"), text)), 1, 15), 16, 10).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``src``, the place of each source by code point from 0, null last.

    Sources are range-sorted over tasks; only a count per task reaches the driver.
    """
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    parts = materialise(sizes.repartitionByRange(max(1, min(8, width(spark))), order).withColumn("part", F.spark_partition_id()), "sources")
    counts = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    before, total = [], 0
    for part in sorted(counts):
        before += [F.lit(part), F.lit(total)]
        total += counts[part]
    if not before:
        return parts.select("*", F.lit(0).cast("long").alias("src")).drop("part")
    own = F.row_number().over(W.partitionBy("part").orderBy(order))
    return parts.select("*", (F.create_map(*before)[F.col("part")].cast("long") + own - 1).alias("src")).drop("part")


def target_table(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``(src, source, n, source_size, target)``: all sizes shared by weight, with no target above ``most`` times its source.

    ``sources`` holds source, n and source_size. The share per weight rises
    until the sources below their limit take what the others cannot.
    """
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(F.col("src") % len(weights) == i, w).otherwise(weight)
    table = materialise(ranked_sources(sources).withColumn("weight", weight.cast("long")), "weights")
    limit, share = F.col("source_size") * most, 0.0
    while True:
        full = F.lit(share) * F.col("weight") > limit
        r = table.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, limit).otherwise(0)).alias("taken"),
            F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("free"),
        ).first()
        now = ((r["total"] or 0) - (r["taken"] or 0)) / r["free"] if r["free"] else share
        if now <= share:
            break
        share = now
    return table.select("src", "source", "n", "source_size", F.least(F.lit(share) * F.col("weight"), limit.cast("double")).alias("target"))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """``docs`` in columns c0, c1, ... with source, size, and the key and values that order a source."""
    names = docs.columns
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))
    i, text, source = (F.col(f"c{names.index(c)}") for c in (id_col, text_col, source_col))
    return own.select("*", source.cast("string").alias("source"), word_count(text).alias("size"), random_key(seed, i, text).alias("key"), i.alias("tie"))


_ORDER = ["key", "tie", "size"]  # of a source's rows


def planned(slim: DataFrame, weights: Sequence[int], most: int) -> tuple[DataFrame, bool]:
    """A row per source with its target, bucket width, whole ``epochs`` and the ``rest`` of the further one; whether it is small."""
    sources = slim.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    targets = target_table(sources, weights, most)
    n, m = targets.agg(F.sum("n"), F.count("*")).first()
    # Buckets hold about as many rows each whatever the source, some for every task.
    per_bucket = max(64, -(-(n or 0) // (2 * width(slim.sparkSession))))
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0).cast("long")
    targets = targets.withColumns({"step": F.floor(F.lit(_RANGE) / F.ceil(F.col("n") / per_bucket)).cast("long") + 1, "epochs": epochs})
    rest = F.round("target").cast("long") - F.col("epochs") * F.col("source_size")
    targets = materialise(targets.withColumn("rest", rest).withColumnRenamed("source", "of").drop("n"), "targets")
    return targets, m <= BROADCAST_SOURCES


def _placed(df: DataFrame, targets: DataFrame) -> DataFrame:
    return df.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", F.expr("key div step")).drop("of", "step")


def _bucket_sums(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """``(src, bucket, own, earlier)``: the sizes in a bucket, and in those before it."""
    sums = _placed(slim, targets).groupBy("src", "bucket").agg(F.sum("size").alias("own"))
    earlier = F.sum("own").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    return sums.select("src", "bucket", "own", F.coalesce(earlier, F.lit(0)).alias("earlier"))


def _before() -> Column:
    """Sizes ahead of a row in its source."""
    within = F.sum("size").over(W.partitionBy("src", "bucket").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, -1))
    return F.col("earlier") + F.coalesce(within, F.lit(0))


def taken(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``rows`` (as of ``keyed``) with source_size, target and ``taken``."""
    targets, small = planned(rows, weights, most)
    targets = F.broadcast(targets) if small else targets
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - _before()))
    found = _placed(rows, targets).join(_bucket_sums(rows, targets).drop("own"), ["src", "bucket"])
    found = found.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
    return found.drop("src", "bucket", "earlier", "key", "tie", "epochs", "rest")


def cuts(slim: DataFrame, weights: Sequence[int], most: int) -> tuple[DataFrame, bool, bool]:
    """Per source ``of`` its epochs, and the row at the cut of the further one: rows ahead of it come once more.

    ``same`` rows are equal to the row at the cut, of which ``whole`` come once
    more. Also tells whether the table is small, and whether rows are equal at any cut. Only the
    buckets with a cut are sorted.
    """
    targets, small = planned(slim, weights, most)
    hint = F.broadcast if small else lambda x: x
    at = _bucket_sums(slim, hint(targets)).join(hint(targets.select("src", "rest")), "src")
    at = at.where((F.col("rest") >= F.col("earlier")) & (F.col("rest") < F.col("earlier") + F.col("own"))).select("src", "bucket", "earlier")
    rows = _placed(slim, hint(targets)).join(hint(at), ["src", "bucket"]).withColumn("before", _before())
    alike = rows.groupBy("src", *_ORDER).agg(F.count("*").alias("same"), F.min("before").alias("start"), F.first("rest").alias("goal"))
    alike = alike.where((F.col("goal") >= F.col("start")) & (F.col("goal") < F.col("start") + F.col("same") * F.col("size")))
    whole = F.floor((F.col("goal") - F.col("start")) / F.col("size") + 0.5).cast("long")
    alike = alike.select("src", *(F.col(c).alias(f"cut_{c}") for c in _ORDER), "same", whole.alias("whole"))
    found = materialise(targets.select("src", "of", "epochs").join(hint(alike), "src", "left").drop("src"), "cuts")
    return found, small, not found.where("same > 1").isEmpty()


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``size`` and ``taken`` count words; a null text has none. A null source is a
    source. Weights repeat over the sources by code point, null last. A source's
    ``taken`` add up to its target, rounded. The order is a hash of id and text,
    so reruns agree; rows that are equal in both are interchangeable. Texts of any
    length are counted whole; other columns, whatever their names, are left out.
    Without rows there is no result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    rows = materialise(keyed(slim, "doc_id", "text", "source", seed).drop("c1", "c2"), "sizes")
    return taken(rows, weights, most).select(F.col("c0").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``: each document as often as it is taken.

    Documents stay whole: the one at a source's cut comes once more if at least
    half of it is inside. Documents without words, also null and empty ones,
    come once. A row is decided by its place before or behind its source's cut,
    so no text is shuffled; of equal rows at a cut as many come as fit. An empty
    table gives no rows; other columns stay, whatever their names.
    """
    rows = keyed(docs, id_col, text_col, source_col, seed)
    table, small, several = cuts(materialise(rows.select("source", *_ORDER), "sizes"), weights, most)
    own = rows.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("of")))
    place, cut = F.struct(*_ORDER), F.struct(*(F.col(f"cut_{c}").alias(c) for c in _ORDER))
    at_cut, ahead = F.coalesce(place.eqNullSafe(cut) & F.col("cut_key").isNotNull(), F.lit(False)), F.coalesce((place < cut) & F.col("cut_key").isNotNull(), F.lit(False))
    more = F.when(ahead, 1).when(at_cut, F.col("whole")).otherwise(0)
    own = own.withColumns({"at_cut": at_cut, "more": more})
    if several:  # equal rows at a cut: as many of them as the cut leaves
        nth = F.row_number().over(W.partitionBy("source").orderBy("key"))
        tied = own.where("at_cut").withColumn("more", F.when(nth <= F.col("whole"), 1).otherwise(0))
        own = own.where("not at_cut").unionByName(tied)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + F.col("more")).cast("int")
    found = own.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


#: DuckDB SQL for ``mix`` over the table documents.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', 'mix', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS key
  FROM documents),
weighted AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER by_limit AS k,
         (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER (by_limit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (by_limit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM weighted WINDOW by_limit AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST)),
level AS (SELECT min_by(share, k) AS share FROM ordered WHERE share * weight <= 3 * source_size),
targets AS (
  SELECT source, source_size, least(level.share * weight, (3 * source_size)::DOUBLE) AS target FROM ordered, level),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM placed
"""
