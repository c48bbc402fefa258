"""What a session holds after its events, in batch.

Events have a session, a time, an action (``upload``, ``remove``, ``result``
or ``clear``), a file name, a kind of result and a payload. An upload of
another name clears all results; the same name keeps them, whatever the bytes.
A removal drops the file and keeps the results, and the next upload counts as
one of another name. A ``clear`` drops the results of one kind, as a failed
rotation does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMNS = ["session_id", "ts", "event_id", "action", "file_name", "kind", "payload"]


#: Spans of time that a table of events is cut into.
CHUNKS = 64


def _chunk(events: DataFrame, chunks: int) -> Column:
    """The number of an event's span of time; spans hold about equal numbers of all events, so none of a session holds more."""
    cuts = events.agg(F.percentile_approx("ts", [i / chunks for i in range(1, chunks)], 100 * chunks)).first()[0] if chunks > 1 else None
    at = F.lit(0)
    for cut in sorted(set(cuts or [])):
        at = at + (F.col("ts") > F.lit(cut)).cast("int")
    return F.coalesce(at, F.lit(-1))


def epochs(events: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """``events`` with ``epoch``: how often results have been cleared by another file.

    A session is read in spans of time, each sorted by itself, so one session may
    hold any part of all events. Of a span it matters what its first upload or
    removal is, which file it leaves behind, and how many changes it makes inside;
    these few rows are added up from span to span. An event without a time comes
    first, one without a name uploads a file without a name.
    """
    chunked = events.withColumn("_key", F.struct("session_id", _chunk(events, chunks).alias("chunk")))  # structs are equal also where a session is null
    piece = W.partitionBy("_key")
    order = piece.orderBy("ts", "event_id")
    upload, remove = F.col("action") == "upload", F.col("action") == "remove"
    # The file before each event: the last one uploaded, unless it was removed. A removal leaves no file, which no upload equals.
    change = F.when(upload, F.struct(F.lit(True).alias("there"), F.col("file_name").alias("name"))).when(remove, F.struct(F.lit(False).alias("there"), F.lit(None).cast("string").alias("name")))
    before = F.last(change, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = chunked.withColumns({"_change": change, "_before": before})
    new = F.when(upload & F.col("_before").isNotNull() & ~_same(F.col("file_name"), F.col("_before")), 1).otherwise(0)
    marked = marked.withColumn("_new", new)
    place = F.struct("ts", "event_id")
    spans = marked.groupBy("_key").agg(
        F.min_by("_change", F.when(F.col("_change").isNotNull(), place)).alias("first"), F.max_by("_change", F.when(F.col("_change").isNotNull(), place)).alias("last"), F.sum("_new").alias("inside")
    )
    earlier = W.partitionBy("_key.session_id").orderBy("_key.chunk").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("held", F.last("last", ignorenulls=True).over(earlier))
    nothing = F.struct(F.lit(False).alias("there"), F.lit(None).cast("string").alias("name"))
    spans = spans.withColumn("opens", F.when(F.col("first.there") & ~_same(F.col("first.name"), F.coalesce("held", nothing)), 1).otherwise(0))
    spans = spans.select("_key", "opens", F.coalesce(F.sum(F.col("inside") + F.col("opens")).over(earlier), F.lit(0)).alias("_from"))
    running = order.rowsBetween(W.unboundedPreceding, 0)
    local = marked.withColumns({"_seen": F.count("_change").over(running), "_sum": F.sum("_new").over(running)})
    found = local.join(spans, "_key")
    epoch = F.col("_from") + F.col("_sum") + F.when(F.col("_seen") > 0, F.col("opens")).otherwise(0)
    return found.select(*events.columns, epoch.alias("epoch"))


def _same(name: Column, held: Column) -> Column:
    return held["there"] & name.eqNullSafe(held["name"])


def current_files(events: DataFrame) -> DataFrame:
    """``(session_id, file_name)`` of the sessions that hold a file at the end."""
    last = events.where(F.col("action").isin("upload", "remove")).groupBy("session_id").agg(F.max_by(F.struct("action", "file_name"), F.struct("ts", "event_id")).alias("last"))
    return last.where("last.action = 'upload'").select("session_id", "last.file_name")


def current_results(events: DataFrame) -> DataFrame:
    """``(session_id, kind, payload)`` of the results that a session holds at the end: the last of each kind since the last other file."""
    own = epochs(events)
    last = own.groupBy("session_id").agg(F.max("epoch").alias("now"))
    results = own.where(F.col("action").isin("result", "clear")).groupBy("session_id", "epoch", "kind").agg(F.max_by(F.struct("action", "payload"), F.struct("ts", "event_id")).alias("last"))
    held = results.join(last, "session_id").where("epoch = now and last.action = 'result'")
    return held.select("session_id", "kind", "last.payload")


def state(events: DataFrame) -> DataFrame:
    """``(session_id, ts, event_id, epoch, file_name, has_file, results)``: what a stream has to know to go on after these events."""
    last = epochs(events).groupBy("session_id").agg(F.max(F.struct("ts", "event_id")).alias("at"), F.max("epoch").alias("epoch"))
    held = current_results(events).groupBy("session_id").agg(F.collect_list(F.struct("kind", "payload")).alias("results"))
    found = last.join(current_files(events).withColumn("has_file", F.lit(True)), "session_id", "left").join(held, "session_id", "left")
    kind = "array<struct<kind: string, payload: string>>"
    return found.select("session_id", "at.ts", "at.event_id", "epoch", "file_name", F.coalesce("has_file", F.lit(False)).alias("has_file"), F.coalesce(F.col("results"), F.array().cast(kind)).alias("results"))


def summary(events: DataFrame) -> DataFrame:
    """One row per session: epochs, events, the file at the end and the number of results held.

    Sessions are sorted once; what follows are aggregates of the same partitioning.
    """
    shown = F.col("action").isin("result", "clear")
    last = F.max_by(F.when(shown, F.col("action")), F.when(shown, F.struct("ts", "event_id")))
    kinds = epochs(events).groupBy("session_id", "epoch", "kind").agg(F.count("*").alias("events"), last.alias("last"))
    each = kinds.groupBy("session_id", "epoch").agg(F.sum("events").alias("events"), F.count_if(F.col("last") == "result").alias("held"))
    counts = each.groupBy("session_id").agg(F.max("epoch").alias("epochs"), F.sum("events").alias("events"), F.max_by("held", "epoch").alias("results"))
    return counts.join(current_files(events), "session_id", "left").select("session_id", "epochs", "events", "file_name", "results")
