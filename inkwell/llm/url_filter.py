"""URL filters by a temporal join with dated lists.

List entries are dated: on a day a pattern comes onto a list or leaves it. They
become validity intervals, and an as-of join evaluates every capture against
the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, without
from .line_dedup import url_host

#: Up to so many intervals are broadcast; each has a pattern of a host or of a host and a path segment.
BROADCAST_INTERVALS = 200_000
_SEGMENT = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def validity(entries: DataFrame) -> DataFrame:
    """``(list, pattern, valid_from, valid_to)`` from dated entries ``(list, pattern, day, listed)``.

    An entry holds from its day on until the next day with an entry for the
    same list and pattern; ``valid_to`` is null for the last one. Of several
    entries of one day a listing goes ahead of a removal. Entries without a
    list, pattern, day or verdict are void.
    """
    days = entries.dropna(subset=["list", "pattern", "day", "listed"]).groupBy("list", "pattern", "day").agg(F.bool_or("listed").alias("listed"))
    until = F.lead("day").over(W.partitionBy("list", "pattern").orderBy("day"))
    return days.withColumn("valid_to", until).where("listed").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def candidates(url: Column) -> Column:
    """Patterns that could name a URL: its host, the domains above it, and the host with the first path segment."""
    host = url_host(url)
    labels = F.split(host, "[.]")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(url, _SEGMENT, 1)
    return F.array_distinct(F.when(segment != "", F.array_append(above, F.concat(host, F.lit("/"), segment))).otherwise(above))


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` with ``hit_lists`` and ``hit_patterns``, sorted and distinct, of the entries active at fetch time.

    ``blocked`` is true if there is any. A capture without host or fetch time
    has none: a null or empty URL, one without a scheme, or text that is no URL.
    Long URLs are read whole. Repeated captures all stay, each with its hits. An
    empty table gives no rows, an empty list blocks nothing. Intervals of a
    checked number go to all tasks; more of them are joined on the pattern by a
    shuffle in which Spark can split a frequent host. Only hits are grouped.
    Columns of the three new names are replaced.
    """
    captures = without(captures, ["hit_lists", "hit_patterns", "blocked"], [url_col, time_col])
    names = captures.columns
    own = captures.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("row", F.monotonically_increasing_id())
    url, fetched = (F.col(f"c{names.index(c)}") for c in (url_col, time_col))
    # Rows get numbers that stay the same for both uses.
    sought = materialise(own.select("row", fetched.cast("timestamp").alias("fetched"), url.alias("url"), *own.columns[:-1]), "captures")
    probes = sought.where("fetched is not null").select("row", "fetched", F.explode(candidates(F.col("url"))).alias("pattern"))
    intervals = materialise(validity(entries), "intervals")
    if intervals.count() <= BROADCAST_INTERVALS:
        intervals = F.broadcast(intervals)
    hits = probes.join(intervals, "pattern").where((F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    hits = hits.groupBy("row").agg(F.array_sort(F.collect_set("list")).alias("hit_lists"), F.array_sort(F.collect_set("pattern")).alias("hit_patterns"))
    none = F.array().cast("array<string>")
    return sought.join(hits, "row", "left").select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)),
        F.coalesce("hit_lists", none).alias("hit_lists"),
        F.coalesce("hit_patterns", none).alias("hit_patterns"),
        F.col("hit_lists").isNotNull().alias("blocked"),
    )


def _number(what: Column) -> Column:
    return F.conv(F.substring(F.md5(what), 1, 7), 16, 10).cast("long")


def page_captures(pages: DataFrame) -> DataFrame:
    """The table pages as captures: a page's fetch time follows from its id, somewhere in the year 2024."""
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 37, F.lit(527040)) * 60)
    return pages.select("page_id", "url", fetched.alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated lists for the hosts and sections of the table pages.

    One host in three is listed on one day, part of them leave the list later,
    part of those come back. One section in seven is listed likewise. Hosts
    whose name says so are on the list "adult" from the first day.
    """
    host = url_host(F.col("url"))
    section = F.concat(host, F.lit("/"), F.regexp_extract("url", _SEGMENT, 1))
    named = pages.select(F.explode(F.array(F.struct(F.lit("hosts").alias("list"), host.alias("pattern"), F.lit(3).alias("every")), F.struct(F.lit("sections").alias("list"), F.when(F.regexp_extract("url", _SEGMENT, 1) != "", section).alias("pattern"), F.lit(7).alias("every")), F.struct(F.lit("adult").alias("list"), F.when(host.rlike("adult|casino|porn"), host).alias("pattern"), F.lit(1).alias("every")))).alias("e")).select("e.*").where("pattern is not null").distinct()
    n = _number(F.col("pattern"))
    start = F.when(F.col("list") == "adult", F.lit(0)).otherwise(F.expr("n div 7 % 300"))
    dated = named.withColumn("n", n).where("n % every = 0").withColumn("start", start)
    days = F.array(
        F.struct(F.col("start").alias("at"), F.lit(True).alias("listed")),
        F.struct(F.when((F.col("list") != "adult") & F.expr("n div 11 % 2 = 0"), F.expr("start + 10 + n div 13 % 60")).alias("at"), F.lit(False).alias("listed")),
        F.struct(F.when((F.col("list") != "adult") & F.expr("n div 11 % 4 = 0"), F.expr("start + 80 + n div 17 % 60")).alias("at"), F.lit(True).alias("listed")),
    )
    dated = dated.withColumn("d", F.explode(days)).where("d.at is not null")
    return dated.select("list", "pattern", F.timestamp_seconds(F.lit(1704067200) + F.col("d.at") * 86400).alias("day"), F.col("d.listed").alias("listed"))


#: DuckDB SQL for ``evaluate`` over ``page_captures`` and ``page_entries``.
PAGES_SQL = """
WITH parsed AS (
  SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS segment,
         make_timestamp((1704067200 + ((page_id * 37) % 527040) * 60) * 1000000) AS fetched, row_number() OVER () AS r
  FROM pages),
named AS (
  SELECT 'hosts' AS list, host AS pattern, 3 AS every FROM parsed
  UNION SELECT 'sections', host || '/' || segment, 7 FROM parsed
  UNION SELECT 'adult', host, 1 FROM parsed WHERE regexp_matches(host, 'adult|casino|porn')),
numbered AS (
  SELECT *, CASE WHEN list = 'adult' THEN 0 ELSE n // 7 % 300 END AS start
  FROM (SELECT *, ('0x' || substr(md5(pattern), 1, 7))::BIGINT AS n FROM named WHERE pattern IS NOT NULL) WHERE n % every = 0),
dated AS (
  SELECT list, pattern, start AS nth, true AS listed FROM numbered
  UNION ALL SELECT list, pattern, start + 10 + n // 13 % 60, false FROM numbered WHERE list <> 'adult' AND n // 11 % 2 = 0
  UNION ALL SELECT list, pattern, start + 80 + n // 17 % 60, true FROM numbered WHERE list <> 'adult' AND n // 11 % 4 = 0),
days AS (SELECT list, pattern, make_timestamp((1704067200 + nth * 86400) * 1000000) AS day, bool_or(listed) AS listed FROM dated GROUP BY ALL),
intervals AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM days),
probes AS (
  SELECT DISTINCT r, fetched, pattern FROM (
    SELECT r, fetched, unnest(list_transform(range(1, greatest(len(l), 2)), lambda i: array_to_string(l[i:], '.'))) AS pattern
    FROM (SELECT *, string_split(host, '.') AS l FROM parsed WHERE host IS NOT NULL)
    UNION ALL SELECT r, fetched, host || '/' || segment FROM parsed)
  WHERE pattern IS NOT NULL AND fetched IS NOT NULL),
hits AS (
  SELECT r, list_sort(list(DISTINCT list)) AS hit_lists, list_sort(list(DISTINCT p.pattern)) AS hit_patterns
  FROM probes p JOIN intervals i ON p.pattern = i.pattern AND i.listed AND p.fetched >= i.day AND (i.until IS NULL OR p.fetched < i.until) GROUP BY r)
SELECT page_id, coalesce(array_to_string(hit_lists, ','), '') AS hit_lists, coalesce(array_to_string(hit_patterns, ','), '') AS hit_patterns, hit_lists IS NOT NULL AS blocked
FROM parsed LEFT JOIN hits USING (r)
"""
