"""Line dedup by site-relative frequency.

A line is boilerplate of a host if at least ``min_pages`` of its pages hold it
and they make up more than ``ratio`` of the host's pages. A line on one page
alone is none, however few pages the host has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, without

#: White space at the ends of a line doesn't count.
TRIMMED = " \t\x0b\x0c\r"
#: A table of boilerplate lines with up to this many lines is broadcast; a larger one is joined by a shuffle.
BROADCAST_LINES = 500_000


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(TRIMMED))


def boilerplate_lines(pages: DataFrame, ratio: float, min_pages: int, copies_as_one: bool) -> DataFrame:
    """``(host, lines)``: hashes of the boilerplate lines of each host that has any.

    ``pages`` holds host and text. A host has fewer of them than lines on an
    average page divided by ``ratio``, so the arrays are small. Only hashes are
    shuffled, and counts are added up before.
    """
    own = F.filter(F.transform(F.split("text", "\n"), trimmed), lambda x: x != "")
    hashed = pages.select("host", F.xxhash64("text").alias("page"), F.array_distinct(F.transform(own, lambda x: F.xxhash64(x))).alias("lines"))
    if copies_as_one:
        hashed = materialise(hashed.groupBy("host", "page").agg(F.first("lines").alias("lines")), "pages")
    totals = (hashed if copies_as_one else pages).groupBy("host").agg(F.count("*").alias("total"))
    lines = hashed.select("host", F.explode("lines").alias("line"))
    common = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = totals.select(F.col("host").alias("of"), "total")
    common = common.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.col("total") * ratio)
    return common.groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(
    docs: DataFrame, text_col: str = "text", host: Column | str = "source", ratio: float = 0.1, min_pages: int = 2, copies_as_one: bool = False
) -> DataFrame:
    """``docs`` without the boilerplate lines of each row's host; counts in ``lines_seen`` and ``lines_dropped``.

    Lines are cut at line feeds; blank lines stay and aren't counted. A text of
    which no line stays becomes empty, a null text stays null and is no page.
    Texts of any length are read whole. Rows without a host make up a host of
    their own. Repeated rows all stay, and each is a page; with
    ``copies_as_one`` those of equal text count as one page, so that a page of
    many copies doesn't lose its own lines. An empty table gives no rows.
    Columns of the two new names are replaced.
    """
    docs = without(docs, ["lines_seen", "lines_dropped"], [text_col])
    names = docs.columns
    site = F.col(host) if isinstance(host, str) else host
    own = docs.select("*", site.cast("string").alias("_site")).toDF(*(f"c{i}" for i in range(len(names))), "host")
    text = f"c{names.index(text_col)}"
    found = materialise(boilerplate_lines(own.select("host", F.col(text).alias("text")).where("text is not null"), ratio, min_pages, copies_as_one), "boilerplate")
    n = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    found = found.select(F.col("host").alias("of"), F.col("lines").alias("drop"))
    if n <= BROADCAST_LINES:
        found = F.broadcast(found)
    joined = own.join(found, F.col("host").eqNullSafe(F.col("of")), "left")
    lines = F.split(text, "\n")
    stay = F.filter(lines, lambda x: (trimmed(x) == "") | ~F.array_contains("drop", F.xxhash64(trimmed(x))))
    seen = F.size(F.filter(lines, lambda x: trimmed(x) != ""))
    kept = F.when(F.col("drop").isNull(), lines).otherwise(stay)
    left = joined.withColumn("kept", kept)
    out = left.select(
        *(F.array_join("kept", "\n").alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(names)),
        F.coalesce(F.when(F.col(text).isNotNull(), seen), F.lit(0)).alias("lines_seen"),
        F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines) - F.size("kept")), F.lit(0)).alias("lines_dropped"),
    )
    return out


def html_text(html: Column) -> Column:
    """A page's text: scripts, styles and comments go, block tags become line ends, other tags nothing."""
    html = F.regexp_replace(F.regexp_replace(html, NO_TEXT, " "), BLOCK_TAG, "\n")
    return F.regexp_replace(html, "<[^>]*>", "")


NO_TEXT = "(?is)<(?:script[^>]*>.*?</script>|style[^>]*>.*?</style>|!--.*?-->)"
BLOCK_TAG = "(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[ \\t\\n/][^>]*)?>"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def url_host(url: Column) -> Column:
    """The lower-case host of a URL, null if there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def pages_sql(ratio: float = 0.1, min_pages: int = 2) -> str:
    """DuckDB SQL for ``drop_boilerplate`` over the texts of the table pages."""
    text = f"regexp_replace(html, '{NO_TEXT}', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{BLOCK_TAG}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    trim = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH texts AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, {text} AS text, row_number() OVER () AS r FROM pages),
lines AS (
  SELECT r, host, text, pos, line, {trim} AS own
  FROM (SELECT r, host, text, generate_subscripts(s, 1) AS pos, unnest(s) AS line FROM (SELECT *, string_split(text, chr(10)) AS s FROM texts WHERE text IS NOT NULL))),
totals AS (SELECT host, count(*) AS total FROM texts WHERE text IS NOT NULL GROUP BY host),
common AS (SELECT host, own, count(DISTINCT r) AS n FROM lines WHERE own <> '' GROUP BY host, own HAVING count(DISTINCT r) >= {min_pages}),
boilerplate AS (SELECT c.host, c.own FROM common c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host WHERE n > total * {ratio}::DOUBLE),
marked AS (SELECT l.*, b.own IS NOT NULL AS gone FROM lines l LEFT JOIN boilerplate b ON l.host IS NOT DISTINCT FROM b.host AND l.own = b.own),
kept AS (
  SELECT r, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept,
         count(*) FILTER (own <> '') AS lines_seen, count(*) FILTER (gone) AS lines_dropped
  FROM marked GROUP BY r)
SELECT page_id, host, kept AS text, coalesce(lines_seen, 0)::INTEGER AS lines_seen, coalesce(lines_dropped, 0)::INTEGER AS lines_dropped
FROM texts LEFT JOIN kept USING (r)
"""
