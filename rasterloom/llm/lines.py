"""Line dedup by site-relative frequency.

A line that stands on a large share of a site's pages is the site's, not the
page's. Pages are grouped by host; for each line of a host, the pages that
contain it are divided by the host's pages, and lines above a ratio go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Markup without text, tags that end a line, all other tags; and a URL's host.
SILENT = r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>|<!--.*?-->"
BLOCK = (r"(?i)</?(html|head|title|body|nav|header|footer|main|aside|article|section|div|p|br|hr|ul|ol|li|dl|dt|dd|table|tr|td|th"
         r"|h[1-6]|pre|blockquote|form|option|button|label)\b[^>]*>")
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:]*)"


def lines_of(html: Column) -> Column:
    """The page's lines: text between block tags, single-spaced, without empty ones."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), SILENT, " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    lines = F.split(F.regexp_replace(text, r"[ \t\r\f\x0B]+", " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def host_of(url: Column) -> Column:
    """The lower-case host without www., or an empty string."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def drop_site_lines(pages: DataFrame, ratio: float = 0.2, least_pages: int = 3) -> DataFrame:
    """page_id, host, n_lines, n_dropped and kept (the other lines, in order) of each of ``pages(page_id, url, html)``.

    A line is dropped if it stands on at least ``least_pages`` of its host's
    pages and on more than ``ratio`` of them. A line's pages are counted once
    each, in as many tasks as read them, before they are shuffled; lines are
    told apart by 128-bit hashes. What goes is gathered by its place in the
    page and taken out by hashing, so that a page costs what it is long.

    A null page has no lines; pages without a host are one site. Every row
    counts as a page, repeated or of equal page_id.
    """
    split = common.written(pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id"), host_of(F.col("url").cast("string")).alias("host"),
        lines_of(F.col("html").cast("string")).alias("lines")), "page-lines")
    each = split.select("host", F.explode(F.array_distinct("lines")).alias("line")).select("host", _key(F.col("line")).alias("key"))
    totals = split.groupBy("host").agg(F.count("*").alias("pages"))
    common_lines = (each.groupBy("host", "key").agg(F.count("*").alias("on")).where(F.col("on") >= least_pages)
                    .join(totals, "host").where(F.col("on") > ratio * F.col("pages")).select("host", "key"))
    common_lines = common.written(common_lines, "site-lines")
    places = split.select("row", "host", F.posexplode("lines").alias("at", "line")).select("row", "host", "at", _key(F.col("line")).alias("key"))
    gone = places.join(common_lines, ["host", "key"]).groupBy("row").agg(F.collect_list("at").alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda at: F.get("lines", at)))
    return (split.join(gone, "row", "left").withColumn("kept", kept)
            .select("page_id", "host", F.size("lines").cast("long").alias("n_lines"),
                    (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), "kept"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_site_lines(common.table(spark, sf_dir, "pages"))
    return done.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, page_id,
    lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      coalesce(html, ''), '{SILENT}', ' ', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'),
      '[ \\t\\r\\f\\x0B]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
each AS (SELECT r, host, unnest(list_distinct(lines)) AS line FROM split),
totals AS (SELECT host, count(*) AS pages FROM split GROUP BY host),
site AS (
  SELECT host, line FROM (SELECT host, line, count(*) AS n FROM each GROUP BY host, line) JOIN totals USING (host)
  WHERE n >= 3 AND n > 0.2 * pages),
ordered AS (SELECT r, host, i, lines[i] AS line FROM split, unnest(range(1, len(lines) + 1)) AS t(i)),
kept AS (
  SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM ordered ANTI JOIN site USING (host, line) GROUP BY r)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped,
  sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""
