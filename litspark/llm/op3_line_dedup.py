"""Site-relative line frequency over web pages (DataFrame and SQL functions only).

A page's lines are its visible text between block tags. A line is boilerplate on a host when
the share of the host's pages that contain it exceeds ``MAX_RATIO`` and at least ``MIN_PAGES``
pages do; boilerplate lines are dropped.

Pages are cut into lines once and written with a row number; lines are counted as
digests, once per page, combined before the shuffle, so a line that a third of all pages carry is a
few rows per task. Boilerplate digests are joined back to (row, position), a join AQE can
split on a hot line, and the few hits are gathered per row; texts move once, by row number.

Defined results: null or empty html has no lines; a page without a host in its url (null, malformed)
keeps all lines; repeated pages count as pages and each gets its row; an empty table gives an empty
table; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, table, written

MAX_RATIO = 0.2
MIN_PAGES = 3

# Patterns, the same in Spark and in the SQL below.
INVISIBLE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK = (r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|nav|article|section|header|footer|br|hr|tr|td|th|table|title|head|body|html|main|"
         r"aside|blockquote|pre)\b[^>]*>")
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))


def lines(html: str = "html"):
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), INVISIBLE, "")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE))), lambda x: x != "")


def drop_site_lines(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(page_id, host, n_lines, n_dropped, text)`` per row of ``pages``: the lines that stay, joined by newlines."""
    cut = written(pages.select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("long").alias("page_id"),
                               host().alias("host"), lines().alias("lines")), "page-lines")
    keyed = cut.filter("host <> ''").select("uid", "host", F.transform("lines", lambda x: F.unhex(F.md5(x.cast("binary")))).alias("keys"))
    total = keyed.groupBy("host").agg(F.count("*").alias("pages"))
    found = (keyed.select("host", F.explode(F.array_distinct("keys")).alias("key")).groupBy("host", "key")
             .agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages))
    boiler = found.join(total, "host").filter(F.col("n") > F.col("pages") * F.lit(max_ratio)).select("host", "key")
    hits = (keyed.select("uid", "host", F.posexplode("keys").alias("pos", "key")).join(boiler, ["host", "key"], "left_semi")
            .groupBy("uid").agg(F.collect_list("pos").alias("drop")))
    stay = F.expr("transform(array_except(sequence(0, size(lines) - 1), drop), i -> lines[i])")
    return cut.join(hits, "uid", "left").select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.when(F.col("drop").isNull(), F.col("lines")).otherwise(stay), "\n").alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_site_lines(table(spark, sf_dir, "pages"))


_SQL_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH p AS (
  SELECT row_number() OVER () AS uid, page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
         list_filter(list_transform(string_split(
           regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{INVISIBLE}', '', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'),
           chr(10)), lambda x: trim(x, {_SQL_WHITE})), lambda x: x <> '') AS lines
  FROM pages),
l AS (SELECT uid, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM p),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT l.host, l.line FROM l JOIN t ON l.host = t.host WHERE l.host <> ''
      GROUP BY l.host, l.line, t.pages HAVING count(DISTINCT l.uid) >= {MIN_PAGES} AND count(DISTINCT l.uid) > t.pages * {MAX_RATIO}),
k AS (SELECT l.uid, count(b.line) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.line IS NULL), '') AS text
      FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line GROUP BY l.uid)
SELECT p.page_id, p.host, CAST(len(p.lines) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped, coalesce(k.text, '') AS text
FROM p LEFT JOIN k ON p.uid = k.uid
"""
