"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate of a site when more than ``ratio`` of the site's pages contain it. Lines are
counted once a page by a 96-bit fingerprint, summed before the shuffle, so a hot site or a line that
every page repeats costs one row a task. A page adds 1/pages to each of its lines' ratios, so a site
has at most (its mean number of lines a page) / ratio boilerplate lines, however large it is: the sets
stay small, and pages get theirs by a join on the site. The join sends the sets to every executor only
if they were counted to be few; otherwise both sides shuffle and Spark splits hot sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.scratch import Scratch

BROADCAST_LINES = 50_000
RATIO, LEAST_PAGES = 0.1, 2


def _print(line: Column) -> Column:
    """A line's fingerprint as a string, which array functions hash."""
    return F.concat(F.hex(F.xxhash64(line)), F.lit("-"), F.hex(F.crc32(F.encode(line, "utf-8"))))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _prints(text: Column) -> Column:
    """Fingerprints of a page's different lines that are not blank."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _print))


def boilerplate_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = LEAST_PAGES) -> DataFrame:
    """(site, key) of every line of (site, text) on at least ``min_pages`` pages and more than ``ratio`` of its site's pages."""
    counts = (
        pages.select("site", F.explode(_prints(F.col("text"))).alias("key"))
        .groupBy("site", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    )
    totals = pages.groupBy(F.col("site").alias("t_site")).agg(F.count("*").alias("total"))
    return counts.join(totals, F.col("site").eqNullSafe(F.col("t_site"))).where(F.col("n") > ratio * F.col("total")).select("site", "key")


def site_of(pages: DataFrame, url: str = "url", source: str = "source") -> Column:
    """The host of a page's URL in lower case where the table has one that names a host, else the source."""
    if url not in pages.columns:
        return F.col(source).cast("string")
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host).otherwise(F.col(source).cast("string"))


def _cleaned(pages: DataFrame, site: Column, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(row, text, lines, dropped): each page as a struct, its kept text, and its numbers of lines and of dropped lines."""
    scratch = Scratch(pages.sparkSession, "line_dedup")
    packed = pages.select(F.struct("*").alias("row"), site.cast("string").alias("site"), F.col(text).cast("string").alias("text"))
    found = scratch.save(boilerplate_lines(packed.select("site", "text"), ratio, min_pages), "boilerplate")
    sets = found.groupBy(F.col("site").alias("k_site")).agg(F.collect_set("key").alias("keys"))
    if found.count() <= BROADCAST_LINES:
        sets = F.broadcast(sets)
    joined = packed.join(sets, F.col("site").eqNullSafe(F.col("k_site")), "left")
    # the page's own boilerplate lines are few; both arrays are hashed to find them
    joined = joined.withColumn("hits", F.when(F.col("keys").isNotNull(), F.array_intersect(_prints(F.col("text")), "keys")))
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("hits"), _print(x)))
    kept = F.when(F.coalesce(F.size("hits"), F.lit(0)) > 0, kept).otherwise(lines)
    count = lambda n: F.when(F.col("text").isNull(), 0).otherwise(n).cast("long")
    return joined.withColumn("kept", kept).select(
        "row", F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("text"),
        count(F.size(lines)).alias("lines"), count(F.size(lines) - F.size("kept")).alias("dropped"))


def drop_boilerplate(
    pages: DataFrame, site: str | Column = "source", text: str = "text", ratio: float = RATIO, min_pages: int = LEAST_PAGES,
) -> DataFrame:
    """``pages`` with columns ``ld_text`` (kept lines), ``ld_lines`` and ``ld_dropped`` (line counts) added.

    Lines are separated by U+000A and compared unchanged; blank lines are neither counted nor dropped.
    The ratio decides for sites of every size; a line on fewer than ``min_pages`` pages shows no repetition.
    A null text counts as empty and stays null. A null site is a site. Repeated rows are pages of their
    own. A page whose lines all go keeps an empty text. An empty table gives an empty result. Other columns
    pass through untouched; columns of the added names are replaced. A line exactly at the ratio stays. A
    very long text is one row; its different lines are counted once each.
    """
    out = _cleaned(pages, F.col(site) if isinstance(site, str) else site, text, ratio, min_pages)
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("ld_text", "ld_lines", "ld_dropped")]
    return out.select(*kept, F.col("text").alias("ld_text"), F.col("lines").alias("ld_lines"), F.col("dropped").alias("ld_dropped"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = drop_boilerplate(docs, site_of(docs))
    return out.select(
        "doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_dropped").alias("n_dropped"),
        F.sha2(F.encode(F.coalesce("ld_text", F.lit("")), "utf-8"), 256).alias("kept_sha256"),
    )


_BREAKS = r"(?i)<(?:/?(?:p|div|li|ul|ol|nav|br|h[1-6]|tr|td|th|table|section|article|header|footer|title|body|head|html|blockquote|pre))(?:\s[^>]*)?/?>"
_UNSEEN, _TAG = r"(?is)<(script|style)(?:\s[^>]*)?>.*?</(?:script|style)>", r"<[^>]*>"


def page_text(html: Column) -> Column:
    """The lines of a page: what stands between block elements, without scripts, styles and tags, trimmed; blank ones go."""
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _UNSEEN, "\n"), _BREAKS, "\n"), _TAG, "")
    return F.array_join(F.filter(F.transform(F.split(shown, "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def page_lines(spark, sf_dir: str) -> DataFrame:
    """Boilerplate of the host's pages taken out of every page: the same operator over web pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.lit(None).cast("string").alias("source"), page_text(F.col("html")).alias("text"))
    pages = pages.withColumn("host", site_of(pages))
    out = drop_boilerplate(pages, "host")
    return out.select(
        "page_id", "host", F.col("ld_lines").alias("n_lines"), F.col("ld_dropped").alias("n_dropped"),
        F.sha2(F.encode(F.coalesce("ld_text", F.lit("")), "utf-8"), 256).alias("kept_sha256"),
    )


def _line_sql(table: str, key: str, site: str) -> str:
    return f"""
WITH d AS (SELECT {key}, {site} AS site, coalesce(text, '') AS text, text IS NULL AS missing, row_number() OVER () AS rid FROM {table}),
lines AS (SELECT rid, site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
total AS (SELECT site, count(*) AS n FROM d GROUP BY site),
per AS (SELECT site, line, count(DISTINCT rid) AS n FROM lines WHERE trim(line) <> '' GROUP BY site, line),
bad AS (SELECT per.site, per.line FROM per JOIN total ON per.site IS NOT DISTINCT FROM total.site WHERE per.n >= 2 AND per.n > 0.1 * total.n),
marked AS (SELECT l.rid, l.pos, l.line, b.line IS NOT NULL AS drop_it FROM lines l LEFT JOIN bad b ON l.line = b.line AND l.site IS NOT DISTINCT FROM b.site)
SELECT d.{key}, d.site AS host, CASE WHEN d.missing THEN 0 ELSE count(*) END AS n_lines, CAST(count(*) FILTER (WHERE drop_it) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop_it), '')) AS kept_sha256
FROM marked JOIN d USING (rid) GROUP BY rid, d.{key}, d.site, d.missing
"""


_SHOWN = f"regexp_replace(regexp_replace(regexp_replace(html, '{_UNSEEN}', chr(10), 'g'), '{_BREAKS}', chr(10), 'g'), '{_TAG}', '', 'g')"
_HOST = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
_TEXT = f"array_to_string(list_filter(list_transform(string_split({_SHOWN}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"
PAGES_SQL = _line_sql(f"(SELECT page_id, {_HOST} AS host, {_TEXT} AS text FROM pages)", "page_id", "host")

OP7_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, text IS NULL AS missing, row_number() OVER () AS rid FROM documents),
lines AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
total AS (SELECT source, count(*) AS n FROM d GROUP BY source),
per AS (SELECT source, line, count(DISTINCT rid) AS n FROM lines WHERE trim(line) <> '' GROUP BY source, line),
bad AS (SELECT per.source, per.line FROM per JOIN total ON per.source IS NOT DISTINCT FROM total.source
        WHERE per.n >= 2 AND per.n > 0.1 * total.n),
marked AS (SELECT l.rid, l.pos, l.line, b.line IS NOT NULL AS drop_it
           FROM lines l LEFT JOIN bad b ON l.line = b.line AND l.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, CASE WHEN d.missing THEN 0 ELSE count(*) END AS n_lines,
       CAST(count(*) FILTER (WHERE drop_it) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop_it), '')) AS kept_sha256
FROM marked JOIN d USING (rid) GROUP BY rid, d.doc_id, d.missing
"""


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their site's boilerplate lines taken out; n_chars follows the new text.

    One row a row and the same columns, whatever their names. Null texts stay null with their n_chars, null
    sites are a site, repeated rows count as pages of their own, and an empty table stays empty. A line exactly
    at the ratio stays; a very long text is one row like others.
    """
    out = _cleaned(docs, site_of(docs), "text", RATIO, LEAST_PAGES)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        chars = F.when(F.col("dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("row")["n_chars"])
        new["n_chars"] = chars.cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
