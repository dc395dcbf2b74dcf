"""Web pages as rows: elements, links and visible text lines, by patterns that leave markup's nesting aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAGS = r"<([a-zA-Z][a-zA-Z0-9]*)(?:[^>]*)>"


def plain(html: Column) -> Column:
    """The page without comments, scripts, styles and titles; block tags become line feeds, others go."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|title)\b[^>]*>.*?</\1>", "")
    lines = F.regexp_replace(bare, r"(?i)</?(p|div|h[1-6]|li|ul|ol|br|tr|td|article|nav|footer|section|table)\b[^>]*>", "\n")
    return F.regexp_replace(lines, r"<[^>]*>", "")


def elements_by_tag(pages: DataFrame) -> DataFrame:
    """Start tags of each kind over all pages, and their share of all. Tags are counted within each task before the shuffle."""
    tags = pages.select(F.explode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(1))).alias("tag")).select(F.lower("tag").alias("tag"))
    counts = tags.groupBy("tag").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("tag", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def links(pages: DataFrame) -> DataFrame:
    """Links of each page in order, at most 100, with their text of at most 120 characters."""
    found = F.slice(F.regexp_extract_all("html", F.lit(r"<a\b[^>]*>[^<]*</a>"), F.lit(0)), 1, 100)
    rows = pages.select("page_id", F.posexplode(found).alias("ordinal", "a"))
    return rows.select("page_id", "ordinal", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), F.left(F.trim(F.regexp_replace("a", "<[^>]*>", "")), F.lit(120)).alias("label"))
