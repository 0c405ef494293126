"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written

RATIO, MIN_PAGES = 0.3, 5
#: Boilerplate lines, over all sites, up to which their table is broadcast (16 bytes each).
BROADCAST_LINES = 100_000
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Markup that ends a line.
BLOCKS = "p|div|li|ul|ol|dl|dt|dd|h[1-6]|br|hr|tr|td|th|table|nav|article|section|header|footer|title|body|html|head|main|aside|blockquote|pre|form"


def html_lines(html: Column) -> Column:
    """Visible text of a page, a line for each block element; blank lines go.

    A script, style or comment that is not closed reaches to the end, and a tag
    holds no other <, so every pattern reads a page of any length once.
    """
    bare = F.regexp_replace(html, r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)", "")
    text = F.regexp_replace(F.regexp_replace(bare, rf"(?i)</?(?:{BLOCKS})\b[^<>]*>", "\n"), r"<[^<>]*>", "")
    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != ""), "\n")


def strip(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def key(line: Column) -> Column:
    """128 bits that stand for a line without its outer white space."""
    return F.unhex(F.md5(strip(line)))


def boilerplate(rows: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(site, lines): keys of lines on over ``ratio`` of a site's pages.

    From (site, text). Each page gives each of its lines once; counts are summed
    before and after the shuffle, so a hot site or line costs one row per task.
    A site's list holds at most (distinct lines per page) / ratio keys.
    """
    per_page = F.transform(F.array_distinct(F.filter(F.transform(F.split("text", "\n", -1), strip), lambda x: x != "")), key)
    counted = rows.select("site", F.explode(per_page).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n"))
    totals = rows.groupBy("site").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    t = totals.select(F.col("site").alias("t_site"), "pages")
    return (
        counted.filter(F.col("n") > ratio * min_pages)
        .join(t, F.col("site").eqNullSafe(F.col("t_site")))
        .filter(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("site")
        .agg(F.collect_set("line").alias("lines"))
    )


def drop_boilerplate(
    df: DataFrame,
    site: Column,
    text: Column,
    keep: Column,
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    counted: DataFrame | None = None,
) -> DataFrame:
    """(keep, site, text, n_lines, n_dropped) for every row of ``df``.

    A line (split at \\n, outer white space aside) goes if over ``ratio`` of its
    site's pages have it; sites of fewer than ``min_pages`` pages lose none.
    Pages are the rows of ``counted`` (site, text), if given, such as one for
    each group of copies; else all rows are. Blank lines are never counted or dropped. Null text stays null, with no
    lines; a null site is a site of its own; repeated rows count as pages; a
    page or line of any length is read whole. The input's columns are read only through ``site``, ``text`` and ``keep``, so
    any names may occur.
    """
    pages = counted if counted is not None else df.select(site.alias("site"), text.alias("text"))
    found = Written(boilerplate(pages, ratio, min_pages), "lines-boilerplate").df.select(F.col("site").alias("b_site"), "lines")
    n = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    found = F.broadcast(found) if n <= BROADCAST_LINES else found
    rows = df.select(keep.alias("keep"), site.alias("site"), text.alias("text"))
    split = F.split("text", "\n", -1)
    rest = F.filter(split, lambda x: ~F.array_contains(F.col("lines"), key(x)))
    joined = rows.join(found, F.col("site").eqNullSafe(F.col("b_site")), "left").withColumn(
        "rest", F.when(F.col("lines").isNull(), split).otherwise(rest)
    )
    n_lines = F.coalesce(F.size(split), F.lit(0))
    return joined.select(
        "keep",
        "site",
        F.array_join("rest", "\n").alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines - F.size("rest")).cast("long").alias("n_dropped"),
    )
