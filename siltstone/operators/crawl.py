"""Crawl as breadth-first search over a page source: a level at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..session import shared_root


@dataclass(frozen=True)
class CrawlOptions:
    max_pages: int = 1000
    max_depth: int = 3
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, options: dict) -> CrawlOptions:
        """Of stored options; missing ones take defaults, patterns that do not compile are dropped."""
        own = {k: options[k] for k in ("max_pages", "max_depth") if options.get(k) is not None}
        for ours, theirs in (("include", "include_patterns"), ("exclude", "exclude_patterns")):
            own[ours] = tuple(urls.valid_patterns(options.get(theirs) or []))
        return cls(**own)


def process(pages: DataFrame) -> DataFrame:
    """Pages (url, html, …) with Markdown, title and links. A page that cannot be read has ``error`` and no content."""
    page = html.markdown_column(F.col("html"))
    return pages.withColumn("page", page).select(
        "*", F.col("page.title").alias("title"), F.col("page.content").alias("content"), F.col("page.error").alias("error"), html.links_column(F.col("html"), F.col("url")).alias("links")
    ).drop("page")


def frontier(links: DataFrame, visited: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Different URLs that were not visited and are wanted."""
    new = links.select("url").filter(F.col("url").isNotNull())
    if wanted is not None:
        new = new.filter(wanted)
    return new.distinct().join(visited.select("url"), "url", "left_anti")


def crawl_page(pages: DataFrame, url: str) -> DataFrame:
    """A single page (url, depth 0, title, content, links)."""
    return process(pages.select("url", "html").filter(F.col("url") == url)).select("url", F.lit(0).alias("depth"), "title", "content", F.col("links.url").alias("links"))


#: What a fetched page may carry besides; null where a source has none.
HEADERS = ("etag", "last_modified", "content_type")
LEVEL = "url string, depth int, title string, content string, links array<string>, " + ", ".join(f"{c} string" for c in HEADERS)


def levels(pages: DataFrame, start: str, options: CrawlOptions = CrawlOptions(), cancelled: Callable[[], bool] = lambda: False) -> Iterator[tuple[DataFrame, int]]:
    """The crawl a level at a time: (pages of the level, their number), as soon as each is done.

    Each level is one distributed step: frontier joined to pages, links
    extracted, visited URLs removed by an anti-join. Levels are written to a
    shared folder, so plans stay short.
    """
    spark = pages.sparkSession
    root = f"{shared_root(spark)}/siltstone/crawl-{uuid.uuid4().hex}"
    home = spark.range(1).select(urls.host(F.lit(start)).alias("h")).first()[0]
    source = pages.select("url", "html", *[F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in HEADERS])
    wanted = urls.wanted(F.col("url"), home, list(options.include), list(options.exclude))
    now = seen = spark.createDataFrame([(start,)], "url string")
    left = options.max_pages
    for depth in range(options.max_depth + 1):
        if left <= 0 or cancelled():
            return
        level = process(source.join(now, "url", "left_semi").orderBy("url").limit(left))
        level.select("url", F.lit(depth).alias("depth"), "title", "content", F.col("links.url").alias("links"), *HEADERS).write.parquet(f"{root}/{depth}")
        done = spark.read.schema(LEVEL).parquet(f"{root}/{depth}")
        n = done.count()
        yield done, n
        left -= n
        if not n or depth == options.max_depth:
            return
        frontier(done.select(F.explode("links").alias("url")), seen, wanted).write.parquet(f"{root}/next-{depth}")
        now = spark.read.schema("url string").parquet(f"{root}/next-{depth}")
        seen = seen.unionByName(now)


def crawl(
    pages: DataFrame,
    start: str,
    options: CrawlOptions = CrawlOptions(),
    on_level: Callable[[int, int], None] | None = None,
    cancelled: Callable[[], bool] = lambda: False,
) -> DataFrame:
    """(url, depth, title, content, ``HEADERS``) of pages reachable from ``start``, by depth, then URL.

    ``pages`` (url, html) is any source of fetched pages. ``max_pages`` counts
    pages that exist; a page at ``max_depth`` is kept, its links are not
    followed. URLs keep their fragments.
    """
    out = pages.sparkSession.createDataFrame([], LEVEL)
    for depth, (level, n) in enumerate(levels(pages, start, options, cancelled)):
        out = out.unionByName(level)
        if on_level:
            on_level(depth, n)
    return out.drop("links").orderBy("depth", "url")
