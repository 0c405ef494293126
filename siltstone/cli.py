"""Command line: scrape, search, list, remove over a warehouse folder."""

from __future__ import annotations

import argparse

from .engine import Engine
from .operators.crawl import CrawlOptions
from .operators.embedding import create
from .operators.retrieval import SearchOptions
from .session import get_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("-d", "--database", default="./data/warehouse")
    p.add_argument("-m", "--model", default="hash")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scrape", help="index pages of a Parquet table (url, html) reachable from a URL")
    s.add_argument("library")
    s.add_argument("url")
    s.add_argument("--pages", required=True)
    s.add_argument("--version", default="")
    s.add_argument("--max-pages", type=int, default=1000)
    s.add_argument("--max-depth", type=int, default=3)
    s = sub.add_parser("search")
    s.add_argument("library")
    s.add_argument("query")
    s.add_argument("--version")
    s.add_argument("--limit", type=int, default=10)
    sub.add_parser("list")
    s = sub.add_parser("remove")
    s.add_argument("library")
    s.add_argument("--version")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = get_session("siltstone-cli")
    engine = Engine(spark, a.database, create(a.model))
    if a.command == "scrape":
        job = engine.scrape(a.library, a.version, spark.read.parquet(a.pages), a.url, CrawlOptions(a.max_pages, a.max_depth))
        print(engine.manager.wait(job.id).status)
    elif a.command == "search":
        print(engine.search_text(a.library, a.query, version=a.version, options=SearchOptions(limit=a.limit)))
    elif a.command == "list":
        for r in engine.list_libraries().collect():
            print(f"{r['library']} {r['version'] or '(unversioned)'}: {r['status']}, {r['page_count']} pages")
    elif not engine.remove(a.library, a.version):
        print(f"{a.library}: not found")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
