"""Page sources: tables of fetched pages, and a fetcher that runs on executors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "url string, final_url string, status int, html string, content_type string, etag string, last_modified string, error string"

#: (url, timeout) -> (status, final url, headers, body)
Get = Callable[[str, float], tuple[int, str, dict[str, str], str]]


def from_table(spark: SparkSession, path: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, html) of a Parquet table: only these two columns are read."""
    return spark.read.parquet(path).select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))


def is_web(url: Column) -> Column:
    return url.rlike("(?i)^https?://[^/?#]+")


def reachable(status: Column) -> Column:
    return status.between(200, 299)


def http_get(url: str, timeout: float) -> tuple[int, str, dict[str, str], str]:
    """A request with the standard library, which follows redirects."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "siltstone"}), timeout=timeout) as reply:
        return reply.status, reply.url, {k.lower(): v for k, v in reply.headers.items()}, reply.read().decode("utf-8", "replace")


def fetch(urls: DataFrame, get: Get = http_get, timeout: float = 30.0, retries: int = 3, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """One row for each of ``urls`` (url), in Arrow batches on executors; failures are rows with an error.

    URLs that are not http(s) and replies outside 2xx are errors; failed
    requests are tried again after ``base`` · 2^n seconds.
    """

    def one(url: str) -> tuple:
        if not url or not url.lower().startswith(("http://", "https://")):
            return (url, None, None, None, None, None, None, "not an http(s) URL")
        for attempt in range(retries + 1):
            try:
                status, final, head, body = get(url, timeout)
                error = None if 200 <= status <= 299 else f"status {status}"
                return (url, final, status, None if error else body, head.get("content-type"), head.get("etag"), head.get("last-modified"), error)
            except Exception as problem:
                error = str(problem)
                if attempt < retries:
                    sleep(base * 2**attempt)
        return (url, None, None, None, None, None, None, error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            yield pd.DataFrame([one(u) for u in batch["url"]], columns=names).astype({"status": "Int32"})

    return urls.select("url").mapInPandas(run, SCHEMA)
