"""Queries over pages whose titles and headings end within a character reference, against their SQL."""

import os

import pandas as pd
import pytest

from siltstone.plans import registry
from siltstone.session import TABLES
from tests.compare import same_rows


@pytest.fixture(scope="module")
def cut(sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("cut")
    for t in TABLES:
        if t != "pages":
            os.symlink(f"{sf}/{t}.parquet", root / f"{t}.parquet")
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    for mark in ("</title>", "</h1>"):
        pages["html"] = pages["html"].str.replace(mark, f" &amp;&amp{mark}", regex=False)
    pages.to_parquet(root / "pages.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["extract_title", "html_to_markdown", "index_pages", "main_text", "process_pages", "split_markdown"])
def test_query_equals_sql(spark, cut, name):
    same_rows(registry.queries()[name](spark, cut), registry.oracle_sql()[name], cut)
