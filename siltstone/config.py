"""Settings, with documented defaults; a TOML file may replace any of them."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class Store:
    path: str = "./data/warehouse"


@dataclass(frozen=True)
class Scraper:
    max_pages: int = 1000
    max_depth: int = 3
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Splitter:
    chunk_size: int = 1500
    chunk_overlap: int = 200


@dataclass(frozen=True)
class Embedding:
    model: str = "hash"
    dimension: int | None = None
    max_rpm: int = 1800
    max_tpm: int = 800_000
    min_delay_ms: int = 150
    max_retries: int = 3
    retry_base_ms: int = 1000


@dataclass(frozen=True)
class Search:
    limit: int = 10
    vector_weight: float = 0.5
    text_weight: float = 0.5
    rrf_k: int = 60
    overfetch: int = 3


@dataclass(frozen=True)
class Config:
    store: Store = field(default_factory=Store)
    scraper: Scraper = field(default_factory=Scraper)
    splitter: Splitter = field(default_factory=Splitter)
    embedding: Embedding = field(default_factory=Embedding)
    search: Search = field(default_factory=Search)


def merged(base, values: dict):
    """``base`` with ``values``; unknown names are an error."""
    known = {f.name for f in fields(base)}
    if extra := set(values) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    new = {}
    for k, v in values.items():
        old = getattr(base, k)
        new[k] = merged(old, v) if is_dataclass(old) else tuple(v) if isinstance(old, tuple) else v
    return replace(base, **new)


def from_file(path: str) -> Config:
    with open(path, "rb") as f:
        return merged(Config(), tomllib.load(f))
