"""Embedders, and their execution over chunks."""

from __future__ import annotations

import threading
import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analyzer import analyze

#: Known models, their dimension and most tokens of an input.
MODELS = {
    "text-embedding-3-small": (1536, 8191),
    "text-embedding-3-large": (3072, 8191),
    "text-embedding-ada-002": (1536, 8191),
    "text-embedding-004": (768, 2048),
    "embedding-001": (768, 2048),
}
DEFAULT_MODEL = {"openai": "text-embedding-3-small", "google": "text-embedding-004", "hash": "hash-256"}


class Embedder(Protocol):
    """Texts to vectors; must be picklable, as it runs on executors."""

    name: str
    dimension: int
    batch: int

    def is_available(self) -> bool: ...

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...


@dataclass
class HashingEmbedder:
    """Signed hashes of stemmed terms, scaled to length one: the same everywhere, without a network."""

    dimension: int = 256
    name: str = "hash"
    batch: int = 256

    def is_available(self) -> bool:
        return True

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for term in analyze(text):
                h = zlib.crc32(term.encode())
                row[h % self.dimension] += 1 if h >> 31 else -1
            if n := np.linalg.norm(row):
                row /= n
        return out.tolist()


@dataclass
class NoEmbedder:
    """No vectors: chunks are stored with a null one."""

    name: str = "none"
    dimension: int = 0
    batch: int = 1

    def is_available(self) -> bool:
        return False

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        raise RuntimeError("no embedder is configured")


@dataclass
class ApiEmbedder:
    """An embedding service behind ``send(texts) -> [(index, vector)]``; results are ordered by index and fitted.

    ``send`` does the request: this library makes none of its own. A reply
    whose error mentions 429 is tried again after ``base`` · 2^n seconds.
    """

    send: Callable[[Sequence[str]], list[tuple[int, list[float]]]]
    dimension: int
    name: str = "api"
    batch: int = 64
    retries: int = 3
    base: float = 1.0
    sleep: Callable[[float], None] = time.sleep

    def is_available(self) -> bool:
        return True

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        for attempt in range(self.retries + 1):
            try:
                rows = sorted(self.send(texts))
                break
            except Exception as error:
                if "429" not in str(error) or attempt == self.retries:
                    raise
                self.sleep(self.base * 2**attempt)
        return [(v + [0.0] * self.dimension)[: self.dimension] for _, v in rows]


def parse_model(spec: str) -> tuple[str, str]:
    """(provider, model) of ``provider:model``; no prefix is openai, a bare provider its default model."""
    provider, sep, model = spec.partition(":")
    if not sep:
        if provider.lower() in DEFAULT_MODEL:
            return provider.lower(), DEFAULT_MODEL[provider.lower()]
        return "openai", spec
    return provider.lower(), model or DEFAULT_MODEL.get(provider.lower(), model)


def is_valid_dimension(model: str, dimension: int) -> bool:
    """Unknown models may have any."""
    return model not in MODELS or MODELS[model][0] == dimension


def create(spec: str, send=None) -> Embedder:
    """The embedder of a model spec; without a way to send requests, services give none."""
    provider, model = parse_model(spec)
    if provider == "hash":
        return HashingEmbedder(int(model.rpartition("-")[2]) if model.rpartition("-")[2].isdigit() else 256)
    if provider in ("openai", "google") and send:
        return ApiEmbedder(send, MODELS.get(model, (1536, 8191))[0], f"{provider}:{model}", 64 if provider == "openai" else 100)
    return NoEmbedder()


def embed(chunks: DataFrame, embedder: Embedder, text_col: str = "content") -> DataFrame:
    """``chunks`` with an ``embedding``; null without an embedder. Runs in Arrow batches on executors."""
    if not embedder.is_available():
        return chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    if isinstance(embedder, EmbeddingQueue):  # one limiter for all requests
        chunks = chunks.coalesce(1)

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return embedded(batches, embedder)

    return chunks.withColumn("embedding", vectors(F.col(text_col)))


def embedded(batches: Iterator[pa.Array], embedder: Embedder) -> Iterator[pa.Array]:
    """The vectors of batches of texts, a request's at a time: only those are held."""
    for texts in batches:
        for i in range(0, len(texts), embedder.batch):
            part = texts.slice(i, embedder.batch).to_pylist()
            yield pa.array(embedder.embed_batch([t or "" for t in part]), pa.list_(pa.float32()))


@dataclass
class RateLimiter:
    """Token buckets of requests and tokens per minute, and a least gap between requests.

    ``acquire`` returns how long the request had to wait. A request of more
    tokens than a minute allows takes a full bucket instead of waiting forever.
    """

    rpm: int = 1800
    tpm: int = 800_000
    gap: float = 0.15
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    requests: float = field(init=False)
    tokens: float = field(init=False)
    last: float = field(init=False)
    ready: float = field(init=False)

    def __post_init__(self):
        self.requests, self.tokens = float(self.rpm), float(self.tpm)
        self.last = self.ready = self.clock()

    def _refill(self, now: float) -> None:
        part = max(0.0, now - self.last) / 60
        self.requests = min(self.rpm, self.requests + part * self.rpm)
        self.tokens = min(self.tpm, self.tokens + part * self.tpm)
        self.last = now

    def acquire(self, tokens: int) -> float:
        tokens, begin = min(tokens, self.tpm), self.clock()
        while True:
            now = self.clock()
            self._refill(now)
            wait = max(
                self.ready - now,
                (1 - self.requests) * 60 / self.rpm if self.requests < 1 else 0,
                (tokens - self.tokens) * 60 / self.tpm if self.tokens < tokens else 0,
            )
            if wait <= 1e-9:
                break
            self.sleep(wait)
        self.requests -= 1
        self.tokens -= tokens
        self.ready = now + self.gap
        return now - begin


@dataclass
class EmbeddingQueue:
    """An embedder with one request at a time behind a limiter: ``embed`` runs it in one task."""

    embedder: Embedder
    limiter: RateLimiter = field(default_factory=RateLimiter)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "lock"}  # a lock stays where it is

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state, lock=threading.Lock())

    @property
    def name(self) -> str:
        return self.embedder.name

    @property
    def dimension(self) -> int:
        return self.embedder.dimension

    @property
    def batch(self) -> int:
        return self.embedder.batch

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        return self.embed(texts)

    def is_available(self) -> bool:
        return self.embedder.is_available()

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.embedder.batch):
            part = list(texts[i : i + self.embedder.batch])
            with self.lock:
                self.limiter.acquire(sum(estimate_tokens(t) for t in part))
                out += self.embedder.embed_batch(part)
        return out


def estimate_tokens(text: str) -> int:
    """The row form of ``functions.text.estimate_tokens``."""
    cjk = sum("\u4e00" <= c <= "\u9fff" or "\u3040" <= c <= "\u30ff" or "\uac00" <= c <= "\ud7af" for c in text)
    return max(1, cjk + max(1, (len(text) - cjk) // 4)) + 5


def request_body(style: str, model: str, texts: Sequence[str]) -> dict:
    """The JSON that a service of a known style takes."""
    if style == "google":
        return {"requests": [{"model": f"models/{model}", "content": {"parts": [{"text": t}]}} for t in texts]}
    return {"model": model, "input": list(texts)}


def reply_vectors(style: str, reply: dict) -> list[tuple[int, list[float]]]:
    """(index, vector) of a service's reply."""
    if style == "google":
        return [(i, e["values"]) for i, e in enumerate(reply["embeddings"])]
    return [(e["index"], e["embedding"]) for e in reply["data"]]


def simulate_limits(requests: DataFrame, key: str, at: str, tokens: str, rpm: int, tpm: int, gap: float = 0.15) -> DataFrame:
    """When each request of a key would be let through: (key, at, tokens, waited), a limiter per key."""
    kind = requests.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        now = [float(pdf["at"].iloc[0])]
        limiter = RateLimiter(rpm, tpm, gap, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
        waited = []
        for at_, n in zip(pdf["at"], pdf["tokens"], strict=True):
            now[0] = max(now[0], at_)
            arrived = at_
            limiter.acquire(int(n))
            waited.append(now[0] - arrived)
        return pdf.assign(waited=waited)[["key", "at", "tokens", "waited"]]

    rows = requests.select(F.col(key).alias("key"), F.col(at).cast("double").alias("at"), F.col(tokens).cast("long").alias("tokens"))
    return rows.groupBy("key").applyInPandas(run, f"key {kind}, at double, tokens long, waited double")
