"""Secret scans: a trigram inverted index over blocks of documents picks what each rule verifies."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of, short_batches
from .trigrams import query_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Of the matches, those whose ``group`` has ``least`` characters count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False  # letters in either case (ASCII)
    base: bool = False
    compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0)))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if len(m[self.group]) >= self.least]


#: The base kinds, then formats of well-known credentials.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, base=True),
    Rule("hex", r"[0-9a-f]+", 0, 32, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{6,64}@"),
)

#: Characters of a block, whose postings one task holds at a time (a longer text is its own block).
BLOCK_CHARS = 2_000_000


class Index:
    """Postings of the trigrams that the rules ask for, over one block of documents."""

    def __init__(self, rules: Sequence[Rule]):
        self.queries = [query_of(r.pattern) for r in rules]
        wanted = sorted({t for q in self.queries for member in q for alt in member for t in alt if t.isascii()})
        self.number = {t: i for i, t in enumerate(wanted)}
        self.codes = np.array([int.from_bytes(t.encode(), "big") for t in wanted] or [1 << 30], dtype=np.int32)
        self.order = np.argsort(self.codes)
        self.table = np.full(1 << 24, -1, dtype=np.int16)
        self.table[self.codes[self.codes < 1 << 24]] = np.flatnonzero(self.codes < 1 << 24).astype(np.int16)
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        self.fold = fold

    def postings(self, texts: list[str]) -> np.ndarray:
        """A row of documents for each wanted trigram."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        b = self.fold[np.frombuffer(b"\x00".join(raw) + b"\x00", dtype=np.uint8)].astype(np.int32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:] if len(b) > 2 else np.empty(0, np.int32)
        which = self.table[code]
        at = np.flatnonzero(which >= 0)
        found = np.zeros((len(self.number) or 1, len(texts)), dtype=bool)
        found[which[at], np.searchsorted(ends, at, side="right")] = True
        return found

    def candidates(self, n: int, posted: np.ndarray, rule: int) -> np.ndarray:
        """Documents that satisfy the rule's query; all, if it has no mandatory trigram."""
        hit = np.ones(n, dtype=bool)
        for member in self.queries[rule]:
            if all(t in self.number for alt in member for t in alt):
                hit &= np.any([np.all([posted[self.number[t]] for t in alt], axis=0) for alt in member], axis=0)
        return np.flatnonzero(hit)


def scan_block(texts: list[str], rules: Sequence[Rule], index: Index) -> list[list[tuple[int, int, int]]]:
    """Per document: (start, rule, end) in code points, by start, then rule."""
    posted = index.postings(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, rule in enumerate(rules):
        for i in index.candidates(len(texts), posted, k):
            out[i] += [(s, k, e) for s, e in rule.spans(texts[i])]
    return [sorted(x) for x in out]


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Sequence[Rule] = RULES,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id, spans array<struct<kind,start,end>>) for every row of ``docs``.

    Documents are indexed in blocks, as segments of a search index are: each
    task holds the postings of one block at a time, so nothing is shuffled and
    memory is bounded by a block. A rule's candidates are then searched whole.
    Null and empty texts have no spans; a text longer than a block is one of
    its own, and every rule reads it in time that grows with its length; spans
    of one kind do not overlap, those of different kinds may; repeated rows get equal spans; other columns are
    not read.
    """
    short_batches(docs.sparkSession)
    kept = tuple((r.kind, r.pattern, r.group, r.least, r.fold, r.base) for r in rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Rule(*r) for r in kept]
        index = Index(own)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def out(ids: list, texts: list[str]) -> pa.RecordBatch:
            found = [[{"kind": own[k].kind, "start": s, "end": e} for s, k, e in x] for x in scan_block(texts, own, index)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], ["doc_id", "spans"])

        ids: list = []
        texts: list[str] = []
        held = 0
        for some_ids, some in rows_of(batches, "doc_id", "text"):
            for i, t in zip(some_ids, some, strict=True):
                ids.append(i)
                texts.append(t or "")
                held += len(texts[-1])
                if held >= block_chars:
                    yield out(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield out(ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    base = [r.kind for r in rules if r.base]
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(
        "doc_id",
        *[n(k) for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
