"""Quality rules: counts over words and lines, and repetition found with a suffix array."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of, short_batches

#: Words of a window whose second occurrence is a repeat.
WINDOW = 8
#: Words of the shortest repeat whose characters count as covered.
SHORT = 3
#: Bytes of text whose suffixes are sorted together (a longer text is sorted alone).
BLOCK_BYTES = 1_500_000


@dataclass(frozen=True)
class Limits:
    """A document passes with at least ``words`` words and at most these repeats.

    ``window_percent`` bounds the words in repeated windows. ``covered`` bounds
    the fraction of characters of words under maximal repeats from ``SHORT``
    words on, and ``longest`` the longest repeat (of a window or more) as a
    fraction of the document's words. Both bind below the window's limit: a
    passage that comes twice covers twice its length.
    """

    words: int = 20
    window_percent: int = 30
    covered: float = 0.2
    longest: float = 0.08


def suffix_repeats(words: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word of a block of documents, the length of the longest repeat that begins there.

    ``words`` are numbers of words, ``ends`` where documents end (exclusive,
    ascending). A repeat occurs at least twice in its document and has at least
    ``window`` words; other words get 0.

    The suffix array keeps the suffixes that matter: those whose first
    ``window`` words occur elsewhere in the document. They are sorted by these
    words, then by prefix doubling; a suffix whose rank is already unique is
    never compared again. The longest common prefix with either neighbour in
    the order is the longest repeat that begins at a suffix: the largest of the
    LCP intervals that hold it. An interval's substring repeats once for each
    of its suffixes, so spans of these lengths cover what all maximal repeats
    cover.
    """
    n = len(words)
    longest = np.zeros(n, dtype=np.int64)
    if n < 2:
        return longest
    doc = np.searchsorted(ends, np.arange(n), side="right")
    end_of = ends[doc]
    # Equality classes of windows, by doubling: only their repeats are sorted.
    classes = _dense(doc.astype(np.int64) << 32 | words)
    h = 1
    while h < window:
        step = min(h, window - h)
        ahead = np.full(n, -1, dtype=np.int64)
        ahead[: n - step] = classes[step:]
        classes = _dense((classes << 32) + ahead + 1)
        h += step
    at = np.flatnonzero(np.arange(n) + window <= end_of)
    if not len(at):
        return longest
    counts = np.bincount(classes[at], minlength=1)
    active = at[counts[classes[at]] > 1]
    if not len(active):
        return longest

    # Positions whose order is needed: active ones and where their windows end.
    tail = active + window
    keep = np.union1d(active, tail[tail < end_of[active]])
    columns = []
    for j in range(window):
        p = keep + j
        inside = p < end_of[keep]
        columns.append(np.where(inside, words[np.minimum(p, n - 1)], -1))
    order = np.lexsort([*columns[::-1], doc[keep]])
    new = np.zeros(len(keep), dtype=bool)
    new[0] = True
    for col in [doc[keep], *columns]:
        new[1:] |= col[order][1:] != col[order][:-1]
    rank = np.empty(len(keep), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    levels = [(window, rank)]
    h = window
    while True:
        size = np.bincount(rank)
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            break
        nxt = keep[tied] + h
        where = np.searchsorted(keep, nxt)
        where_in = np.minimum(where, len(keep) - 1)
        valid = (nxt < end_of[keep[tied]]) & (keep[where_in] == nxt)
        second = np.where(valid, rank[where_in], -1)
        o = np.lexsort([second, rank[tied]])
        t, s = tied[o], second[o]
        first = np.ones(len(t), dtype=bool)
        first[1:] = rank[t][1:] != rank[t][:-1]
        split = first.copy()
        split[1:] |= s[1:] != s[:-1]
        # Rank = the class's first place in the order, so that ranks stay sorted.
        starts = np.cumsum(size) - size
        base = starts[rank]
        fresh = base.copy()
        run = np.arange(len(t))
        group_start = np.maximum.accumulate(np.where(first, run, 0))
        part_start = np.maximum.accumulate(np.where(split, run, 0))
        fresh[t] = base[t] + part_start - group_start
        if h > n:
            break
        rank = _rerank(fresh)
        h *= 2
        levels.append((h, rank))
    sa = keep[np.argsort(rank, kind="stable")]
    lcp = _common(sa, keep, levels, words, end_of, doc)
    best = np.zeros(len(sa), dtype=np.int64)
    best[1:] = lcp
    best[:-1] = np.maximum(best[:-1], lcp)
    best[best < window] = 0
    longest[sa] = best
    return longest


def _dense(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 for equal values, in no order."""
    return pd.factorize(x)[0].astype(np.int64)


def _rerank(x: np.ndarray) -> np.ndarray:
    seen = np.zeros(int(x.max()) + 1, dtype=np.int64)
    seen[x] = 1
    return (np.cumsum(seen) - 1)[x]


def _common(sa, keep, levels, words, end_of, doc) -> np.ndarray:
    """Longest common prefixes of neighbours in the order, from the doubling's ranks."""
    a, b = sa[:-1].copy(), sa[1:].copy()
    same = doc[a] == doc[b]
    lcp = np.zeros(len(a), dtype=np.int64)
    for h, rank in reversed(levels):
        i, j = np.searchsorted(keep, a), np.searchsorted(keep, b)
        i, j = np.minimum(i, len(keep) - 1), np.minimum(j, len(keep) - 1)
        # A class of level h has equal first h words only where both reach that far.
        eq = same & (keep[i] == a) & (keep[j] == b) & (rank[i] == rank[j]) & (a + h <= end_of[sa[:-1]]) & (b + h <= end_of[sa[1:]])
        lcp[eq] += h
        a[eq] += h
        b[eq] += h
    last = len(words) - 1
    for _ in range(levels[0][0]):  # what is left is shorter than a window
        eq = same & (a < end_of[sa[:-1]]) & (b < end_of[sa[1:]]) & (words[np.minimum(a, last)] == words[np.minimum(b, last)])
        if not eq.any():
            break
        same &= eq
        lcp[eq] += 1
        a[eq] += 1
        b[eq] += 1
    return lcp


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a union of spans."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta)[:n] > 0


def measure(texts: list[str], window: int = WINDOW, short: int = SHORT) -> dict[str, np.ndarray]:
    """Counts of each text of a block."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    split = [r.split() for r in raw]  # bytes split at \x20 and \x09-\x0D, and nothing else
    counts = np.array([len(s) for s in split], dtype=np.int64)
    ends = np.cumsum(counts)
    begins = ends - counts
    number: dict[bytes, int] = {}
    put = number.setdefault
    words = np.fromiter((put(w, len(number)) for s in split for w in s), dtype=np.int64, count=int(ends[-1]) if len(ends) else 0)
    size_of = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in number), dtype=np.int64, count=len(number))
    sizes = size_of[words] if len(words) else np.zeros(0, dtype=np.int64)
    longest = suffix_repeats(words, ends, min(short, window))
    any_ = np.flatnonzero(longest)
    under = covered(any_, longest[any_], len(words))
    starts = np.flatnonzero(longest >= window)
    inside = covered(starts, longest[starts], len(words))

    def per_doc(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return total[ends] - total[begins]

    top = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(top, np.searchsorted(ends, starts, side="right"), longest[starts])
    return {
        "n_words": counts,
        "word_chars": per_doc(sizes),
        "n_symbols": np.array([len(r) - len(r.translate(None, b"#*$%&|<>")) for r in raw], dtype=np.int64),
        "n_dup_lines": np.array([dup_lines(r) for r in raw], dtype=np.int64),
        "n_repeat_words": per_doc(inside),
        "repeat_chars": per_doc(np.where(under, sizes, 0)),
        "longest_repeat": top,
    }


def dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None, limits: Limits = Limits()) -> DataFrame:
    """(id, the counts, base_failed, kept, ``keep``) for every row of ``docs``.

    ``kept`` is false for a document that fails the base rules, has over
    ``limits.covered`` of its characters under maximal repeats, or a repeat too
    long for it. Null and empty texts have no words, so they fail; a text of
    any length is sorted whole, alone in its block if it is long. Each document is judged on its own whole text, so repeated rows get equal rows
    and nothing is shuffled; only the named columns are read, and ``keep``
    carries what the caller needs.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([keep.alias("keep")] if keep is not None else [])
    )
    types = ", ".join(f"{n} long" for n in ("doc_id", *NAMES))
    if keep is not None:
        types += f", keep {rows.schema['keep'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: pa.RecordBatch) -> pa.RecordBatch:
            found = measure([t or "" for t in part.column("text").to_pylist()])
            columns = [part.column("doc_id"), *[pa.array(found[n]) for n in NAMES]]
            names = ["doc_id", *NAMES]
            if "keep" in part.schema.names:
                columns.append(part.column("keep"))
                names.append("keep")
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            text = batch.column("text")
            if not batch.num_rows:
                continue
            # Cut a batch where its bytes reach a block.
            lengths = np.array([len(t.as_py() or "") if t.is_valid else 0 for t in text]) if text.nbytes > BLOCK_BYTES else None
            if lengths is None:
                yield out(batch)
                continue
            begin, held = 0, 0
            for i, x in enumerate(lengths):
                if held and held + x > BLOCK_BYTES:
                    yield out(batch.slice(begin, i - begin))
                    begin, held = i, 0
                held += int(x)
            yield out(batch.slice(begin))

    c = F.col
    failed = (c("n_words") < limits.words) | (100 * c("n_repeat_words") > limits.window_percent * c("n_words"))
    spread = c("repeat_chars") > F.lit(limits.covered) * c("word_chars")
    long_one = c("longest_repeat") > F.lit(limits.longest) * c("n_words")
    return rows.mapInArrow(run, types).withColumn("base_failed", failed).withColumn("kept", ~(failed | spread | long_one))
