"""SimHash near-dedup: fingerprints, and links found with tables of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, short_batches, small
from .graph import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Reference fingerprints: fixed by a generator, so every task has the same.
PIVOTS = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 24, dtype=np.uint64)
#: Fingerprints compared in one unit; larger groups are cut into pairs of blocks.
UNIT = 16_384
#: (blocks, intact): fingerprints within DISTANCE bits agree on ``intact`` of ``blocks``.
LAYOUTS = ((6, 2), (7, 3), (8, 4))
#: Fingerprints that agree on a key by chance, from which the next layout is used.
BY_CHANCE = 32
#: Keys of groups over UNIT, up to which their table is broadcast (24 bytes each).
BROADCAST_KEYS = 100_000


def fingerprint(text: str | None) -> int:
    """64 bits: set where over half the hashes of 4-word shingles have a one. No words: zero."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    last = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 14):
        bits = np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): fp as a signed long."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def masks(blocks: int, intact: int) -> list[int]:
    """The bits of each choice of intact blocks, as signed longs."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    of = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(of[i] for i in c)) for c in combinations(range(blocks), intact)]


def layout(n: int) -> tuple[int, int]:
    for blocks, intact in LAYOUTS:
        if n >> (64 * intact // blocks) < BY_CHANCE:
            break
    return blocks, intact


def to_pivots(fps: np.ndarray) -> np.ndarray:
    """Distances of fingerprints to every pivot: a row each."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs are within DISTANCE: first by the largest difference of coordinates, then exactly.

    By the triangle inequality a pair's distance is at least the difference of
    their distances to any pivot, so no link is lost.
    """
    ok = np.flatnonzero(np.abs(table[i] - table[j]).max(axis=1) <= DISTANCE)
    return ok[np.bitwise_count(fps[i[ok]] ^ fps[j[ok]]) <= DISTANCE]


def spanning(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within a group, by search from one fingerprint at a time."""
    table = to_pivots(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    unseen = np.ones(len(fps), dtype=bool)
    low = np.searchsorted(table[:, 0], table[:, 0] - DISTANCE, side="left")
    high = np.searchsorted(table[:, 0], table[:, 0] + DISTANCE, side="right")
    out = []
    for seed in range(len(fps)):
        if not unseen[seed]:
            continue
        unseen[seed] = False
        stack = [seed]
        while stack:
            x = stack.pop()
            left = np.flatnonzero(unseen[low[x] : high[x]]) + low[x]
            if not len(left):
                continue
            found = left[near(fps, table, np.full(len(left), x), left)]
            if len(found):
                unseen[found] = False
                out.append((np.full(len(found), fps[x]), fps[found]))
                stack += found.tolist()
    return out


def compare(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group`` numbers (ascending)."""
    if not len(group):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    new = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(new, len(group)))
    of = np.repeat(np.arange(len(new)), size)
    few = size <= 32
    out = []
    at = np.flatnonzero(few[of])
    if len(at):
        f, g = fps[at], of[at]
        table = to_pivots(f)
        for d in range(1, int(size[few].max())):
            i = np.flatnonzero(g[:-d] == g[d:])
            ok = near(f, table, i, i + d)
            out.append((f[i[ok]], f[i[ok] + d]))
    for k in np.flatnonzero(~few):
        out += spanning(fps[new[k] : new[k] + size[k]])
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


class Groups:
    """Takes batches of rows sorted by keys; gives whole groups: (group numbers, fingerprints)."""

    def __init__(self, *keys: str):
        self.keys, self.held = keys, np.empty((len(keys) + 1, 0), dtype=np.int64)

    def push(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The groups that end before the batch's last one."""
        part = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (*self.keys, "node")])
        rows = np.concatenate([self.held, part], axis=1)
        change = np.flatnonzero(self._new(rows)) + 1
        cut = change[-1] if len(change) else 0
        self.held = rows[:, cut:]
        return self._numbered(rows[:, :cut])

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        return self._numbered(self.held)

    @staticmethod
    def _new(rows: np.ndarray) -> np.ndarray:
        return (rows[:-1, 1:] != rows[:-1, :-1]).any(axis=0)

    def _numbered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group = np.cumsum(np.append(0, self._new(rows))) if rows.shape[1] else np.empty(0, np.int64)
        return group, np.ascontiguousarray(rows[-1]).view(np.uint64)


def pairs(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    a, b = compare(*found)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def linked(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    groups = Groups(*keys)
    for batch in batches:
        yield pairs(groups.push(batch))
    yield pairs(groups.rest())


def in_units(keyed: DataFrame, node: str, keys: tuple[str, ...], unit: int) -> tuple[DataFrame, tuple[str, ...]]:
    """(rows of ``keyed`` dealt and sorted by units, the units' columns).

    Keys are counted first, with partial counts before the shuffle. A group of
    over ``unit`` is cut into blocks before its rows are dealt, and each pair of
    blocks is a unit of its own: no task holds more, and no pair is missed.
    """
    sizes = Written(keyed.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > unit), "simhash-hot").df
    blocks = F.coalesce(F.ceil(F.col("n") / F.lit(unit // 2)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    cut = keyed.join(small(sizes, BROADCAST_KEYS), list(keys), "left").select(
        *keyed.columns, own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    )
    units = (*keys, "x", "y")
    dealt = cut.select(*keyed.columns, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    return dealt.repartition(*units).sortWithinPartitions(*units), units


def links(unique: DataFrame, unit: int = UNIT) -> DataFrame:
    """(a, b): links of distinct fingerprints (``node``) that connect all within DISTANCE bits.

    Fingerprints that differ in at most four bits agree on two of six blocks,
    so all links lie within groups of fingerprints that agree on two blocks;
    with more fingerprints the layout takes longer keys, so that chance groups
    stay small. Within a group, distances to pivots discard pairs and survivors
    are verified.
    """
    tables = masks(*layout(unique.count()))
    keyed = unique.select(
        "node", F.posexplode(F.array(*[F.col("node").bitwiseAND(F.lit(m)) for m in tables])).alias("t", "key")
    )
    dealt, units = in_units(keyed, "node", ("t", "key"), unit)
    return dealt.mapInArrow(lambda b: linked(b, *units), "a long, b long")


def grouped(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(node, doc_id, text_hash, head, kept) for rows (node, doc_id, text_hash): the first row of each group of linked nodes.

    ``found`` takes the distinct nodes' table and gives their links.
    """
    root = components(found)
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "node")
    firsts = rows.groupBy("node").agg(F.min(best).alias("first"))
    rooted = firsts.join(root, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    rooted = Written(rooted, "simhash-rooted").df
    heads = Written(rooted.groupBy("root").agg(F.min("first").alias("head")), "simhash-heads").df
    labels = rooted.join(heads, "root").select("node", "head")
    h = F.col("head")
    kept = F.col("doc_id").eqNullSafe(h["doc_id"]) & (F.col("text_hash") == h["text_hash"]) & (F.col("node") == h["node"])
    return rows.join(labels, "node").withColumn("kept", kept)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, kept, text_hash) for every row of ``docs``.

    Rows with equal fingerprints count once in the search. ``component_id`` is
    the smallest id reachable by links; ``kept`` marks one row of each group:
    the one with that id and, among rows that repeat it, the smallest hash of
    the text (rows that repeat both are all marked). Null and empty texts have
    fingerprint zero and are linked like others; a text of any length is
    fingerprinted whole; null ids rank last; an empty table gives no rows; other
    columns are not read.
    """
    rows = Written(fingerprints(docs, id_col, text_col).withColumnRenamed("fp", "node"), "simhash-rows").df
    unique = Written(rows.select("node").distinct(), "simhash-unique").df
    return grouped(rows, links(unique)).select(
        "doc_id",
        F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"),
        F.col("head")["doc_id"].alias("component_id"),
        "kept",
        "text_hash",
    )
