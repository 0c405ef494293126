"""SimHash near-dedup by similarity: wide fingerprints name pairs of texts, whose shingles are then compared.

Fingerprints that differ in few bits of 64 (``simhash``) are nearly equal texts.
Texts of similarity 0.8 differ in some 15 % of their bits, so here fingerprints
are longer, pairs meet where they agree on some of many drawn bits, and every
link is verified by the shingles themselves. Links that this misses are then
found by the shingles alone: similar sets share one of their first shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, short_batches, small
from .graph import components
from .simhash import BROADCAST_KEYS, grouped, in_units
from .words import word_hashes

#: Words of 64 bits of a fingerprint, and numbers that make as many hashes of one.
WIDE = 4
MIX = np.random.Generator(np.random.PCG64(21)).integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Reference fingerprints.
PIVOTS = np.random.Generator(np.random.PCG64(22)).integers(0, 1 << 63, (12, WIDE), dtype=np.uint64)
#: Fingerprints of a group whose pairs are all looked at; of larger groups a nearest tree is.
FEW = 64
#: One text of so many is asked for frequent shingles; those in so many of them count as such, and so many at most.
SAMPLE, OFTEN, MOST_OFTEN = 16, 4, 1 << 15
#: Pairs that a task holds before it hands them on.
PAIRS = 1 << 18
#: Bits of a set's parities: two to four for each shingle, in these limits.
LEAST_BITS, MOST_BITS = 256, 4096


@dataclass(frozen=True)
class Settings:
    """Texts link whose sets of ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or more.

    There are as many drawings of bits as let a pair at that similarity meet
    with probability ``met``, however many bits a drawing takes to keep groups
    of unlike texts at about ``group``. Pairs beyond ``most`` deviations of the
    bits that such a pair differs in are left to the search by shingles.
    """

    shingle: int = 5
    similarity: float = 0.8
    met: float = 0.97
    group: int = 64
    most: float = 2.6
    unit: int = 16_384
    seed: int = 23

    @property
    def differ(self) -> float:
        """Chance that a bit differs at the similarity: the angle between two sets of equal size."""
        return float(np.arccos(2 * self.similarity / (1 + self.similarity)) / np.pi)

    @property
    def distance(self) -> int:
        bits = 64 * WIDE
        return int(bits * self.differ + self.most * np.sqrt(bits * self.differ * (1 - self.differ)))

    def rest(self, n: np.ndarray) -> np.ndarray:
        """What a set of ``n`` has besides its first shingles: too few to link with a set that has none of those."""
        return np.ceil(self.similarity * n - 1e-6).astype(np.int64) - 1

    def need(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """First shingles that sets of ``n`` and ``m`` share at least if they link, as they share no more of the others than one has."""
        return np.ceil(self.similarity / (1 + self.similarity) * (n + m) - 1e-6).astype(np.int64) - np.maximum(self.rest(n), self.rest(m))

    def apart(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """What sets of ``n`` and ``m`` that link have at most in one of them only."""
        return np.floor((1 - self.similarity) / (1 + self.similarity) * (n + m) + 1e-6).astype(np.int64)

    def drawings(self, n: int) -> np.ndarray:
        """A row of bits for each drawing."""
        bits = int(np.clip(np.round(np.log2(max(2, n) / self.group)), 4, 40))
        tables = int(np.ceil(np.log(1 - self.met) / np.log1p(-((1 - self.differ) ** bits))))
        rng = np.random.Generator(np.random.PCG64(self.seed))
        return np.stack([rng.choice(64 * WIDE, bits, replace=False) for _ in range(tables)])


def shingles(text: str | None, n: int) -> np.ndarray:
    """Different hashes of all runs of ``n`` words, ascending; of all words, if they are fewer."""
    h = word_hashes([text])[0]
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(out) + k]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def wide(found: np.ndarray) -> np.ndarray:
    """Bits set where over half the hashes have a one."""
    ones = np.zeros((WIDE, 64), dtype=np.int64)
    for k, m in enumerate(MIX):
        for i in range(0, len(found), 1 << 14):
            h = found[i : i + (1 << 14)] * m
            h ^= h >> np.uint64(32)
            h *= m
            ones[k] += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(found), axis=1, bitorder="little").view("<u8").ravel()


def name(found: np.ndarray) -> int:
    """A hash of a set of shingles; of none: zero."""
    return int(np.bitwise_xor.reduce((found ^ found >> np.uint64(33)) * MIX[0])) ^ len(found) if len(found) else 0


def parity(found: np.ndarray) -> bytes:
    """For each of some numbers, whether an odd count of hashes falls on it.

    Two sets' parities differ in no more bits than there are shingles in one of
    the sets only, as what they share cancels. Halves laid over each other
    (exclusive or) are the parities for half as many numbers.
    """
    bits = min(max(1 << (2 * len(found) - 1).bit_length(), LEAST_BITS), MOST_BITS) if len(found) else LEAST_BITS
    at = (found * MIX[1] >> np.uint64(52)).astype(np.int64) % bits
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """Parities of rows, of any of the widths or None, at every width up to a row's own."""

    def __init__(self, rows: list[bytes | None]):
        self.width = np.array([8 * len(r or b"") for r in rows], dtype=np.int64)
        m = np.zeros((len(rows), int(self.width.max(initial=0)) // 64), dtype=np.uint64)
        for bits in np.unique(self.width[self.width > 0]):
            at = np.flatnonzero(self.width == bits)
            m[at, : bits // 64] = np.frombuffer(b"".join(rows[k] for k in at), dtype="<u8").reshape(len(at), -1)
        self.levels = [m]
        while (half := self.levels[0].shape[1] // 2) >= LEAST_BITS // 64:
            self.levels.insert(0, self.levels[0][:, :half] ^ self.levels[0][:, half:])

    def within(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which pairs may differ in at most ``most`` shingles; those without parities may."""
        ok, both = np.arange(len(i)), np.minimum(self.width[i], self.width[j])
        for m in self.levels if both.any() else []:
            stay = both[ok] < 64 * m.shape[1]
            at = ok[~stay]
            stay[~stay] = apart(m[i[at]], m[j[at]]) <= most[at]
            ok = ok[stay]
        return ok


def sketched(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text_hash, node, w): w the fingerprint, node a hash of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, s.shingle) for t in batch.column("text").to_pylist()]
            node = np.array([name(x) for x in sets], dtype=np.uint64)
            w = pa.array([wide(x).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(node.view(np.int64)), w], ["doc_id", "text_hash", "node", "w"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, node long, w binary")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(len(column), WIDE)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def near(w: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs are within ``distance``: first by the largest difference of distances to pivots, then exactly."""
    ok = np.flatnonzero(np.abs(table[i] - table[j]).max(axis=1, initial=0) <= distance)
    return ok[apart(w[i[ok]], w[j[ok]]) <= distance]


def nearest_tree(w: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A shortest tree over fingerprints, without its edges beyond ``distance``."""
    n = len(w)
    best, to, open_ = np.full(n, 1 << 14, dtype=np.int16), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    out, x = [], 0
    open_[0] = False
    for _ in range(n - 1):
        d = apart(w, w[x])
        closer = open_ & (d < best)
        best[closer], to[closer] = d[closer], x
        x = int(np.argmin(np.where(open_, best, np.int16(1 << 14))))
        if not open_[x]:  # all that are left are out of reach
            x = int(np.flatnonzero(open_)[0])
        elif best[x] <= distance:
            out.append((x, int(to[x])))
        open_[x] = False
    pair = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def compare(node: np.ndarray, w: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes to verify within runs of equal ``group`` numbers."""
    new = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(new, len(group)))
    few = size <= FEW
    at = np.flatnonzero(np.repeat(few, size))
    out = []
    if len(at):
        v, g, of = w[at], group[at], node[at]
        table = apart(v[:, None, :], PIVOTS[None, :, :])
        for d in range(1, int(size[few].max())):
            i = np.flatnonzero(g[:-d] == g[d:])
            i = i[near(v, table, i, i + d, distance)]
            out.append((of[i], of[i + d]))
    for k in np.flatnonzero(~few):
        part = slice(new[k], new[k] + size[k])
        i, j = nearest_tree(w[part], distance)
        out.append((node[part][i], node[part][j]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in (0, 1))


def candidates(unique: DataFrame, s: Settings) -> DataFrame:
    """(a, b): different pairs of nodes to verify, from rows (node, w)."""
    bits = s.drawings(unique.count())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.unpackbits(matrix(batch.column("w")).view(np.uint8), axis=1, bitorder="little")
                for t, drawn in enumerate(bits):
                    code = own[:, drawn].astype(np.int64) @ (1 << np.arange(len(drawn)))
                    yield pa.RecordBatch.from_arrays([pa.array(code + (t << 48)), *batch.select(["node", "w"]).columns], ["key", "node", "w"])

    dealt, units = in_units(unique.mapInArrow(keyed, "key long, node long, w binary"), "node", ("key",), s.unit)
    distance = s.distance

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, node: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.append(0, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if len(node) else np.empty(0, np.int64)
            a, b = compare(node, w, group, distance)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held = (np.empty((len(units), 0), np.int64), np.empty(0, np.int64), np.empty((0, WIDE), np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in units])
            rows = (np.concatenate([held[0], keys], axis=1), np.concatenate([held[1], batch.column("node").to_numpy()]), np.concatenate([held[2], matrix(batch.column("w"))]))
            change = np.flatnonzero((rows[0][:, 1:] != rows[0][:, :-1]).any(axis=0))
            cut = int(change[-1]) + 1 if len(change) else 0
            held = (rows[0][:, cut:], rows[1][cut:], rows[2][cut:])
            if cut:
                yield out(rows[0][:, :cut], rows[1][:cut], rows[2][:cut])
        yield out(*held)

    return dealt.mapInArrow(pairs, "a long, b long").distinct()


def frequent(docs: DataFrame, s: Settings) -> np.ndarray:
    """Shingles that a sample of ``docs`` has often, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, s.shingle).view(np.int64))], ["key"])

    found = docs.filter(F.pmod("text_hash", F.lit(SAMPLE)) == 0).dropDuplicates(["text_hash"]).mapInArrow(run, "key long").groupBy("key").count()
    top = found.filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "key").limit(MOST_OFTEN).collect()
    return np.array([r["key"] for r in reversed(top)], dtype=np.int64).view(np.uint64)


def ordered(found: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``found`` (ascending) with those in ``last`` at the end, in its order."""
    _, at, place = np.intersect1d(found, last, assume_unique=True, return_indices=True)
    return np.concatenate([np.delete(found, at), last[np.sort(place)]])


def firsts(docs: DataFrame, last: np.ndarray, s: Settings) -> DataFrame:
    """(node, size, keys): the first shingles of each set, at most once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0}
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                x = shingles(t, s.shingle)
                if (node := name(x)) not in seen:
                    seen.add(node)
                    out.append((node, len(x), ordered(x, last)[: len(x) - int(s.rest(len(x)))].view(np.int64)))
            node = np.array([x[0] for x in out], dtype=np.uint64).view(np.int64)
            keys = pa.array([x[2] for x in out], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([x[1] for x in out], pa.int32()), keys], ["node", "size", "keys"])

    return docs.select("text").mapInArrow(run, "node long, size int, keys array<long>")


def meeting(group: np.ndarray, root: np.ndarray, size: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within runs of equal ``group`` numbers that are not joined yet and of sizes that may link."""

    def ok(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= s.similarity * np.maximum(size[i], size[j]) - 1e-6)

    new = np.flatnonzero(np.diff(group, prepend=-1))
    length = np.diff(np.append(new, len(group)))
    few = np.repeat(length <= FEW, length)
    at = np.flatnonzero(few)
    for d in range(1, int(length[length <= FEW].max(initial=0))):
        i = np.flatnonzero(group[at[:-d]] == group[at[d:]])
        i, j = at[i], at[i + d]
        both = ok(i, j)
        yield i[both], j[both]
    for k in np.flatnonzero(length > FEW):
        for x in range(new[k], new[k] + length[k] - 1):
            j = np.arange(x + 1, new[k] + length[k])
            j = j[ok(np.full(len(j), x), j)]
            yield np.full(len(j), x), j


def one_text(nodes: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of ``nodes``, read from one row of each."""
    first = rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))  # before the join: a node may hold a third of all rows
    heads = first.join(nodes, "node", "left_semi")
    heads = small(Written(heads.select("node", F.col("head.doc_id").alias("h_id"), F.col("head.text_hash").alias("h_hash")), "similar-heads").df, BROADCAST_KEYS)
    texts = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")))
    return texts.select("node", "text").dropDuplicates(["node"])


def with_parities(met: DataFrame, rows: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """``met`` with the parities of sets in large groups (``many``), else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parity(shingles(t, s.shingle)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "parity"])

    many = met.filter("many")
    found = Written(one_text(many.select("node").distinct(), rows, docs).mapInArrow(run, "node long, parity binary"), "similar-parities").df
    large = Written(many.join(found, "node", "left"), "similar-large").df
    return met.filter("not many").withColumn("parity", F.lit(None).cast("binary")).unionByName(large).drop("many")


def left(docs: DataFrame, roots: DataFrame, s: Settings, rows: DataFrame | None = None) -> DataFrame:
    """(a, b): all pairs of nodes to verify that ``roots`` (node, root) does not join yet.

    In one order of all shingles, sets that link share some of their first ones
    (``Settings.need``), so no pair is missed. Frequent shingles come last in
    that order, which a sample decides: it bears on the size of groups only.
    Shingles whose sets are joined already are dropped before pairs are made.
    In groups of over FEW sets, those whose parities differ in more bits than
    sets that link have different shingles make no pair: what unlike texts
    have in common, a passage say, makes none. ``rows`` are those that
    ``sketched`` gives for ``docs`` (doc_id, text_hash, text), if they are there already.
    """
    if rows is None:
        docs = docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.lit(None).cast("long"))
        rows = sketched(docs, s)
    sets = firsts(docs, frequent(docs, s), s).join(small(roots, BROADCAST_KEYS), "node", "left")
    keyed = sets.select("node", F.coalesce("root", "node").alias("root"), "size", F.explode("keys").alias("key"))
    same = Window.partitionBy("key")
    between = keyed.withColumns({"low": F.min("root").over(same), "high": F.max("root").over(same), "many": F.count("*").over(same) > FEW}).filter("low < high")
    met = Written(between.drop("low", "high").dropDuplicates(["key", "node"]), "similar-met").df
    dealt, units = in_units(with_parities(met, rows, docs, s), "node", ("key",), s.unit)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (*units, "node", "root", "size")

        def out(rows: np.ndarray, parities: list[bytes | None]) -> Iterator[pa.RecordBatch]:
            group = np.cumsum(np.append(0, (rows[: len(units), 1:] != rows[: len(units), :-1]).any(axis=0))) if rows.shape[1] else np.empty(0, np.int64)
            node, root, size = rows[len(units) :]
            bits, found, n = Parities(parities), [], 0

            def counted() -> pa.RecordBatch:
                i, j = (np.concatenate([x[k] for x in found] or [np.empty(0, np.int64)]) for k in (0, 1))
                low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                order = np.lexsort((high, low))
                low, high, need = low[order], high[order], s.need(size[i], size[j])[order]
                new = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(low)])
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (low[new], high[new], need[new], np.diff(np.append(new, len(low))))], ["a", "b", "need", "n"])

            for i, j in meeting(group, root, size, s):
                ok = bits.within(i, j, s.apart(size[i], size[j]))
                found.append((i[ok], j[ok]))
                n += len(ok)
                if n > PAIRS:
                    yield counted()
                    found, n = [], 0
            yield counted()

        held, parities, n = [], [], 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy().astype(np.int64) for k in names]))
            parities += batch.column("parity").to_pylist()
            n += batch.num_rows
            if n > s.unit:
                rows = np.concatenate(held, axis=1)
                change = np.flatnonzero((rows[: len(units), 1:] != rows[: len(units), :-1]).any(axis=0))
                cut = int(change[-1]) + 1 if len(change) else 0
                yield from out(rows[:, :cut], parities[:cut])
                held, parities, n = [rows[:, cut:]], parities[cut:], 0
        if held:
            yield from out(np.concatenate(held, axis=1), parities)

    counts = dealt.mapInArrow(pairs, "a long, b long, need long, n long").groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("n").alias("n"))
    return counts.filter("n >= need").select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(a, b) of the pairs whose sets of shingles are similar enough, from texts (node, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, s.shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= s.similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = Written(texts.mapInArrow(sets, "node long, found binary"), "similar-shingles").df
    a, b = (found.select(F.col("node").alias(k), F.col("found").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text_hash, component_id, kept) for every row of ``docs``.

    Texts with equal sets of shingles count once. Pairs meet in groups of
    fingerprints that agree on drawn bits: in a small group distances to pivots
    discard pairs, in a larger one a shortest tree names as many pairs as it
    has members. That joins most of what is similar; then all pairs that share
    one of their first shingles are looked at, unless they are joined already,
    so none at the similarity is missed. All are verified by their
    shingles, so no link lies below it. ``component_id`` and ``kept`` are as in
    ``simhash.near_duplicates``, as are null ids, rows that repeat and empty
    tables. ASCII letters are compared in lower case. Texts without words are
    one group; a text of any length is read whole; other columns are not read.
    """
    s = settings
    short_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = Written(sketched(own, s), "similar-rows").df
    unique = Written(rows.groupBy("node").agg(F.min("w").alias("w")), "similar-unique").df

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = Written(pairs, "similar-pairs").df
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return Written(verified(pairs, one_text(wanted, rows, own), s), "similar-links").df

    most = linked(candidates(unique, s))
    links = most.unionByName(linked(left(own, Written(components(most), "similar-roots").df, s, rows)))
    return grouped(rows.drop("w"), links).select("doc_id", "text_hash", F.col("head")["doc_id"].alias("component_id"), "kept")
