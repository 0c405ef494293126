"""Embedding near-dedup by NN-descent."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Written, shared_path, small
from .graph import components


@dataclass(frozen=True)
class Settings:
    """``neighbours`` per vector; first lists from ``tables`` or more random cuts into groups of about ``group``.

    There are as many cuts as let a pair at the threshold share a group with
    probability ``met``, however fine the cuts are. Neighbours below ``floor`` lead to no link and are left out. Refining ends
    when a round adds under ``still`` of the entries near the threshold, or
    after ``rounds``. If the audit of ``audit`` vectors against all finds that
    less than ``recall`` of those with few, or with many, links have all of
    them, by two deviations of so many draws, refining goes on from another set
    of cuts, up to ``retries`` times.
    """

    threshold: float = 0.95
    neighbours: int = 10
    floor: float = 0.5
    tables: int = 12
    met: float = 0.995
    group: int = 96
    rounds: int = 6
    still: float = 0.002
    audit: int = 1024
    recall: float = 0.99
    retries: int = 2
    seed: int = 5
    block: int = 1024

    @property
    def near(self) -> float:
        """Entries from here on are checked in double precision: lists hold similarities of bytes."""
        return self.threshold - 0.02

    @property
    def sure(self) -> float:
        """Entries from here on link in double precision too."""
        return self.threshold + 0.02

    def enough(self, whole: int, there: int) -> bool:
        lost = (1 - self.recall) * there
        return there - whole <= lost + 2 * np.sqrt(lost)

    def cuts(self, bits: int) -> int:
        """A cut of ``bits`` signs keeps a pair together if no direction parts it."""
        together = (1 - np.arccos(self.threshold) / np.pi) ** bits
        return max(self.tables, int(np.ceil(np.log(1 - self.met) / np.log1p(-together)))) if bits else self.tables


def unit_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector as doubles, null if it cannot link)."""
    v = F.col(vector_col).cast("array<double>")
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    # A null or non-finite component makes the sum null, infinite or NaN.
    ok = norm.isNotNull() & ~F.isnan(norm) & (norm > 0) & (norm < F.lit(float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(ok, v).alias("vector"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def to_bytes(x: np.ndarray) -> list[bytes]:
    """Vectors in a byte per component, which is what lists are built from."""
    top = np.abs(x).max(axis=1, keepdims=True)
    return [r.tobytes() for r in np.rint(127 * x / top).astype(np.int8)]


def from_bytes(column: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(len(column), -1).astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tops(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the k best columns of each row, itself left out."""
    sims = sims.copy()
    np.fill_diagonal(sims, -2)
    k = min(k, sims.shape[1] - 1)
    if k < 1:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k].ravel()
    row = np.repeat(np.arange(len(sims)), k)
    return row, best, sims[row, best]


def ties(sims: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of a group that connect all it connects from ``near`` on, however many neighbours a list holds.

    A tree spans what surely links; between such parts every entry from
    ``near`` on is given, as each may or may not link in double precision.
    """
    sure = sims >= s.sure
    part = np.full(len(sims), -1)
    a, b = [], []
    for seed in range(len(sims)):
        if part[seed] >= 0:
            continue
        part[seed] = seed
        stack = [seed]
        while stack:
            x = stack.pop()
            found = np.flatnonzero(sure[x] & (part < 0))
            part[found] = seed
            a.append(np.full(len(found), x))
            b.append(found)
            stack += found.tolist()
    i, j = np.nonzero(np.triu(sims >= s.near, 1) & (part[:, None] != part[None, :]))
    return np.concatenate([*a, i]).astype(int), np.concatenate([*b, j]).astype(int)


PAIR = "u long, v long, sim float"
#: ``tie``: a pair to check that belongs to no list.
EDGE = "u long, v long, sim float, tie boolean"


def by_group(batches: Iterator[pa.RecordBatch], key: str, vector: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole groups, from rows sorted by ``key``."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != vector}
        column = batch.column(vector)
        new[vector] = from_bytes(column) if pa.types.is_binary(column.type) else matrix(column)
        rows = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
        cuts = [0, *(np.flatnonzero(rows[key][1:] != rows[key][:-1]) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield {c: v[a:b] for c, v in rows.items()}
        held = {c: v[cuts[-1] :] for c, v in rows.items()}
    if held is not None:
        yield held


def edges(u: list, v: list, sim: list, tie: list) -> pa.RecordBatch:
    join = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), t)
    flags = pa.array(np.repeat(np.array(tie, dtype=bool), [len(x) for x in u]), pa.bool_())
    return pa.RecordBatch.from_arrays([join(u, pa.int64()), join(v, pa.int64()), join(sim, pa.float32()), flags], ["u", "v", "sim", "tie"])


def cut_at_random(nodes: DataFrame, n: int, s: Settings, turn: int) -> DataFrame:
    """Candidate lists: in each of several random cuts, a vector's best within its group.

    A cut is the signs of products with random directions; groups larger than
    twice the wanted size are divided by a hash, so no group is unbounded.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, n / s.group)))))
    seed, tables = s.seed + 1000 * turn, s.cuts(bits)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = from_bytes(batch.column("q"))
            if planes is None:
                planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((tables, x.shape[1], bits)).astype(np.float32)
            for t in range(tables):
                code = ((x @ planes[t] > 0) @ (1 << np.arange(bits))).astype(np.int64) + (t << 40)
                yield pa.RecordBatch.from_arrays([pa.array(code), batch.column("u"), batch.column("q")], ["cell", "u", "q"])

    cells = nodes.mapInArrow(keyed, "cell long, u long, q binary")
    sized = cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * s.group)
    parts = small(Written(sized, "nn-cells").df, 200_000)
    split = F.pmod(F.xxhash64("u", "cell", F.lit(turn)), F.coalesce(F.ceil(F.col("n") / F.lit(s.group)), F.lit(1)))
    dealt = cells.join(parts, "cell", "left").select(F.xxhash64("cell", split).alias("cell"), "u", "q")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, ss, ts = [], [], [], []
        held = 0
        for g in by_group(batches, "cell", "q"):
            sims = g["q"] @ g["q"].T
            row, col, sim = tops(sims, s.neighbours)
            ok = sim >= s.floor
            us.append(g["u"][row[ok]])
            vs.append(g["u"][col[ok]])
            ss.append(sim[ok])
            ts.append(False)
            held += len(us[-1])
            if ((sims >= s.near).sum(axis=1) > s.neighbours + 1).any():  # a list of this cell leaves links out
                i, j = ties(sims, s)
                us.append(g["u"][i])
                vs.append(g["u"][j])
                ss.append(sims[i, j])
                ts.append(True)
                held += len(i)
            if held > 200_000 or len(us) >= 2000:
                yield edges(us, vs, ss, ts)
                us, vs, ss, ts = [], [], [], []
                held = 0
        yield edges(us, vs, ss, ts)

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(best, EDGE)


def shorten(candidates: DataFrame, k: int) -> DataFrame:
    """The k best of each list, equal entries merged: maximum and rank by Spark's sort."""
    once = candidates.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    return once.withColumn("place", place).filter(F.col("place") <= k).select("u", "v", "sim", "old", "place")


def refine(graph: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Candidates from neighbours of neighbours: each vector compares its neighbours, both ways.

    Members of a vector's list and those that list it meet in one group, in
    which at least one of a pair must be new since the last round. Those that
    list a hub are dealt into several groups, each with the hub's own list.
    """
    hub = 4 * s.neighbours
    forth = graph.select(F.col("u").alias("at"), F.col("v").alias("m"), (F.col("old") == 0).alias("new"))
    back = graph.select(F.col("v").alias("at"), F.col("u").alias("m"), (F.col("old") == 0).alias("new"))
    deg = back.groupBy("at").agg(F.ceil(F.count("*") / hub).cast("int").alias("parts"))
    lists = forth.join(deg, "at", "left").select("at", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "m", "new")
    listed = back.join(deg, "at").select("at", F.pmod(F.xxhash64("m"), "parts").cast("int").alias("part"), "m", "new")
    members = lists.unionByName(listed).groupBy(F.xxhash64("at", "part").alias("cell"), "m").agg(F.max("new").alias("new"))
    alive = members.groupBy("cell").agg(F.max("new").alias("any")).filter("any").select("cell")
    least = graph.filter(F.col("place") == s.neighbours).select(F.col("u").alias("m"), F.col("sim").alias("least"))
    held = nodes.join(least, nodes["u"] == F.col("m"), "left").select(F.col("u").alias("m"), "q", F.coalesce("least", F.lit(s.floor).cast("float")).alias("least"))
    dealt = members.join(alive, "cell", "left_semi").join(held, "m")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, ss, ts = [], [], [], []
        held = 0
        for g in by_group(batches, "cell", "q"):
            ids, new = g["m"], g["new"].astype(bool)
            if len(ids) < 2:
                continue
            sims = g["q"] @ g["q"].T
            i, j = np.nonzero((sims > g["least"][:, None]) & (new[:, None] | new[None, :]) & (ids[:, None] != ids[None, :]))
            us.append(ids[i])
            vs.append(ids[j])
            ss.append(sims[i, j])
            ts.append(False)
            held += len(i)
            if (g["least"] >= s.near).any():  # a full list takes no further links
                i, j = ties(sims, s)
                us.append(ids[i])
                vs.append(ids[j])
                ss.append(sims[i, j])
                ts.append(True)
                held += len(i)
            if held > 200_000 or len(us) >= 2000:
                yield edges(us, vs, ss, ts)
                us, vs, ss, ts = [], [], [], []
                held = 0
        yield edges(us, vs, ss, ts)

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(local, EDGE)


def descend(nodes: DataFrame, n: int, s: Settings, turn: int, graph: Written | None) -> tuple[Written, list[Written]]:
    """(lists from random cuts and an earlier graph, refined until few links come; pairs to check besides)."""

    def apart(found: DataFrame) -> DataFrame:
        """The candidates for lists; ties lie in a folder of their own and stay."""
        both = Compared(found)
        tied.extend(both.part("true"))
        compared.append(both)
        lists = both.part("false")
        return (lists[0].df if lists else nodes.sparkSession.createDataFrame([], PAIR)).select("u", "v", "sim")

    tied: list[Written] = []
    compared: list[Compared] = []
    fresh = apart(cut_at_random(nodes, n, s, turn)).withColumn("old", F.lit(0))
    if graph:
        fresh = graph.df.select("u", "v", "sim", F.lit(1).alias("old")).unionByName(fresh)
    now = Written(shorten(fresh, s.neighbours), "nn-graph")
    compared.pop().drop()
    for _ in range(s.rounds):
        more = apart(refine(now.df, nodes, s)).withColumn("old", F.lit(0))
        kept = now.df.select("u", "v", "sim", F.lit(1).alias("old"))
        # An entry that was there stays old: its pairs have met.
        after = Written(shorten(kept.unionByName(more), s.neighbours), "nn-graph")
        new, all_ = after.df.filter(F.col("sim") >= s.near).agg(F.count(F.when(F.col("old") == 0, 1)), F.count("*")).first()
        compared.pop().drop()
        now.drop()
        now = after
        if new <= s.still * all_:
            break
    return now, tied


class Compared:
    """What cells gave, written once: entries for lists and ties in folders of their own."""

    def __init__(self, found: DataFrame):
        self.spark = found.sparkSession
        self.path = shared_path(self.spark, "nn-compared")
        found.write.option("compression", "zstd").partitionBy("tie").parquet(self.path)

    def part(self, tie: str) -> list[Written]:
        """The table of one kind, if there is any."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tie={tie}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return [Written.at(self.spark, f"{self.path}/tie={tie}", PAIR)] if there else []

    def drop(self) -> None:
        for lists in self.part("false"):
            lists.drop()


def verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b whose cosine in double precision reaches the threshold."""
    v = vectors.select(F.col("u").alias("a"), F.col("x").alias("xa"))
    w = vectors.select(F.col("u").alias("b"), F.col("x").alias("xb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = pa.array((matrix(batch.column("xa")) * matrix(batch.column("xb"))).sum(axis=1) >= threshold)
                yield batch.select(["a", "b"]).filter(ok)

    return pairs.join(v, "a").join(w, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def counted_in_blocks(members: DataFrame, s: Settings) -> DataFrame:
    """(u, n): for each vector of a group (root, u, x, w, n_group), the weight of all it links to.

    Groups are dealt into pairs of blocks, so a task holds two blocks, and only
    counts leave it, never pairs.
    """
    blocks = F.ceil(F.col("n_group") / F.lit(s.block)).cast("int")
    own = F.pmod(F.xxhash64("u"), blocks).cast("int")
    cut = members.select("root", "u", "x", "w", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cut = cut.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "own", "other", "u", "x", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_group(batches, "cell", "x"):
            x, ids, w, side = g["x"], g["u"], g["w"], g["own"]
            one = g["own"][0] == g["other"][0]
            for i in range(0, len(ids), 512):
                sims = x[i : i + 512] @ x.T >= s.threshold
                sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = False
                if not one:
                    sims &= side[i : i + 512, None] != side[None, :]
                n = sims @ w
                hit = np.flatnonzero(n)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 512][hit]), pa.array(n[hit])], ["u", "n"])

    return cut.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, n long")


def audit(nodes: DataFrame, found: DataFrame, s: Settings) -> list[tuple[int, int]]:
    """(vectors with all links found, vectors) of a seeded sample, held against all vectors.

    A pair for vectors with one link, up to 10, up to 100, and more, so that
    groups of many links do not hide what small ones miss.
    """
    drawn = nodes.orderBy(F.xxhash64("u", F.lit(s.seed))).limit(s.audit)
    rows = drawn.select("u", "x").collect()  # ``audit`` vectors
    if not rows:
        return []
    ids, x = np.array([r["u"] for r in rows]), np.array([r["x"] for r in rows], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                own = batch.column("u").to_numpy()
                hit = (x @ matrix(batch.column("x")).T >= s.threshold) & (ids[:, None] != own[None, :])
                total += hit @ batch.column("w").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["u", "there"])

    there = nodes.select("u", "x", "w").mapInArrow(run, "u long, there long").groupBy("u").agg(F.sum("there").alias("there"))
    got = found.join(F.broadcast(there), "u", "right").select(F.coalesce("n", F.lit(0)).alias("n"), "there")
    level = sum((F.col("there") > x).cast("int") for x in (1, 10, 100))
    whole = F.count(F.when(F.col("n") >= F.col("there"), 1))
    levels = got.filter("there > 0").groupBy(level.alias("level")).agg(whole.alias("whole"), F.count("*").alias("all")).orderBy("level").collect()
    return [(r["whole"], r["all"]) for r in levels]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``.

    Equal vectors are one node, weighted by its rows. NN-descent builds the
    neighbour lists; entries at the threshold, checked in double precision, are
    links. A full list whose last entry still links is saturated: it is
    enlarged to its whole component, where every vector is compared with all
    others in blocks. Links that were compared but that full lists have no
    place for still join components (``ties``). A recall that the audit still
    finds too low in the end is given as a warning. Vectors that are null, zero, or hold null or non-finite
    components link with nothing, as do vectors of another length than most.
    Of equally near vectors a list keeps those of the smaller number, and ties at
    its end are found by enlarging. Null ids rank last; rows that repeat an id count as rows of their own but
    share its component; an empty table gives no rows; other columns are not
    read.
    """
    s = settings
    rows = Written(unit_vectors(df, id_col, vector_col), "nn-rows").df
    usual = rows.filter("vector is not null").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = usual["d"] if usual else 0
    fit = rows.filter(F.size("vector") == dim)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = scaled(matrix(batch.column("vector")))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("u"), flat, pa.array(to_bytes(x), pa.binary()), batch.column("w")], ["u", "x", "q", "w"])

    classes = fit.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("w"))
    # A node's number is a hash of its vector, as ids may repeat or be null.
    named = Written(classes.withColumn("u", F.xxhash64("vector")), "nn-classes").df
    nodes = Written(named.select("u", "vector", "w").mapInArrow(scale, "u long, x array<double>, q binary, w long"), "nn-nodes").df
    n = nodes.count()
    graph, turn = None, 0
    tied: list[Written] = []
    while True:
        before = graph
        graph, more = descend(nodes.select("u", "q"), n, s, turn, before)
        tied += more
        if before:
            before.drop()
        near = graph.df.filter(F.col("sim") >= s.near)
        pairs = near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        for t in tied:
            pairs = pairs.unionByName(t.df.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))
        pairs = pairs.distinct()
        links = Written(verified(pairs, nodes, s.threshold), "nn-links").df
        root = Written(components(links), "nn-roots").df
        full = graph.df.filter((F.col("place") == s.neighbours) & (F.col("sim") >= s.near)).select(F.col("u").alias("node"))
        wide = Written(root.join(full, "node", "left_semi").select("root").distinct(), "nn-wide").df
        inside = root.join(wide, "root", "left_semi")
        sizes = inside.groupBy("root").agg(F.count("*").alias("n_group"))
        members = inside.join(sizes, "root").join(nodes.select(F.col("u").alias("node"), "x", "w"), "node").select("root", F.col("node").alias("u"), "x", "w", "n_group")
        blocks = counted_in_blocks(members, s).groupBy("u").agg(F.sum("n").alias("n"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rest = both.join(inside.select(F.col("node").alias("a")), "a", "left_anti")
        weights = nodes.select(F.col("u").alias("b"), "w")
        counts = Written(rest.join(weights, "b").groupBy(F.col("a").alias("u")).agg(F.sum("w").alias("n")).unionByName(blocks), "nn-counts").df
        shares = audit(nodes, counts, s)
        turn += 1
        if all(s.enough(got, there) for got, there in shares):
            break
        if turn > s.retries:
            warnings.warn(f"embedding links: (vectors with all links, vectors) of the audit after {turn} sets of cuts, by number of links: {shares}", stacklevel=2)
            break
    rooted = named.join(root.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    rooted = Written(rooted, "nn-rooted").df
    heads = Written(rooted.groupBy("root").agg(F.min("first").alias("component")), "nn-heads").df
    labels = rooted.join(heads, "root").join(counts, "u", "left").select("vector", "component", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    found = rows.filter(F.size("vector") == dim).join(labels, "vector")
    alone = rows.filter(F.col("vector").isNull() | (F.size("vector") != dim)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id")).unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
