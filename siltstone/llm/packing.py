"""Packing documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, rows_of, short_batches
from .tokens import default_path, encoder

WINDOW, END = 1024, 0
#: Documents whose rests are packed together in one task.
GROUP_DOCS = 150_000


class Tightest:
    """A segment tree over remaining capacities: the open window with the least room that suffices."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, where: int) -> None:
        self.open[room].append(where)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, window) of the tightest with room for ``least``; it is no longer open."""
        i, count = least + self.leaves, self.count
        while not count[i]:  # up until a subtree to the right has one
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of its level
                return None
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        where = self.open[room].pop()
        self._add(room, -1)
        return room, where


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, longest pieces first."""
    tree, used = Tightest(window), 0
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size)
        room, where = found or (window, used)
        used += not found
        sequence[i], offset[i] = where, window - room
        if room > size:
            tree.put(room - size, where)
    return sequence, offset


def padding(used: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ids added to sequences of ``used`` ids: up to ``window``, and none to a power of two."""
    used = np.asarray(used)
    return np.where(used & (used - 1), window - used, 0)


def pieces(docs: DataFrame, id_col: str, text_col: str, window: int, path: str, with_ids: bool) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): documents cut into full windows and a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for doc_ids, texts in rows_of(batches, "doc_id", "text"):
            out: list[tuple] = []
            for doc, data in zip(doc_ids, own.encode([t or "" for t in texts]), strict=True):
                ids = np.append(np.frombuffer(data, dtype=own.dtype), END).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    out.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids), part.tolist() if with_ids else None))
            doc, at, size, crc, total, own_ids = zip(*out, strict=True)
            columns = [pa.array(x, pa.int64()) for x in (doc, at, size, crc, total)]
            if with_ids:
                columns.append(pa.array(own_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, kind)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    path: str | None = None,
    with_ids: bool = False,
    group_docs: int = GROUP_DOCS,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), a row per piece.

    A document is cut into full windows, each a sequence of its own, and a rest.
    Rests are dealt at random into groups of about ``group_docs``, each packed
    by one task: longest first, into the open window with the least room that
    suffices; of equally long ones the earlier row goes first. Only what
    describes a rest is shuffled. Even ids are full windows', odd ones packed.
    A sequence is padded to ``window``, unless its ids are a power of two in
    number (``padding``). Null and empty texts have the end id alone; a very
    long text gives as many full windows as it fills; repeated rows and null
    ids are packed like others (a hash of the row's position decides the
    group); an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    cut = Written(pieces(docs, id_col, text_col, window, path or default_path(), with_ids), "pack-pieces").df
    groups = max(1, -(-cut.filter(F.col("length") < window).count() // group_docs))
    full = cut.filter(F.col("length") == window).withColumns(
        {"sequence_id": F.monotonically_increasing_id() * 2, "offset": F.lit(0).cast("long")}
    )
    rest = cut.filter(F.col("length") < window).withColumn("pack", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sequence, offset = best_fit(table.column("length").to_numpy(), window)
        number = ((int(key[0].as_py()) << 32) + sequence) * 2 + 1
        return table.drop_columns(["pack"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    return full.unionByName(rest.groupBy("pack").applyInArrow(run, full.schema))
