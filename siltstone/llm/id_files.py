"""Files of token ids: documents compressed one by one with a shared zstandard dictionary.

A file: MAGIC, bytes per id (u8), SHA-256 of the dictionary (32 bytes); one
zstandard frame per document; an index of four arrays of unsigned 64-bit
little-endian integers (ids of documents, two's complement; 1 if the id is
null; where frames begin; token counts); then the number of documents, where
the index begins, and MAGIC again. The dictionary lies beside the files.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import qualified
from .common import Written, rows_of, shared_path, short_batches
from .tokens import default_path, encoder

MAGIC = b"SLTIDS01"
DICTIONARY = "dictionary.zdict"
#: The dictionary: its size, and what it is trained on: the first documents in a seeded order, and of
#: each as many pieces at most, evenly spread over the whole of a longer one.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_PIECE, SAMPLE_PIECES = 65_536, 1_000, 8_192, 8
#: zstandard's least size of a dictionary, with room for the segments it picks.
LEAST_BYTES = 1_024
LEVEL = 3
END = 0


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialized ids, of a tenth of them at most; empty where zstandard finds too little to learn from."""
    import zstandard

    pieces = [s[i : i + SAMPLE_PIECE] for s in samples for i in range(0, len(s), SAMPLE_PIECE)]
    size = min(size, sum(map(len, pieces)) // 10)
    if size < LEAST_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def codec(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file; it appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str, width: int, dictionary: bytes):
        self.fs, self.folder = store(folder)
        self.name, self.draft = f"{self.folder}/{name}", f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        self.width = width
        self.file = self.fs.open_output_stream(self.draft)
        self.at = 0
        self.ids: list[int] = []
        self.null: list[int] = []
        self.begin: list[int] = []
        self.tokens: list[int] = []
        self._put(MAGIC + bytes([width]) + hashlib.sha256(dictionary).digest())

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, n_tokens: int, frame: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.null.append(int(doc_id is None))
        self.begin.append(self.at)
        self.tokens.append(n_tokens)
        self._put(frame)

    def close(self) -> None:
        index = self.at
        for column in (self.ids, self.null, self.begin, self.tokens):
            self._put(np.array(column, dtype="<i8").tobytes())
        self._put(struct.pack("<QQ", len(self.ids), index) + MAGIC)
        self.file.close()
        if self.fs.get_file_info(self.name).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.name)  # an earlier attempt of this task
        self.fs.move(self.draft, self.name)


class Reader:
    """Reads documents of a file one by one, wherever they lie."""

    def __init__(self, folder: str, name: str):
        fs, path = store(folder)
        with fs.open_input_stream(f"{path}/{DICTIONARY}") as f:
            dictionary = f.read()
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        n, index = struct.unpack("<QQ", self.file.read_at(16, size - 16 - len(MAGIC)))
        head = self.file.read_at(len(MAGIC) + 33, 0)
        if head[: len(MAGIC)] != MAGIC or self.file.read_at(len(MAGIC), size - len(MAGIC)) != MAGIC:
            raise ValueError(f"{name}: not a file of ids")
        if head[len(MAGIC) + 1 :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name}: written with another dictionary")
        self.width = head[len(MAGIC)]
        table = np.frombuffer(self.file.read_at(32 * n, index), dtype="<i8").reshape(4, n)
        self.ids, self.null, self.begin, self.tokens = table
        self.ends = np.append(self.begin[1:], index)
        self.press = codec(dictionary)[1]

    def __len__(self) -> int:
        return len(self.ids)

    def doc_id(self, i: int) -> int | None:
        return None if self.null[i] else int(self.ids[i])

    def __getitem__(self, i: int) -> np.ndarray:
        at, size = int(self.begin[i]), int(self.tokens[i]) * self.width
        frame = self.file.read_at(int(self.ends[i]) - at, at)
        return np.frombuffer(self.press.decompress(frame, max_output_size=size), dtype=f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


def spread(data: bytes) -> bytes:
    """Pieces that are evenly spread over ``data``; all of it, if it is short."""
    n = -(-len(data) // SAMPLE_PIECE)
    if n <= SAMPLE_PIECES:
        return data
    return b"".join(data[(k := i * n // SAMPLE_PIECES) * SAMPLE_PIECE : (k + 1) * SAMPLE_PIECE] for i in range(SAMPLE_PIECES))


def sample(docs: DataFrame, path: str, n: int = SAMPLE_DOCS) -> list[bytes]:
    """Serialized ids of the first ``n`` documents in a seeded order of ids: pieces of each, so that no text is too long for the driver."""
    drawn = docs.select("doc_id", "text", F.xxhash64(F.lit("dictionary"), "doc_id").alias("drawn"))
    last = drawn.select("drawn").orderBy("drawn").limit(n).agg(F.max("drawn")).first()[0]
    if last is None:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for (texts,) in rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([spread(x) for x in own.encode([t or "" for t in texts])], pa.binary())], ["ids"])

    found = drawn.filter(F.col("drawn") <= last).orderBy("drawn").limit(n).select("text").mapInArrow(run, "ids binary")
    return sorted(bytes(r[0]) for r in found.collect())


def write(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> tuple[str, DataFrame]:
    """Write all documents in ascending order of ids; (folder, manifest).

    The manifest has a row per file: shard, name, n_docs, n_tokens, start (ids
    in earlier files). Texts are encoded and compressed where they are read, so
    only frames are dealt by ranges of the id and sorted; they are written in
    between, so a lost executor does not encode again. Null ids come first;
    rows that repeat an id are ordered by a hash of the text. Null and empty
    texts have the end id alone; a text of any length is one frame. A file is written under a draft name and
    renamed, so a task that runs twice leaves one file.
    """
    spark = docs.sparkSession
    short_batches(spark)
    path = path or default_path()
    folder = qualified(spark, folder) if folder else shared_path(spark, "ids")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = train(sample(docs, path))
    fs, base = store(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{DICTIONARY}") as f:
        f.write(dictionary)

    width = encoder(path).width

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press = encoder(path), codec(dictionary)[0]
        end = np.array([END], dtype=own.dtype).tobytes()
        for batch in batches:
            if batch.num_rows:
                data = [x + end for x in own.encode([t or "" for t in batch.column("text").to_pylist()])]
                n, frames = [len(x) // own.width for x in data], [press.compress(x) for x in data]
                yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "text_hash"]).columns, pa.array(n), pa.array(frames, pa.binary())], ["doc_id", "text_hash", "n_tokens", "frame"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out = TaskContext.get().partitionId(), None
        for rows in rows_of(batches, "doc_id", "n_tokens", "frame"):
            out = out or Writer(folder, f"ids-{shard:08d}", width, dictionary)
            for row in zip(*rows, strict=True):
                out.add(*row)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [f"ids-{shard:08d}"], "n_docs": [len(out.ids)], "n_tokens": [sum(out.tokens)]})

    frames = Written(
        docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(encoded, "doc_id long, text_hash long, n_tokens long, frame binary"), "ids-frames"
    )
    order = (F.col("doc_id").asc_nulls_first(), F.col("text_hash"))
    dealt = frames.df.repartitionByRange(*order).sortWithinPartitions(*order)
    done = Written(dealt.mapInArrow(run, "shard long, name string, n_docs long, n_tokens long"), "ids-manifest").df
    frames.drop()
    before = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")  # a row per file
    return folder, done.withColumn("start", before)


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, starts in rows_of(batches, "name", "start"):
            for name, start in zip(names, starts, strict=True):
                file = Reader(folder, name)
                for a in range(0, len(file), 4096):
                    b = min(a + 4096, len(file))
                    ends = start + np.cumsum(file.tokens[:b])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file.doc_id(i) for i in range(a, b)], pa.int64()),
                            pa.array(ends[a:b] - file.tokens[a:b]),
                            pa.array(np.array(file.tokens[a:b])),
                            pa.array([zlib.crc32(file[i].astype("<u4").tobytes()) for i in range(a, b)], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                file.close()

    n = max(1, manifest.count())
    return manifest.select("name", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
