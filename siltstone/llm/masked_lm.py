"""LM scoring by masked pseudo-likelihood: a window network predicts each word from both sides.

The probability of a word is that of its class, which the network gives from
the words around it, times that of the word in its class. The most frequent
words are classes of their own. Other words of the vocabulary fall into ranges
of the alphabet, where they count by their frequency. All other words are one
class, in which a word is spelled byte by byte. So every word has a
probability, and those of one position sum to one (but for what spelling gives
to words of the vocabulary).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, rows_of, short_batches
from .words import SPACE, split, word_hashes

BLOCK_CHARS = 200_000  # numbered together (a longer text alone)
FAN_IN = 64  # trained parameters added by one task
PARTS = 8  # of the embeddings, added apart


@dataclass(frozen=True)
class Settings:
    """The vocabulary has at most ``words`` words: all that occur more often than the first that is left out.

    ``own`` words are classes of their own, ``ranges`` share the rest, and
    there is a class for words outside. As context, ``inputs`` words have
    embeddings of their own, others that of their class. Training reads every
    word of every document in each of ``rounds`` rounds. A round deals
    documents, by hash, to shards of about ``shard`` words; every shard starts
    from the same parameters, and results are averaged, embeddings by how often
    a shard read them. So what is learnt depends on the rows alone, not on how
    they are stored or on the cluster.
    """

    words: int = 131_072
    own: int = 119
    ranges: int = 120
    inputs: int = 8_192
    side: int = 2
    width: int = 16
    rounds: int = 1
    shard: int = 4_000_000
    batch: int = 4_096
    rate: float = 0.15
    seed: int = 11

    @property
    def classes(self) -> int:
        return self.own + self.ranges + 1

    @property
    def rows(self) -> int:
        """Embeddings: words, classes, and what stands before the first and after the last word."""
        return self.inputs + self.classes + 1


class Vocabulary:
    """Numbers and classes of words, and their log-probabilities within a class."""

    def __init__(self, words: list[bytes], counts: np.ndarray, spelled: np.ndarray, s: Settings):
        """``words`` by falling count; ``spelled``: how often a byte follows another in words outside, space at both ends."""
        self.s = s
        n = len(words)
        counts = np.asarray(counts, dtype=np.float64)
        kind = np.minimum(np.arange(n), s.own)
        rest = np.arange(s.own, n)
        if len(rest):  # ranges of the alphabet of about equal counts
            rest = np.array(sorted(rest.tolist(), key=words.__getitem__))
            before = np.cumsum(counts[rest]) - counts[rest]
            kind[rest] = s.own + np.minimum((before * s.ranges / counts[rest].sum()).astype(int), s.ranges - 1)
        total = np.bincount(kind, weights=counts, minlength=s.classes) if n else np.zeros(s.classes)
        h = word_hashes([b"\n".join(words).decode("utf-8", "surrogatepass")])[0]
        order = np.argsort(h)
        self.known = h[order]
        number = np.where(np.arange(n) < s.inputs, np.arange(n), s.inputs + kind)
        self.number = number[order].astype(np.uint16)
        self.inner = (np.log(counts) - np.log(total[kind]))[order] if n else np.zeros(0)
        self.other, self.edge = s.inputs + s.classes - 1, s.inputs + s.classes
        self.class_of = np.concatenate([kind[: s.inputs], np.zeros(max(0, s.inputs - n), dtype=int), np.arange(s.classes), [0]]).astype(np.int32)
        smooth = spelled + 0.05
        self.spelled = np.log(smooth / smooth.sum(axis=1, keepdims=True))

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of all words, words of each text, log-probabilities of its words within their classes, summed)."""
        h, counts, raw, (starts, ends) = word_hashes(texts)
        number = np.full(len(h), self.other, dtype=np.uint16)
        inner = np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        hit = self.known[at] == h if len(self.known) else np.zeros(len(h), dtype=bool)
        number[hit], inner[hit] = self.number[at[hit]], self.inner[at[hit]]
        out = np.flatnonzero(~hit)
        if len(out):
            plain = np.where(SPACE[raw], 0x20, raw)
            upto = np.concatenate([[0], np.cumsum(self.spelled[plain[:-1], plain[1:]])])
            inner[out] = upto[ends[out]] - upto[starts[out] - 1]
        text = np.repeat(np.arange(len(texts)), counts)
        return number, counts, np.bincount(text, weights=inner, minlength=len(texts))


class Network:
    """Position-weighted sum of the context's embeddings, tanh, softmax over classes."""

    def __init__(self, s: Settings, flat: np.ndarray | None = None):
        self.s = s
        self.shapes = ((s.rows, s.width), (2 * s.side, s.width), (s.width, s.classes), (s.classes,))
        if flat is None:
            rng = np.random.Generator(np.random.PCG64(s.seed))
            draws = [rng.standard_normal(shape) for shape in self.shapes]
            flat = np.concatenate([(0.1 * draws[0]).ravel(), (1 + 0.02 * draws[1]).ravel(), (0.1 * draws[2]).ravel(), np.zeros(s.classes)])
        self.flat = flat.astype(np.float32).copy()
        self.parts, at = [], 0
        for shape in self.shapes:
            size = int(np.prod(shape))
            self.parts.append(self.flat[at : at + size].reshape(shape))
            at += size
        self.power = [np.full(x.shape, 1e-3, dtype=np.float32) for x in self.parts]
        self.read = np.zeros(s.rows)
        self.room = [np.empty((0, s.classes), dtype=np.float32)] * 2

    def hidden(self, context: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        e, p = self.parts[:2]
        embedded = [e[context[:, k]] for k in range(context.shape[1])]
        total = embedded[0] * p[0]
        for x, w in zip(embedded[1:], p[1:], strict=True):
            total += x * w
        return embedded, np.tanh(total, out=total)

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exp of each class's score, their sum) of a batch of contexts."""
        return self._scores(self.hidden(context)[1])[1:]

    def _scores(self, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, b = self.parts[2:]
        n = len(hidden)
        if n > len(self.room[0]):  # kept between calls: new memory costs more than what is computed in it
            self.room = [np.empty((n, self.s.classes), dtype=np.float32) for _ in range(2)]
        z = np.matmul(hidden, u, out=self.room[0][:n])
        z += b
        if float((np.abs(u).sum(axis=0) + np.abs(b)).max()) > 60:  # else no score can leave the range of exp
            z -= z.max(axis=1, keepdims=True)
        x = np.exp(z, out=self.room[1][:n])
        return z, x, x @ np.ones(x.shape[1], dtype=np.float32)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        z, _, total = self._scores(self.hidden(context)[1])
        return z[np.arange(len(target)), target] - np.log(total)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        """One step of Adagrad on a batch."""
        e, p, u, _ = self.parts
        embedded, hidden = self.hidden(context)
        _, g, total = self._scores(hidden)
        g *= (1 / (len(target) * total))[:, None]
        g[np.arange(len(target)), target] -= 1 / len(target)
        du, db = hidden.T @ g, g.sum(axis=0)
        dh = g @ u.T
        dh *= 1 - hidden * hidden
        dp = np.stack([(x * dh).sum(axis=0) for x in embedded])
        rows = context.T.ravel()
        order = np.argsort(rows, kind="stable")
        change = np.flatnonzero(np.diff(rows[order], prepend=-1))
        seen = rows[order[change]]
        de = np.add.reduceat(np.concatenate([dh * w for w in p])[order], change, axis=0)
        self.read[seen] += np.diff(np.append(change, len(rows)))
        v = self.power[0][seen] + de * de
        self.power[0][seen] = v
        e[seen] -= self.s.rate * de / np.sqrt(v)
        for x, d, v in zip(self.parts[1:], (dp, du, db), self.power[1:], strict=True):
            v += d * d
            x -= self.s.rate * d / np.sqrt(v)


def windows(numbers: np.ndarray, counts: np.ndarray, s: Settings) -> np.ndarray:
    """Numbers around each word of texts in a row, without its own."""
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(numbers)) + s.side * (text + 1)
    line = np.full(len(numbers) + s.side * (len(counts) + 1), s.inputs + s.classes, dtype=np.uint16)
    line[place] = numbers
    return np.stack([line[place + k] for k in range(-s.side, s.side + 1) if k], axis=1)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            part = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return part

        seen: Counter[bytes] = Counter()
        for (texts,) in rows_of(batches, "text"):
            for text in texts:
                seen.update(split(text))
                if len(seen) > 200_000:
                    yield out()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): how often a byte follows another in words, a space before and after each."""
    total = np.zeros(1 << 16)
    for batch in batches:
        words, n = batch.column("word").to_pylist(), np.asarray(batch.column("n"), dtype=np.float64)
        raw = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        pair = (raw[:-1] << 8 | raw[1:])[: int(sizes.sum())]
        total += np.bincount(pair, weights=np.repeat(n, sizes), minlength=1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def learn_vocabulary(docs: DataFrame, s: Settings) -> tuple[Vocabulary, int]:
    """(vocabulary, words of all documents). The driver holds the vocabulary and counts by frequency."""
    counts = Written(count_words(docs), "lm-counts")
    by_count = counts.df.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
    total, held, least = sum(r["n"] * r["words"] for r in by_count), 0, 1 << 62
    for r in by_count:
        held += r["words"]
        if held > s.words:
            break
        least = r["n"]
    top = counts.df.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").collect()
    spelled = np.zeros((256, 256))
    for r in counts.df.filter(F.col("n") < least).mapInArrow(follow, "pair long, n double").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        spelled[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    counts.drop()
    return Vocabulary([bytes(r["word"]) for r in top], np.array([r["n"] for r in top]), spelled, s), total


def numbered(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, key, numbers, inner): each text's words as two bytes each, and what they have within their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            place = np.cumsum([len(t) for t in texts]) // BLOCK_CHARS
            edge = [*np.flatnonzero(np.diff(place, prepend=-1)).tolist(), len(texts)]
            for i, j in zip(edge, edge[1:]):
                number, n, inner = vocabulary.of(texts[i:j])
                cut = (2 * np.concatenate([[0], np.cumsum(n)])).tolist()
                data = number.astype("<u2").tobytes()
                part = batch.slice(i, j - i).select(["doc_id", "key"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([data[a:b] for a, b in zip(cut, cut[1:])], pa.binary()), pa.array(inner)], ["doc_id", "key", "numbers", "inner"])

    return docs.withColumn("key", F.xxhash64("doc_id", "text")).mapInArrow(run, "doc_id long, key long, numbers binary, inner double")


class Shard:
    """Trains on documents as they come; the same documents in the same order give the same parameters."""

    def __init__(self, s: Settings, flat: np.ndarray, class_of: np.ndarray, seed: int):
        self.net, self.class_of, self.held, self.size, self.seen = Network(s, flat), class_of, [], 0, 0
        self.rng = np.random.Generator(np.random.PCG64(seed))

    def add(self, numbers: np.ndarray) -> None:
        self.held.append(numbers)
        self.size += len(numbers)
        if self.size >= 16 * self.net.s.batch:
            self.learn()

    def learn(self) -> None:
        if not self.size:
            return
        s, numbers = self.net.s, np.concatenate(self.held)
        context = windows(numbers, np.array([len(x) for x in self.held]), s)
        target, mixed = self.class_of[numbers], self.rng.permutation(len(numbers))
        for i in range(0, len(mixed), s.batch):
            at = mixed[i : i + s.batch]
            self.net.step(context[at], target[at])
        self.seen += self.size
        self.held, self.size = [], 0

    def sums(self) -> list[bytes]:
        """Parameters times the words they were read for, and these counts: embeddings in parts, then the rest."""
        self.learn()
        net, read = self.net, self.net.read
        rows = np.concatenate([net.parts[0] * read[:, None], read[:, None]], axis=1)
        rest = np.concatenate([*(x.ravel() for x in net.parts[1:]), [1.0]]) * self.seen
        return [x.tobytes() for x in (*np.array_split(rows, PARTS), rest)]


def averaged(data: list[bytes], flat: np.ndarray, s: Settings) -> np.ndarray:
    """Parameters from the added sums; those that no word has read stay."""
    net = Network(s, flat)
    rows = np.concatenate([np.frombuffer(x) for x in data[:-1]]).reshape(s.rows, s.width + 1)
    seen = rows[:, -1] > 0
    net.parts[0][seen] = (rows[seen, :-1] / rows[seen, -1:]).astype(np.float32)
    rest = np.frombuffer(data[-1])
    if rest[-1]:
        net.flat[s.rows * s.width :] = (rest[:-1] / rest[-1]).astype(np.float32)
    return net.flat


def train(rows: DataFrame, class_of: np.ndarray, total: int, s: Settings) -> np.ndarray:
    """Parameters of a network trained on all numbered documents."""
    flat = Network(s).flat
    shards = max(1, -(-total // s.shard))
    for turn in range(s.rounds):
        now = flat.tobytes()

        def run(batches: Iterator[pa.RecordBatch], now: bytes = now, turn: int = turn) -> Iterator[pa.RecordBatch]:
            def out() -> pa.RecordBatch:
                data = own.sums()
                return pa.RecordBatch.from_arrays([pa.array([at] * len(data)), pa.array(range(len(data)), pa.int64()), pa.array(data, pa.binary())], ["shard", "part", "data"])

            own, at = None, -1
            for shard, numbers in rows_of(batches, "shard", "numbers"):
                for k, data in zip(shard, numbers, strict=True):
                    if k != at:
                        if own:
                            yield out()
                        own, at = Shard(s, np.frombuffer(now, dtype=np.float32), class_of, 1000 * turn + k), k
                    own.add(np.frombuffer(data, dtype="<u2"))
            if own:
                yield out()

        def add(table: pa.Table) -> pa.Table:
            table = table.sort_by("shard")
            total = sum(np.frombuffer(x.as_py()) for x in table.column("data"))
            return pa.table({"shard": [table.column("shard")[0].as_py() // FAN_IN], "part": table.column("part")[:1], "data": [total.tobytes()]})

        kind = "shard long, part long, data binary"
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(shards)))
        sums = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key").select("shard", "numbers").mapInArrow(run, kind)
        left = shards
        while left > 1:
            sums = sums.groupBy("part", F.floor(F.col("shard") / FAN_IN)).applyInArrow(add, kind)
            left = -(-left // FAN_IN)
        found = sorted((r["part"], bytes(r["data"])) for r in sums.collect())
        if found:
            flat = averaged([x for _, x in found], flat, s)
    return flat


def score_rows(numbers: list[bytes], net: Network, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, summed conditional log-probability of their classes) of each text."""
    counts = np.array([len(x) // 2 for x in numbers])
    all_, total = np.frombuffer(b"".join(numbers), dtype="<u2"), np.zeros(len(numbers))
    context, of = windows(all_, counts, net.s), np.repeat(np.arange(len(counts)), counts)
    for i in range(0, len(all_), 2048):
        part = slice(i, i + 2048)
        total += np.bincount(of[part], weights=net.log_probabilities(context[part], class_of[all_[part]]), minlength=len(numbers))
    return counts, total


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) for every row of ``docs``.

    The network learns from all documents, then every word of every text is
    predicted from the words on both sides. Null and empty texts have no words,
    likelihood 0 and a null mean; a text of any length is scored whole;
    repeated rows get equal scores and weigh as often as they occur; words that
    tie at the vocabulary's edge are all left out of it; an empty table gives
    no rows; other columns are not read.
    """
    short_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary, total = learn_vocabulary(docs, settings)
    class_of = vocabulary.class_of
    rows = Written(numbered(docs, vocabulary), "lm-numbers").df
    trained = train(rows, class_of, total, settings).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(settings, np.frombuffer(trained, dtype=np.float32))
        for batch in batches:
            if batch.num_rows:
                n, total = score_rows(batch.column("numbers").to_pylist(), net, class_of)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total + np.asarray(batch.column("inner")))], ["doc_id", "n_words", "log_likelihood"])

    scored = rows.select("doc_id", "numbers", "inner").mapInArrow(run, "doc_id long, n_words long, log_likelihood double")
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
