"""The window network: its gradient, held-out likelihood, and scores against a plain reimplementation."""

import math
import random
import re

import numpy as np
import pytest

from siltstone.llm import masked_lm, words
from siltstone.llm.masked_lm import Network, Settings, Vocabulary

SCHEMA = "doc_id long, text string, n_words string, word string, key string, numbers string"
SMALL = Settings(words=40, own=6, ranges=3, inputs=20, width=5, shard=400, batch=32)


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w).encode("utf-8", "surrogatepass") for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def test_probabilities_sum_to_one_and_steps_learn():
    s = Settings(inputs=300)
    net = Network(s)
    rng = np.random.Generator(np.random.PCG64(0))
    context = rng.integers(0, s.classes, (4096, 4))
    target = context[:, 1]  # what stands before
    for k in range(3):
        one = np.concatenate([net.log_probabilities(context[:5], np.full(5, c)) for c in range(s.classes)]).reshape(-1, 5)
        assert np.allclose(np.exp(one).sum(axis=0), 1, atol=1e-4)
        net.parts[2][:] *= 1 if k == 0 else 40  # scores beyond the range of exp
    net = Network(s)
    before = -net.log_probabilities(context, target).mean()
    for _ in range(150):
        net.step(context, target)
    assert -net.log_probabilities(context, target).mean() < 0.6 * before


def test_gradient():
    """A step's direction, against differences of the loss."""
    s = Settings(own=5, ranges=2, inputs=6, width=3, rate=1.0)
    rng = np.random.Generator(np.random.PCG64(1))
    context, target = rng.integers(0, s.rows, (50, 4)), rng.integers(0, s.classes, 50)

    def loss(flat):
        return -Network(s, flat).log_probabilities(context, target).astype(np.float64).mean()

    net = Network(s)
    start = net.flat.copy()
    power = [v.copy() for v in net.power]
    net.step(context, target)
    moved = start - net.flat
    v = np.concatenate([x.ravel() for x in net.power]) - np.concatenate([x.ravel() for x in power])
    gradient = np.sign(moved) * np.sqrt(np.maximum(v, 0))
    for i in rng.integers(0, len(start), 60):
        up, down = start.copy(), start.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert gradient[i] == pytest.approx((loss(up) - loss(down)) / 2e-2, abs=2e-3)
    assert net.read.sum() == 200


def test_windows_hide_the_word_itself():
    edge = SMALL.inputs + SMALL.classes
    got = masked_lm.windows(np.array([5, 6, 7, 8]), np.array([3, 0, 1]), SMALL)
    assert got.tolist() == [[edge, edge, 6, 7], [edge, 5, 7, edge], [5, 6, edge, edge], [edge] * 4]


def test_words_are_told_apart():
    texts = ["One two\tTHREE\x0bfour  ", None, "", " \n", "a", "ab abcdefgh abcdefghi Abcdefghi xabcdefgh abcdefgXabcdefgh abcdefgYabcdefgh é É e e", "w" * 30 + " x"]
    h, counts, _, _ = words.word_hashes(texts)
    found = [w for t in texts for w in words_of(t)]
    assert counts.tolist() == [len(words_of(t)) for t in texts]
    assert len(h) == len(found) and len(set(h.tolist())) == len(set(found))
    by: dict = {}
    assert all(by.setdefault(w, x) == x for w, x in zip(found, h.tolist(), strict=True))


def plain_vocabulary(texts, s):
    """(count of each word, vocabulary by falling count): those above the first count that no longer fits whole."""
    counts: dict = {}
    for t in texts:
        for w in words_of(t):
            counts[w] = counts.get(w, 0) + 1
    held: list = []
    for n in sorted(set(counts.values()), reverse=True):
        level = sorted(w for w in counts if counts[w] == n)
        if len(held) + len(level) > s.words:
            break
        held += level
    return counts, held


def plain_score(text, counts, held, flat, s):
    """One text, word by word, from the definitions in the module's docstring."""
    rest, kind, mass = sorted(held[s.own :]), {w: i for i, w in enumerate(held[: s.own])}, 0
    for w in rest:
        kind[w] = s.own + min(int(mass * s.ranges / sum(counts[x] for x in rest)), s.ranges - 1)
        mass += counts[w]
    follows: dict = {}
    for w in counts:
        if w not in kind:
            z = b" " + w + b" "
            for pair in zip(z, z[1:]):
                follows[pair] = follows.get(pair, 0) + counts[w]
    of_class: dict = {}
    for w in kind:
        of_class[kind[w]] = of_class.get(kind[w], 0) + counts[w]
    other = s.classes - 1
    row = lambda w: held.index(w) if w in kind and held.index(w) < s.inputs else s.inputs + kind.get(w, other)
    shapes = [(s.rows, s.width), (2 * s.side, s.width), (s.width, s.classes), (s.classes,)]
    e, p, u, b = (x.reshape(shape) for x, shape in zip(np.split(flat.astype(np.float64), np.cumsum([math.prod(x) for x in shapes])[:-1]), shapes, strict=True))
    words, total = words_of(text), 0.0
    for i, w in enumerate(words):
        around = [words[j] if 0 <= j < len(words) else None for j in (i - 2, i - 1, i + 1, i + 2)]
        hidden = np.tanh(sum(e[s.rows - 1 if x is None else row(x)] * p[k] for k, x in enumerate(around)))
        z = np.exp(hidden @ u + b)
        c = kind.get(w, other)
        total += math.log(z[c] / z.sum())
        if w in kind:
            total += math.log(counts[w] / of_class[c])
        else:
            spelled = b" " + w + b" "
            for x, y in zip(spelled, spelled[1:]):
                total += math.log((follows.get((x, y), 0) + 0.05) / (sum(n for (a, _), n in follows.items() if a == x) + 0.05 * 256))
    return len(words), total


def test_scores_against_a_plain_version(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "Of", "a", "é", *[f"w{k}" for k in range(12)], *[f"rare{k}" for k in range(60)]]) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    texts += [None, "", " \n\t", "never", "x" * 300]
    docs = spark.createDataFrame([(i, t, "clash", "clash", "", "") for i, t in enumerate(texts)], SCHEMA)
    counts, held = plain_vocabulary(texts, SMALL)
    vocabulary, total = masked_lm.learn_vocabulary(docs, SMALL)
    assert total == sum(counts.values()) and len(vocabulary.known) == len(held)
    flat = masked_lm.train(masked_lm.numbered(docs, vocabulary), vocabulary.class_of, total, SMALL)
    got = {r["doc_id"]: r for r in masked_lm.score(docs, settings=SMALL).collect()}
    for i, t in enumerate(texts):
        n, want = plain_score(t, counts, held, flat, SMALL)
        assert got[i]["n_words"] == n and got[i]["log_likelihood"] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_a_position_sums_to_one():
    """Over words of the vocabulary and the only spellings that were seen, "a" and "ab"."""
    s = Settings(words=8, own=3, ranges=2, inputs=4)
    spelled = np.zeros((256, 256))
    spelled[32, 97] = spelled[97, 32] = spelled[97, 98] = spelled[98, 32] = 1e6
    names = [b"u", b"v", b"w", b"x", b"y"]
    v = Vocabulary(names, np.array([50, 40, 30, 20, 10]), spelled, s)
    inner = {t: (v.of([t])[0][0], v.of([t])[2][0]) for t in [*(n.decode() for n in names), "a", "ab"]}
    net = Network(s)
    context = np.array([[0, 1, 2, s.inputs]])
    total = sum(math.exp(net.log_probabilities(context, v.class_of[[k]])[0] + x) for k, x in inner.values())
    assert total == pytest.approx(1, abs=1e-2)


def test_training_depends_on_rows_not_on_layout(spark, sf):
    s = Settings(words=500, own=20, ranges=10, inputs=100, shard=3_000, batch=256)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    flats, scores = [], []
    for n in (1, 7):
        dealt = docs.repartition(n)
        vocabulary, total = masked_lm.learn_vocabulary(dealt, s)
        flats.append(masked_lm.train(masked_lm.numbered(dealt, vocabulary), vocabulary.class_of, total, s))
        scores.append([r["log_likelihood"] for r in masked_lm.score(dealt, settings=s).orderBy("doc_id").collect()])
    assert (flats[0] == flats[1]).all() and total > 4 * s.shard
    assert scores[0] == pytest.approx(scores[1], rel=1e-6)


def grammar(rng, n):
    """Pairs of words that always stand together, in random order of pairs."""
    pairs = [(f"l{i}", f"r{i}") for i in range(12)]
    return " ".join(w for _ in range(n) for w in rng.choice(pairs))


def test_held_out_text_beats_chance_and_shuffling(spark):
    rng = random.Random(5)
    train = [(i, grammar(rng, 60)) for i in range(400)]
    held = [grammar(rng, 60) for _ in range(20)]
    mixed = [" ".join(rng.sample(t.split(), 120)) for t in held]
    s = Settings(own=24, ranges=2, inputs=24, rounds=3, batch=256)
    docs = spark.createDataFrame([(i, t) for i, t in train], "doc_id long, text string")
    vocabulary, total = masked_lm.learn_vocabulary(docs, s)
    net = Network(s, masked_lm.train(masked_lm.numbered(docs, vocabulary), vocabulary.class_of, total, s))

    def score(texts):
        return masked_lm.score_rows([vocabulary.of([t])[0].astype("<u2").tobytes() for t in texts], net, vocabulary.class_of)

    n, good = score(held)
    _, bad = score(mixed)
    assert good.sum() / n.sum() > np.log(1 / 24) * 0.75  # chance is 1/24 a word
    assert (good > bad).all()


def test_documents_held_out_beat_single_word_frequencies(spark, sf):
    """Classes predicted from both sides against their frequencies, on every tenth document, never trained on."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    s = Settings(batch=512, rounds=3)
    vocabulary, _ = masked_lm.learn_vocabulary(docs, s)
    rows = masked_lm.numbered(docs, vocabulary).dropDuplicates(["key"])
    seen, held = rows.filter("doc_id % 10 <> 0"), rows.filter("doc_id % 10 = 0")
    net = Network(s, masked_lm.train(seen, vocabulary.class_of, 1, s))
    n, total = masked_lm.score_rows([bytes(r[0]) for r in held.select("numbers").collect()], net, vocabulary.class_of)
    of = lambda df: vocabulary.class_of[np.frombuffer(b"".join(bytes(r[0]) for r in df.select("numbers").collect()), dtype="<u2")]
    share = np.bincount(of(seen), minlength=s.classes) + 0.5
    alone = np.log(share / share.sum())[of(held)].mean()
    assert total.sum() / n.sum() > alone + 0.2


def test_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(*r, "clash", "clash", "", "") for r in docs.collect()] + [(900, None, "", "", "", ""), (901, " \n", "", "", "", ""), (None, "the the", "", "", "", ""), (None, "the the", "", "", "", "")]
    rows.append((902, "word " * 200_000, "", "", "", ""))
    got = masked_lm.score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[900]["log_likelihood"] == 0 and by[900]["mean_log_likelihood"] is None
    assert by[902]["n_words"] == 200_000
    assert len({tuple(r) for r in got if r["doc_id"] is None}) == 1
    assert all(r["mean_log_likelihood"] < 0 for r in got if r["n_words"])
    assert masked_lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
