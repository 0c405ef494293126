"""Near-duplicates by similarity against all pairs."""

import random
import re

import numpy as np
import pytest

from siltstone.llm import similar

SCHEMA = "doc_id long, text string, node long, w string, head string, kept string"


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def classes(texts):
    """A number for each text: equal for those that links of 0.8 or more connect."""
    sets, of = [plain(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if of[i] != of[j] and likeness(sets[i], sets[j]) >= 0.8:
                old, new = of[i], of[j]
                of = [new if x == old else x for x in of]
    return of


def changed(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(words)), n):
        out[i] = f"new{rng.random()}"
    return " ".join(out)


def corpus(seed=1):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 400))]
        texts.append(" ".join(words))
        for share in (0.005, 0.01, 0.02, 0.03, 0.06):
            texts.append(changed(words, int(share * len(words)), rng))
    hot = [f"h{k}" for k in range(300)]
    texts += [changed(hot, rng.randrange(0, 6), rng) for _ in range(150)]  # more than FEW
    return texts + [None, "", " \n", "One", "one", "a b c", "A b C", "long " * 60_000, "long " * 60_000 + "end"]


@pytest.mark.parametrize("unit", [16_384, 40])
def test_groups_against_all_pairs(spark, unit):
    texts = corpus()
    rows = [(i, t, 1, "clash", "clash", "clash") for i, t in enumerate(texts)]
    got = similar.similar_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), settings=similar.Settings(unit=unit)).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    of = classes(texts)
    least = {c: of.index(c) for c in of}
    for r in got:  # never linked below the similarity
        assert of[r["component_id"]] == of[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    right = sum(r["component_id"] == least[of[r["doc_id"]]] for r in got)
    assert right >= 0.97 * len(texts)
    assert len({r["component_id"] for r in got if of[r["doc_id"]] == of[240]}) == 1  # the hot group


@pytest.mark.parametrize("unit", [16_384, 40])
def test_no_link_of_a_large_group_is_left_out(spark, unit):
    """Over FEW texts about the threshold: a shortest tree holds few of their links."""
    rng = random.Random(5)
    texts = [changed([f"t{k}" for k in range(200)], 3, rng) for _ in range(250)]
    rows = [(i, t, 1, "", "", "") for i, t in enumerate(texts)]
    got = similar.similar_documents(spark.createDataFrame(rows, SCHEMA), settings=similar.Settings(unit=unit)).collect()
    of = classes(texts)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: of.index(c) for i, c in enumerate(of)}
    assert 20 < len(set(of)) < 100


@pytest.mark.parametrize("often", [16, 1])
def test_first_shingles_meet(spark, often, monkeypatch):
    """Without any other link, all that is similar meets by its first shingles, whatever their order."""
    monkeypatch.setattr(similar, "OFTEN", often)
    monkeypatch.setattr(similar, "SAMPLE", 2)
    texts = [t for t in corpus(4)[:300:2] if t]
    df = spark.createDataFrame(list(enumerate(texts)), "text_hash long, text string")
    got = {tuple(sorted(r)) for r in similar.left(df, spark.createDataFrame([], "node long, root long"), similar.Settings()).collect()}
    sets = [plain(t) for t in texts]
    node = [int(np.uint64(similar.name(similar.shingles(t, 5))).astype(np.int64)) for t in texts]
    want = {tuple(sorted((node[i], node[j]))) for i in range(len(texts)) for j in range(i) if node[i] != node[j] and likeness(sets[i], sets[j]) >= 0.8}
    assert want <= got and len(want) > 100


@pytest.mark.parametrize("unit", [16_384, 100])
def test_a_common_passage_makes_no_pairs(spark, unit, monkeypatch):
    """Texts that share half of themselves are unlike: their number of pairs does not grow with its square."""
    monkeypatch.setattr(similar, "OFTEN", 10_000)  # no shingle counts as frequent
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(100)]
    texts = [" ".join([*passage, *(f"{k}x{i}" for k in range(40))]) for i in range(200)]
    texts += [changed(passage * 5 + [f"q{k}" for k in range(3000)], rng.randrange(50), rng) for _ in range(70)]  # long, more than FEW, all links
    df = spark.createDataFrame(list(enumerate(texts)), "text_hash long, text string")
    got = {tuple(sorted(r)) for r in similar.left(df, spark.createDataFrame([], "node long, root long"), similar.Settings(unit=unit)).collect()}
    sets = [plain(t) for t in texts]
    node = [int(np.uint64(similar.name(similar.shingles(t, 5))).astype(np.int64)) for t in texts]
    want = {tuple(sorted((node[i], node[j]))) for i in range(len(texts)) for j in range(i) if node[i] != node[j] and likeness(sets[i], sets[j]) >= 0.8}
    assert want <= got and len(want) > 2000
    short = set(node[:200])
    assert not [p for p in got if short & set(p)]


@pytest.mark.parametrize("n", [3, 90, 700, 5000])
def test_parities_differ_in_no_more_than_the_sets(n):
    rng = np.random.Generator(np.random.PCG64(4))
    s, pool = similar.Settings(), rng.integers(1, 1 << 63, 3 * n, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(n // 2, n + 1), replace=False)) for _ in range(20)]
    sets += [np.unique(np.append(x[: len(x) - k], pool[:k])) for x in sets for k in (0, len(x) // 20, len(x) // 9, len(x) // 5)]
    bits = similar.Parities([similar.parity(x) for x in sets] + [None])
    i, j = np.triu_indices(len(sets), 1)
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert len(bits.within(i, j, apart)) == len(i)
    size = np.array([len(x) for x in sets])
    links = np.array([likeness(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8 for a, b in zip(i, j)])
    assert (links == (apart <= s.apart(size[i], size[j]))).all() and links.any()
    assert len(bits.within(i, j, s.apart(size[i], size[j]))) < len(i)
    none = np.full(5, len(sets))
    assert len(bits.within(none, np.arange(5), np.zeros(5))) == 5


def test_odd_rows(spark):
    rows = [(7, "x y", 0, "", "", ""), (7, "x y", 0, "", "", ""), (None, "X  y", 0, "", "", ""), (9, None, 0, "", "", ""), (None, None, 0, "", "", "")]
    got = similar.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got) == [(-1, 7, False), (-1, 9, False), (7, 7, True), (7, 7, True), (9, 9, True)]
    assert similar.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", [None, "", "one", "a b c d e", "A b c d e f", "x " * 300])
def test_shingles(text):
    assert len(similar.shingles(text, 5)) == len(plain(text))


def test_similar_sets_differ_in_few_bits():
    s, rng = similar.Settings(), random.Random(3)
    words = [f"w{k}" for k in range(600)]
    a, inside = similar.shingles(" ".join(words), 5), 0
    for _ in range(200):
        b = similar.shingles(changed(words, 12, rng), 5)  # about 0.82
        inside += int(similar.apart(similar.wide(a), similar.wide(b))) <= s.distance
    assert inside >= 197


def test_nearest_tree_is_a_shortest_one():
    rng = np.random.Generator(np.random.PCG64(2))
    base = rng.integers(0, 1 << 63, (5, similar.WIDE), dtype=np.uint64)
    w = np.repeat(base, 30, axis=0)
    for row in w:
        for bit in rng.integers(0, 256, 20):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    i, j = similar.nearest_tree(w, 50)
    d = similar.apart(w[:, None], w[None]).astype(int)
    inside, total = {0}, 0  # Prim's rule, plainly
    while len(inside) < len(w):
        cost, x = min((min(d[y, z] for z in inside), y) for y in range(len(w)) if y not in inside)
        inside.add(x)
        total += cost if cost <= 50 else 0
    assert d[i, j].sum() == total and len(i) == len(w) - 5
