"""Fingerprints bit by bit, and links against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from siltstone.llm import graph, simhash

SCHEMA = "doc_id long, text string, fp long, root long, kept string"


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps: list[int]) -> dict[int, int]:
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = sorted(parent)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    return {f: find(f) for f in own}


@pytest.mark.parametrize("text", [None, "", "One", "a b c", "a b c d", "A b\u00a0c d e\tf É", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint(text)


def test_groups_against_all_pairs(spark, sf):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    base = docs[0][1]
    words = base.split()
    for k in range(40):
        w = list(words)
        w[k * 3 % len(w)] = f"other{k}"
        docs.append((1000 + k, " ".join(w)))
    docs += [(2000 + k, base) for k in range(40)] + [(3000, None), (3001, ""), (None, base), (None, None), (2000, base), (5, "one two three")]
    rows = [(*d, 1, 2, "clash") for d in docs]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    fps = {t: fingerprint(t) for _, t in docs}
    root = roots(list(fps.values()))
    least: dict = {}
    for i, t in docs:
        if i is not None:
            least[root[fps[t]]] = min(i, least.get(root[fps[t]], i))
    want = sorted((i if i is not None else -1, f"{fps[t]:016x}", least[root[fps[t]]]) for i, t in docs)
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in got) == want
    kept = [(r["component_id"], r["doc_id"]) for r in got if r["kept"]]
    assert sorted({c for c, _ in kept}) == sorted(set(least.values())) and all(a == b for a, b in kept)


@pytest.mark.parametrize("unit", [16_384, 8])
def test_links_lose_nothing(spark, unit):
    """Random fingerprints with planted neighbours, in whole groups and in pairs of blocks."""
    rng = random.Random(unit)
    fps = [rng.getrandbits(64) for _ in range(200)] + [0, (1 << 64) - 1]
    for f in list(fps):
        for d in range(6):
            g = f
            for b in rng.sample(range(64), d):
                g ^= 1 << b
            fps.append(g)
    chain = [fps[0]]
    for _ in range(60):
        chain.append(chain[-1] ^ 1 << rng.randrange(64))
    fps = sorted(set(fps + chain))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "node long"), unit)
    for a, b in found.collect():
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
    got = {r["node"]: r["root"] for r in graph.components(found).collect()}
    want = roots(fps)
    group: dict = {}
    for f, s in zip(fps, signed, strict=True):
        group.setdefault(want[f], []).append(s)
    for members in group.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_layouts_cover_every_link():
    rng = random.Random(1)
    for blocks, intact in simhash.LAYOUTS:
        keys = simhash.masks(blocks, intact)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(m & diff == 0 for m in keys)
    assert [simhash.layout(n) for n in (0, 10**6, 10**9, 10**12)] == [(6, 2), (6, 2), (7, 3), (8, 4)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4000), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in range(1000, 1200)} == {1000} and got[5000] == got[4000] == 4000
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pivot_filter_is_sound():
    rng = np.random.Generator(np.random.PCG64(2))
    fps = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    other = fps ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64))
    both = np.concatenate([fps, other])
    assert len(simhash.near(both, simhash.to_pivots(both), np.arange(2000), np.arange(2000, 4000))) == 2000
