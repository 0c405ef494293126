"""Links of embeddings against all cosines."""

import numpy as np
import pytest

from siltstone.llm import nn_descent
from siltstone.llm.nn_descent import Settings

SCHEMA = "vec_id long, embedding array<float>, x string, w string, root long"


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([v / np.sqrt((v * v).sum()) for _, v in ok])
    hit = m @ m.T >= threshold
    np.fill_diagonal(hit, False)
    label = list(range(len(ok)))
    changed = True
    while changed:
        new = [min([label[i], *[label[j] for j in np.flatnonzero(hit[i])]]) for i in range(len(ok))]
        changed, label = new != label, new
    least = {}
    for (i, _), c in zip(ok, label, strict=True):
        least[c] = min(i, least.get(c, i))
    out = {i: (int(hit[k].sum()), least[label[k]]) for k, (i, _) in enumerate(ok)}
    return {i: out.get(i, (0, i)) for i, _ in rows}


def rows_with_groups(n=600, seed=1):
    rng = np.random.Generator(np.random.PCG64(seed))
    base = rng.standard_normal((n, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for k in range(40):
        rows.append((1000 + k, (base[k] + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist()))
    for k in range(150):  # more than a list holds
        rows.append((2000 + k, (base[50] + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist()))
    rows += [(3000 + k, base[60].tolist()) for k in range(80)] + [(3100 + k, (2 * base[60]).tolist()) for k in range(3)]
    bad = base[0].tolist()
    rows += [(4000, None), (4001, [0.0] * 16), (4002, [None, *bad[1:]]), (4003, [float("nan"), *bad[1:]]), (4004, [float("inf"), *bad[1:]]), (4005, bad[:8])]
    return rows


def run(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "clash", "clash", 3) for r in rows], SCHEMA)
    return nn_descent.near_duplicates(df, settings=Settings(**settings))


def test_against_all_pairs(spark):
    rows = rows_with_groups()
    got = run(spark, rows, block=64).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    links = sum(n for n, _ in want.values())
    assert sum(r["n_links"] for r in got) >= 0.98 * links
    for r in got:
        assert r["n_links"] <= want[r["vec_id"]][0]  # none below the threshold
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    same = sum((r["n_links"], r["component_id"]) == want[r["vec_id"]] for r in got)
    assert same >= 0.98 * len(rows)
    by = {r["vec_id"]: r for r in got}
    assert by[3000]["n_links"] == want[3000][0] and by[2000]["n_links"] == want[2000][0]


def test_repeated_ids_null_ids_and_no_rows(spark):
    v = [1.0] + [0.0] * 15
    got = run(spark, [(7, v), (7, v), (None, v), (9, [0.0, 1.0] + [0.0] * 14)]).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in got) == [(-1, 2, 7), (7, 2, 7), (7, 2, 7), (9, 0, 9)]
    assert run(spark, []).count() == 0


@pytest.mark.parametrize("seed", [2, 3])
def test_recall_on_other_seeds(spark, seed):
    rows = rows_with_groups(300, seed)
    want, got = brute(rows), run(spark, rows).collect()
    assert sum(r["n_links"] for r in got) >= 0.98 * sum(n for n, _ in want.values())


def test_two_groups_larger_than_a_list_are_joined(spark):
    """Every list is full of vectors of its own group, and all links across are weaker."""
    rng = np.random.Generator(np.random.PCG64(4))
    axes = np.linalg.qr(rng.standard_normal((16, 16)))[0]
    centres = [axes[0], 0.965 * axes[0] + np.sqrt(1 - 0.965**2) * axes[1]]
    rows = []
    for k in range(60):
        off = axes[2:].T @ rng.standard_normal(14)
        rows.append((k, (centres[k % 2] + 0.045 * off / np.linalg.norm(off)).astype(np.float32).tolist()))
    want = brute(rows)
    assert {c for _, c in want.values()} == {0} and all(n == 59 for n, _ in want.values())
    got = run(spark, rows).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


def test_ties_connect_what_all_pairs_connect():
    rng = np.random.Generator(np.random.PCG64(6))
    x = nn_descent.scaled(np.repeat(rng.standard_normal((12, 16)), 8, axis=0) + 0.15 * rng.standard_normal((96, 16)))
    sims, s = x @ x.T, Settings()
    i, j = nn_descent.ties(sims, s)

    def label(pairs):
        of = list(range(96))
        for a, b in pairs:
            old, new = of[a], of[b]
            of = [new if v == old else v for v in of]
        return {frozenset(np.flatnonzero(np.array(of) == v).tolist()) for v in of}

    hit = np.argwhere(np.triu(sims >= s.threshold, 1))
    assert label([(a, b) for a, b in zip(i, j, strict=True) if sims[a, b] >= s.threshold]) == label(hit)


def test_pairs_meet_as_often_in_large_tables():
    s = Settings()
    for n in (5e4, 1e6, 2e7):
        bits = int(np.ceil(np.log2(n / s.group)))
        together = (1 - np.arccos(s.threshold) / np.pi) ** bits
        assert 1 - (1 - together) ** s.cuts(bits) >= s.met


def test_audit_counts_vectors_not_links(spark):
    """One large group is complete, a pair is missed: few links, but half of its kind of vectors."""
    rows = [(k, [1.0, 0.0], 1) for k in range(40)] + [(100 + k, [0.0, 1.0], 1) for k in range(2)]
    nodes = spark.createDataFrame(rows, "u long, x array<double>, w long")
    found = spark.createDataFrame([(k, 39) for k in range(40)], "u long, n long")
    assert nn_descent.audit(nodes, found, Settings()) == [(0, 2), (40, 40)]
