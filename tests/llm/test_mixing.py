"""Mixing against iterative resharing, in exact arithmetic."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string"


def reshare(sizes: dict, share=Fraction(3, 2), weights=(5, 2, 1), epochs=2) -> dict:
    """Give by weight; clamp those above their cap; give the excess to the others; repeat."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while len(fixed) < len(names):
        left = total - sum(fixed.values())
        w = sum(weight[s] for s in names if s not in fixed)
        new = {s: Fraction(epochs * sizes[s]) for s in names if s not in fixed and left * weight[s] / w > epochs * sizes[s]}
        if not new:
            return fixed | {s: left * weight[s] / w for s in names if s not in fixed}
        fixed |= new
    return fixed


def make(spark, sizes: dict, docs_per_source: int = 7):
    rows, n = [], 0
    for source, size in sizes.items():
        for k in range(docs_per_source):
            words = size // docs_per_source + (k < size % docs_per_source)
            rows.append((n, " ".join(["w"] * words), source, -1, "clash"))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 1000, "c": 50, "d": 3000},
        {"a": 10, "b": 10, "c": 5000, "d": 1, "é": 40, None: 700},
        {"only": 77},
        {"a": 0, "b": 0},
        {f"s{i}": 10 * (i + 1) ** 2 for i in range(11)},
    ],
)
def test_targets_and_taken(spark, sizes):
    rows = mixing.mix(make(spark, sizes)).withColumn("k", F.col("doc_id")).collect()
    want = reshare(sizes)
    names = list(sizes)
    taken = dict.fromkeys(names, 0)
    for r in rows:
        s = names[r["doc_id"] // 7]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(float(want[s]))
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - float(want[s])) <= 1


def test_reruns_agree_and_whole_copies_are_near(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = sorted(map(tuple, mixing.mix(docs).collect()))
    assert a == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    assert all(r[5] in (r[4] // r[1], r[4] // r[1] + 1) for r in a if r[1])


def test_odd_rows(spark):
    rows = [(1, None, "a", 0, ""), (1, "x y z", "a", 0, ""), (1, "x y z", "a", 0, ""), (None, "q", None, 0, ""), (5, "", "b", 0, ""), (6, "w " * 5000, "b", 0, "")]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 6
    assert sum(r["taken"] for r in out) == pytest.approx(sum(r["size"] for r in out) * 1.5, abs=3)
    assert {r["taken"] for r in out if r["size"] == 0} == {0}
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
