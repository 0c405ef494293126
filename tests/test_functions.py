"""Text, URL and vector functions, and the analyzer."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from siltstone.functions import analyzer, text, urls, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("s", "n"), [("", 6), ("Hello, world", 5 + 3), ("你好世界", 5 + 4 + 1), ("abcdefgh", 7)])
def test_estimate_tokens(spark, s, n):
    assert one(spark, text.estimate_tokens(F.lit(s))) == n


def test_lines_and_headings(spark):
    assert one(spark, text.lines(F.lit("a\r\nb\n\n"))) == ["a", "b", ""]
    assert one(spark, text.lines(F.lit(""))) == []
    assert [one(spark, text.heading_level(F.lit(x))) for x in ("# A", "####### x", "#tag", "a # b", "###")] == [1, 0, 1, 0, 3]
    assert one(spark, text.collapse_newlines(F.lit("Line 1\n\n\n\n\nLine 2"))) == "Line 1\n\n\nLine 2"


def test_clean_query(spark):
    assert one(spark, text.clean_query(F.lit("say \"hi\" (now) don't^2"))) == "say OR hi OR now OR don OR t OR 2"
    assert one(spark, text.clean_query(F.lit(" ** "))) == ""


def test_progress(spark):
    rows = spark.createDataFrame([(1,), (3,), (5,), (30,)], "n long").select("n", *text.progress(F.col("n"), 20)).collect()
    assert [tuple(r) for r in rows] == [(1, 3, 4, 4, "discovering"), (3, 6, 9, 9, "scraping"), (5, 1, 6, 6, "scraping"), (30, 10, 40, 20, "scraping")]


def test_wanted(spark):
    f = lambda u, **k: one(spark, urls.wanted(F.lit(u), "a.com", **k))
    assert f("https://A.com:8080/x") and f("not a url") and not f("https://b.com/")
    assert not f("https://a.com/x.pdf", exclude=[r"\.pdf$", "("]) and f("https://a.com/docs/1", include=["/docs/"]) and not f("https://a.com/1", include=["/docs/"])


def test_vectors(spark):
    a, b = vectors.literal([3, 4]), vectors.literal([0, 0])
    assert one(spark, vectors.l2_distance(a, b)) == 5
    assert one(spark, vectors.cosine(a, a)) == pytest.approx(1)
    assert one(spark, vectors.pad(F.array(F.lit(1.0).cast("float")), 3)) == [1, 0, 0]
    assert one(spark, vectors.pad(vectors.literal([1, 2, 3, 4]), 2)) == [1, 2]


def test_half_floats(spark):
    v = [0.1, 0.2, 0.3, -0.5, 1.0, -1.0, 0.001, 0.999]
    df = spark.createDataFrame([(v,), (None,)], "v array<float>").select("v", vectors.encode_f16(F.col("v")).alias("b"))
    rows = df.select("v", "b", vectors.decode_f16(F.col("b")).alias("w"), vectors.decode(F.col("b"), 8).alias("d"), vectors.decode(F.col("b"), 7).alias("e")).collect()
    assert len(rows[0]["b"]) == 16 and max(abs(x - y) for x, y in zip(v, rows[0]["w"], strict=True)) < 1e-3
    assert rows[0]["d"] == rows[0]["w"] and rows[0]["e"] is None and rows[1]["b"] is None


def test_halving_blobs(spark):
    import numpy as np

    blobs = [np.ones(4, "<f4").tobytes(), np.ones(4, "<f2").tobytes(), None]
    got = spark.createDataFrame([(b,) for b in blobs], "b binary").select(vectors.halve(F.col("b"), 4).alias("h")).collect()
    assert [r["h"] and bytes(r["h"]) for r in got] == [blobs[1], blobs[1], None]


WORDS = """caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling
hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli
vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti
triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable
defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize
probate rate cease controll roll generalization oscillators running runs ran university by y yes be is as archaeology""".split()


def test_porter_equals_sqlite():
    """Each word finds, and is found by, exactly the words with its stem."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(w, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t VALUES (?)", [(w,) for w in WORDS])
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    stems = {WORDS[doc - 1]: term for term, doc in con.execute("SELECT term, doc FROM v")}
    assert {w: analyzer.porter(w) for w in WORDS} == stems


def test_analyze():
    assert analyzer.analyze("Über-Läufer running, runs 2x! don't") == ["uber", "laufer", "run", "run", "2x", "don", "t"]
    assert analyzer.analyze(None) == []
