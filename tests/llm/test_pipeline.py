"""The pipeline's stages against brute-force versions."""

import zlib

import numpy as np

import corpus_pipeline
from siltstone.llm import packing, tokens
from siltstone.llm.common import Written

from . import test_lines, test_mixing, test_repetition, test_similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, kept boolean, copies int"


copied = "\n".join(" ".join(f"c{k}x{j}" for j in range(12)) for k in range(30))


def corpus(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 2500").orderBy("doc_id").limit(90).collect()]
    docs = [(i, t, lang, f"src{i % 4}", n) for i, t, lang, _, n in docs]
    long_ones = [d for d in docs if len(d[1].split()) > 60]
    docs = [(i, f"HEAD LINE\n{t}", lang, s, n) if s == "src1" else (i, t, lang, s, n) for i, t, lang, s, n in docs]
    # Near copies that are a third of their source, line for line but for one.
    docs += [(800 + k, f"{copied}\nlast {k}", "de", "src3", 9) for k in range(12)]
    docs += [(500 + k, long_ones[k][1], "en", "src2", 9) for k in range(8)]
    docs += [(600 + k, long_ones[k][1] + " tail", "en", None, 9) for k in range(5)]
    docs += [(700, None, None, None, None), (701, "", "en", "src1", 0), (702, "x " * 400, "en", "src0", 800), docs[3], (None, long_ones[9][1] + " more words", "fr", "src3", 1)]
    return docs


def test_stages(spark, sf):
    rows = corpus(spark, sf)
    df = spark.createDataFrame([(*r, "clash", True, 3) for r in rows], SCHEMA)
    out, key = {}, lambda r: (r[0] is None, r[0] or 0, str(r[1]), str(r[3]))
    for name, stage in corpus_pipeline.STAGES:
        df = Written(stage(spark, df, sf), f"test-{name}").df
        out[name] = sorted(map(tuple, df.collect()), key=key)
        if name != "pack_windows":
            assert df.columns == list(corpus_pipeline.COLUMNS)

    want = [r for r in rows if test_repetition.brute(r[1])[-1]]
    assert out["quality_rules"] == sorted(want, key=key) and len(want) < len(rows)

    tracked = [(k, r[1], r[3]) for k, r in enumerate(want)]
    of = test_similar.classes([r[1] for r in want])
    first: dict = {}
    for r, c in zip(want, of, strict=True):
        first[c] = min(r, first.get(c, r), key=lambda x: (x[0] is None, x[0] or 0))
    lined = []
    for k, _, text, _, dropped in test_lines.brute(tracked, counted=[(0, r[1], r[3]) for r in first.values()]):
        i, _, lang, source, n = want[k]
        lined.append((i, text, lang, source, len(text) if dropped else n))
    assert out["line_dedup"] == sorted(lined, key=key) and lined != want
    assert all(copied in r[1] for r in lined if r[0] and 800 <= r[0] < 812)

    groups: dict = {}
    for r, c in zip(lined, test_similar.classes([r[1] for r in lined]), strict=True):
        groups.setdefault(c, []).append(r)
    assert len(out["near_dedup"]) == len(groups) < len(lined)
    for r in out["near_dedup"]:
        c = next(c for c, group in groups.items() if r in group)
        assert r[0] == min((x[0] for x in groups.pop(c) if x[0] is not None), default=None)
    assert sum(800 <= (r[0] or 0) < 812 for r in out["near_dedup"]) == 1

    before, after = out["near_dedup"], out["mix_sources"]
    size = lambda r: len(test_repetition.WORD.findall(r[1] or ""))
    totals: dict = {}
    for r in before:
        totals[r[3]] = totals.get(r[3], 0) + size(r)
    goal = test_mixing.reshare(totals)
    for s in totals:
        mine = [r for r in after if r[3] == s]
        assert abs(sum(map(size, mine)) - float(goal[s])) <= max(size(r) for r in before if r[3] == s) / 2 + 1
        assert {r for r in mine} <= {r for r in before} and all(mine.count(r) <= 2 for r in mine)

    encoder = tokens.Encoder(tokens.default_path())
    ids = {r[0]: [*np.frombuffer(encoder.encode([r[1] or ""])[0], dtype=encoder.dtype).tolist(), packing.END] for r in after}
    packed = out["pack_windows"]
    assert sum(r[2] for r in packed) == sum(len(ids[r[0]]) for r in after)
    for doc, start, length, crc, total, _, _ in packed:
        assert total == len(ids[doc]) and crc == zlib.crc32(np.array(ids[doc][start : start + length], dtype="<u4").tobytes())


def test_very_long_text(spark, sf):
    text = "\n".join(f"long{k} word{k} é{k}" for k in range(40_000))
    rows = [(i, f"a short text of its own {i} " * 2 + " ".join(f"w{i}x{k}" for k in range(40)), "en", "src0", 1) for i in range(40)] + [(900, text, "en", "src1", 1)]
    df = spark.createDataFrame([(*r, "clash", True, 3) for r in rows], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        df = Written(stage(spark, df, sf), f"test-{name}").df
        assert df.filter("doc_id = 900").count() > 0
    encoder = tokens.Encoder(tokens.default_path())
    ids = len(encoder.encode([text])[0]) // encoder.width + 1
    pieces = df.filter("doc_id = 900").collect()
    assert {p["doc_tokens"] for p in pieces} == {ids} and sum(p["length"] for p in pieces) % ids == 0


def test_run_is_the_stages_in_turn(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_empty_table(spark, sf):
    df = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        df = Written(stage(spark, df, sf), f"test-{name}").df
        assert df.count() == 0
