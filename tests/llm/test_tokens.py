"""Token files and packing: exact round trips through the tokenizers library."""

import zlib

import numpy as np
import pytest

from siltstone.llm import id_files, packing, tokens

SCHEMA = "doc_id long, text string, start string, ids string, length string"
ODD = [
    "<|endoftext|> a", "a <|endoftext|> b", "a<|endoftext|>", "x<|endoftext|><|endoftext|>y z", "in<|endoftext|>side", "<|endoftext| >", "<|endoftext|>", "héllo wörld 日本 \x1c x", "  a\n\n b 's it's we'll", "\t x\r\n", "½ 1² a1", "😀 ok", " ", " \n", "", "\x00", "a　b", "Ġ Ġa", "x\u0378y ʰ ǅ",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_the_library(tokenizer, spark, sf):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    e = tokens.Encoder(tokens.default_path())
    for _ in range(2):  # unknown, then known pieces
        got = [np.frombuffer(x, dtype=e.dtype).tolist() for x in e.encode(texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_with_a_full_memory(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 3)
    e = tokens.Encoder(tokens.default_path())
    texts = ["some words here", "other words there", *ODD]
    assert [np.frombuffer(x, dtype=e.dtype).tolist() for x in e.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def make(spark, sf):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = docs + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None), (None, "no id"), (20_001, "twice"), (20_001, "twice"), (-5, "first")]
    return rows, spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def test_files_hold_every_document(tokenizer, spark, sf):
    rows, df = make(spark, sf)
    folder, manifest = id_files.write(df.repartition(3))
    got = sorted(map(tuple, id_files.read(spark, folder, manifest).collect()), key=lambda r: r[1])
    assert len(got) == len(rows)
    place = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc, start, n, crc), (want, text) in zip(got, order, strict=True):
        ids = ids_of(tokenizer, text)
        assert (doc, start, n) == (want, place, len(ids))
        assert crc == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        place += n


def test_single_documents_and_dictionary_check(tokenizer, spark, sf, tmp_path):
    docs = spark.createDataFrame([(i, f"short text {i}", "", "", "") for i in range(50)], SCHEMA)
    folder, manifest = id_files.write(docs, f"file://{tmp_path}/out")
    name = manifest.orderBy("shard").first()["name"]
    reader = id_files.Reader(folder, name)
    i = len(reader) - 1
    assert reader[i].tolist() == ids_of(tokenizer, f"short text {reader.doc_id(i)}")
    reader.close()
    (tmp_path / "out" / id_files.DICTIONARY).write_bytes(b"another")
    with pytest.raises(ValueError, match="dictionary"):
        id_files.Reader(folder, name)


def test_dictionary_helps_short_documents(spark, sf):
    e = tokens.Encoder(tokens.default_path())
    data = e.encode([r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()])
    dictionary = id_files.train(data * 3)
    with_it, without = id_files.codec(dictionary)[0], id_files.codec(b"")[0]
    short = [x[:400] for x in data]
    assert sum(len(with_it.compress(x)) for x in short) < sum(len(without.compress(x)) for x in short)


def test_few_samples_train_less_or_nothing():
    assert id_files.train([]) == id_files.train([b"abc"]) == b""
    rng = np.random.Generator(np.random.PCG64(1))
    words = [rng.integers(0, 256, 24, dtype=np.uint8).tobytes() for _ in range(200)]
    texts = [b"".join(words[k] for k in rng.integers(0, 200, 40)) for _ in range(60)]
    assert 256 <= len(id_files.train(texts)) <= sum(map(len, texts)) // 10
    long_one = bytes(range(256)) * 4096
    assert len(id_files.spread(long_one)) == id_files.SAMPLE_PIECE * id_files.SAMPLE_PIECES and id_files.spread(b"ab") == b"ab"


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert id_files.read(spark, *id_files.write(df)).count() == 0
    assert packing.pack(df).count() == 0


def test_best_fit_against_a_plain_search():
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (0, 1, 300):
        lengths = rng.integers(1, 1024, n)
        sequence, offset = packing.best_fit(lengths)
        room: list[int] = []
        for i in np.argsort(-lengths, kind="stable"):
            fit = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
            if fit:
                least = min(fit)[0]
                assert 1024 - offset[i] == least
                k = sequence[i]
                assert room[k] == least
            else:
                k = len(room)
                room.append(1024)
                assert (sequence[i], offset[i]) == (k, 0)
            room[k] -= lengths[i]


def test_packing_keeps_every_id(tokenizer, spark, sf):
    rows, df = make(spark, sf)
    got = packing.pack(df, with_ids=True, group_docs=100).collect()
    by_doc: dict = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == r["length"]
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, pieces in by_doc.items():
        texts = [t for i, t in rows if i == doc]
        ids = [x for t in texts for x in ids_of(tokenizer, t)]
        assert sum(p["length"] for p in pieces) == len(ids)
        if len(texts) == 1:
            pieces.sort(key=lambda p: p["start"])
            assert [x for p in pieces for x in p["ids"]] == ids
            assert {p["doc_tokens"] for p in pieces} == {len(ids)}
    windows: dict = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    used = [sum(n for _, n in parts) for parts in windows.values()]
    assert packing.padding(used).sum() < 0.05 * sum(used)


def test_padding_is_none_at_a_power_of_two():
    assert packing.padding([1, 2, 3, 512, 1000, 1024]).tolist() == [0, 0, 1021, 0, 24, 0]


def test_very_long_texts(tokenizer, spark):
    text = "Some rather ordinary wörds <|endoftext|> 12\n" * 20_000
    df = spark.createDataFrame([(1, text, "", "", ""), (2, "short", "", "", "")], SCHEMA)
    ids = ids_of(tokenizer, text)
    got = {r["doc_id"]: r for r in id_files.read(spark, *id_files.write(df)).collect()}
    assert (got[1]["n_tokens"], got[1]["ids_crc32"], got[2]["start"]) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), len(ids))
    pieces = packing.pack(df, with_ids=True).filter("doc_id = 1").orderBy("start").collect()
    assert [x for p in pieces for x in p["ids"]] == ids
