"""Retrieval, index, catalog, crawl and embedding operators."""

import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import analyzer
from siltstone.operators import catalog, crawl, embedding, index, retrieval
from siltstone.plans.text_queries import SITE

DOCS = [
    (1, "Running runs: the runner runs fast"),
    (2, "Über uns: the café is open"),
    (3, "uber alles, the the the"),
    (4, "nothing to see here"),
    (5, ""),
    (6, "fast cars run fast"),
    (7, "the rain in Spain"),
]


@pytest.mark.parametrize("query", ["running the", "uber", "fast fast run", "cafés", "zzz"])
def test_stemmed_bm25_equals_sqlite(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(w, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, w) VALUES (?, ?)", DOCS)
    want = {r[0]: -r[1] for r in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (" OR ".join(query.split()),))}
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = retrieval.bm25(docs, analyzer.analyze(query), tokens=analyzer.stemmed_tokens(F.col("text"))).collect()
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, abs=1e-9)


def test_index_equals_scan(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    terms = ["the", "de", "the", "nothere"]
    index.build(docs, f"file://{tmp_path}/index")
    got = {r["doc_id"]: r["score"] for r in index.search(spark, f"file://{tmp_path}/index", terms).collect()}
    want = {r["doc_id"]: r["score"] for r in retrieval.bm25(docs, terms).collect()}
    assert got == pytest.approx(want, abs=1e-6) and want


def test_fusion_is_symmetric_and_breaks_ties_by_id(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, rank long")
    b = spark.createDataFrame([(2, 1), (1, 2), (3, 3)], "doc_id long, rank long")
    x = [tuple(r) for r in retrieval.fuse([(a, 0.5), (b, 0.5)], limit=3).collect()]
    assert x == [tuple(r) for r in retrieval.fuse([(b, 0.5), (a, 0.5)], limit=3).collect()]
    assert [r[0] for r in x] == [1, 2, 3] and x[0][1] == pytest.approx(0.5 / 61 + 0.5 / 62, abs=1e-9)


def test_empty_query_finds_nothing(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert retrieval.full_text(docs, " ** ", 5).count() == 0


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x", "t0"), (2, "b", "y", "t0")], "id long, url string, title string, made string")
    new = spark.createDataFrame([(9, "b", "z", "t1"), (8, "c", "w", "t1"), (7, "c", "v", "t0")], "id long, url string, title string, made string")
    once = catalog.upsert(old, new, ["url"], ["id", "made"], ["made"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x", "t0"), (2, "b", "z", "t0"), (8, "c", "w", "t1")]
    assert sorted(map(tuple, catalog.upsert(once, new, ["url"], ["id", "made"], ["made"]).collect())) == sorted(map(tuple, once.collect()))


def test_cascade_leaves_no_orphans(spark):
    a = spark.createDataFrame([(1,), (2,)], "id long")
    b = spark.createDataFrame([(10, 1), (11, 2)], "id long, a_id long")
    c = spark.createDataFrame([(100, 10), (101, 11), (102, 11)], "id long, b_id long")
    left = catalog.delete_cascade([("a", a, "id", None), ("b", b, "id", "a_id"), ("c", c, "id", "b_id")], F.col("id") == 2)
    assert {k: sorted(r["id"] for r in v.collect()) for k, v in left.items()} == {"a": [1], "b": [10], "c": [100]}
    assert catalog.orphans(left["c"], left["b"], "b_id", "id").count() == 0


def test_crawl(spark):
    pages = spark.createDataFrame(SITE, "url string, html string")
    run = lambda **k: [(r["depth"], r["url"][14:]) for r in crawl.crawl(pages, "https://s.test/", crawl.CrawlOptions(**k)).collect()]
    assert run() == [(0, "/"), (1, "/a"), (1, "/b#x"), (2, "/c"), (2, "/d"), (3, "/e")]
    assert run(max_depth=0) == [(0, "/")]
    assert run(max_pages=3) == [(0, "/"), (1, "/a"), (1, "/b#x")]
    assert run(exclude=("/b",)) == [(0, "/"), (1, "/a"), (2, "/c"), (3, "/e")]
    assert run(include=("/a$",)) == [(0, "/"), (1, "/a")]
    assert [n for _, n in crawl.levels(pages, "https://s.test/")] == [1, 2, 2, 1]
    assert crawl.crawl_page(pages, "https://s.test/a").first()["links"] == ["https://s.test/c", "https://s.test/"]
    assert crawl.CrawlOptions.from_dict({"max_pages": 5, "exclude_patterns": ["a", "("]}) == crawl.CrawlOptions(5, 3, (), ("a",))
    levels = []
    crawl.crawl(pages, "https://s.test/", on_level=lambda d, n: levels.append((d, n)), cancelled=lambda: len(levels) >= 2)
    assert levels == [(0, 1), (1, 2)]


def test_model_specs():
    assert embedding.parse_model("OpenAI:x") == ("openai", "x") and embedding.parse_model("google") == ("google", "text-embedding-004")
    assert embedding.parse_model("some-model") == ("openai", "some-model")
    assert embedding.MODELS["text-embedding-3-small"][0] == 1536 and embedding.MODELS["text-embedding-004"][0] == 768
    assert embedding.is_valid_dimension("unknown", 5) and not embedding.is_valid_dimension("text-embedding-004", 5)
    assert embedding.create("openai").name == "none" and embedding.create("hash:hash-32").dimension == 32


def test_embedders(spark):
    e = embedding.HashingEmbedder(32)
    a, b, c = e.embed_batch(["running dogs", "dogs run", ""])
    assert a == b and sum(x * x for x in a) == pytest.approx(1, abs=1e-5) and not any(c)
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id long, content string")
    assert [len(r["embedding"]) for r in embedding.embed(rows, e).collect()] == [32, 32]
    assert [r["embedding"] for r in embedding.embed(rows, embedding.NoEmbedder()).collect()] == [None, None]
    with pytest.raises(RuntimeError):
        embedding.NoEmbedder().embed_batch(["x"])


def test_vectors_of_a_batch_leave_a_request_at_a_time(spark):
    calls = []
    e = embedding.ApiEmbedder(lambda texts: calls.append(len(texts)) or [(i, [float(len(t))]) for i, t in enumerate(texts)], 2, batch=4)
    out = embedding.embedded(iter([pa.array(["a"] * 9 + [None]), pa.array([], pa.string()), pa.array(["bb"])]), e)
    assert next(out).to_pylist() == [[1.0, 0.0]] * 4 and calls == [4]
    assert [x for part in out for x in part.to_pylist()] == [[1.0, 0.0]] * 5 + [[0.0, 0.0], [2.0, 0.0]] and calls == [4, 4, 2, 1]
    rows = spark.range(700).select("id", F.concat(F.lit("word"), "id").alias("content")).coalesce(1)
    got = {r["id"]: list(r["embedding"]) for r in embedding.embed(rows, embedding.HashingEmbedder(8)).collect()}
    want = embedding.HashingEmbedder(8).embed_batch([f"word{i}" for i in range(700)])
    assert got == dict(enumerate(want))


def test_api_embedder_retries_orders_and_fits():
    calls, slept = [], []

    def send(texts):
        calls.append(list(texts))
        if len(calls) < 3:
            raise RuntimeError("HTTP 429")
        return [(1, [1.0, 1.0, 1.0]), (0, [2.0])]

    e = embedding.ApiEmbedder(send, 2, sleep=slept.append)
    assert e.embed_batch(["a", "b"]) == [[2.0, 0.0], [1.0, 1.0]] and slept == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        embedding.ApiEmbedder(lambda _: (_ for _ in ()).throw(RuntimeError("500")), 2).embed_batch(["a"])


def test_queue_and_services():
    now = [0.0]
    limiter = embedding.RateLimiter(60, 10_000, 0.5, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    q = embedding.EmbeddingQueue(embedding.HashingEmbedder(8, batch=2), limiter)
    assert len(q.embed(["a", "b", "c"])) == 3 and now[0] == pytest.approx(0.5)
    assert embedding.request_body("openai", "m", ["a"]) == {"model": "m", "input": ["a"]}
    assert embedding.request_body("google", "m", ["a"])["requests"][0]["content"] == {"parts": [{"text": "a"}]}
    assert embedding.reply_vectors("openai", {"data": [{"index": 1, "embedding": [2.0]}]}) == [(1, [2.0])]
    assert embedding.reply_vectors("google", {"embeddings": [{"values": [1.0]}]}) == [(0, [1.0])]
    assert embedding.estimate_tokens("") == 6 and embedding.estimate_tokens("你好世界") == 10


def test_rate_limiter():
    now = [0.0]
    limiter = embedding.RateLimiter(60, 10_000, 0.1, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert limiter.acquire(100) == 0 and limiter.requests <= 60
    assert limiter.acquire(100) == pytest.approx(0.1)
    assert limiter.acquire(50_000) == pytest.approx(1.2, abs=0.2)  # more than a minute allows: a full bucket
