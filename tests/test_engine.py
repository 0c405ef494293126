"""The engine end to end, jobs and streams."""

import time

import pytest
from pyspark.sql import functions as F

from siltstone import cli, config
from siltstone.api import Api
from siltstone.engine import Engine
from siltstone.operators import embedding
from siltstone.plans.text_queries import SITE
from siltstone.session import load
from siltstone.sources import pages
from siltstone.sources.warehouse import ConstraintError
from siltstone.streaming import events
from siltstone.streaming.jobs import Bus, Manager


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/w", embedding.HashingEmbedder(32))


def test_scrape_search_list_remove(spark, engine):
    source = spark.createDataFrame(SITE, "url string, html string")
    job = engine.scrape("MyLib", "1.0", source, "https://s.test/")
    assert engine.manager.wait(job.id, 300).status == "completed"
    assert [tuple(r) for r in engine.list_libraries().collect()] == [("mylib", "1.0", "completed", 6)]
    hits = engine.search("mylib", "page c").collect()
    assert "https://s.test/c" in [r["url"] for r in hits[:2]] and [r["rank"] for r in hits] == list(range(1, len(hits) + 1))
    assert engine.search_latest("MYLIB", "start").first()["url"] == "https://s.test/"
    assert "## 1. Home" in engine.search_text("mylib", "start")
    n = engine.store.read("documents").count()
    ids = sorted(r[0] for r in engine.store.read("pages").select("id").collect())
    pages = spark.createDataFrame([("https://s.test/c", "C", "# C\n\npage c", 2)], "url string, title string, content string, depth int")
    engine.index("mylib", "1.0", pages)  # again
    assert engine.store.read("documents").count() == n and sorted(r[0] for r in engine.store.read("pages").select("id").collect()) == ids
    engine.index("mylib", "2.0", pages)
    assert engine.remove("mylib", "2.0") and not engine.remove("mylib", "3.0") and not engine.remove("none")
    assert engine.store.read("pages").count() == 6
    assert engine.remove("MyLib") and engine.store.read("documents").count() == 0 and engine.store.read("versions").count() == 0
    with pytest.raises(LookupError):
        engine.search_latest("mylib", "x")


def test_a_change_writes_its_version_only(spark, engine):
    page = lambda url, text: spark.createDataFrame([(url, "T", text, 0, "e1")], "url string, title string, content string, depth int, etag string")
    one, two = engine.index("lib", "1", page("u", "alpha beta")), engine.index("lib", "2", page("u", "gamma"))
    files = lambda v: sorted(f for t in ("pages", "documents", "postings") for f in engine.store.read(t, v).inputFiles())
    before = files(one)
    engine.index("lib", "2", page("v", "delta deltas"))
    assert files(one) == before and engine.store.read("pages").count() == 3
    assert {r["etag"] for r in engine.store.read("pages").collect()} == {"e1"}
    assert [r["url"] for r in engine.search("lib", "deltas", "2").collect()][0] == "v"
    assert sorted(r[0] for r in engine.store.read("documents").select("id").collect()) == [1, 2, 3]
    assert engine.remove("lib", "2") and files(one) == before and engine.store.parts("postings") == [str(one)]
    assert two not in [r[0] for r in engine.store.read("versions").select("id").collect()]


def test_changes_are_checked_and_switch_together(spark, engine):
    vid = engine.index("lib", "1", spark.createDataFrame([("u", "T", "alpha", 0)], "url string, title string, content string, depth int"))
    pages, docs = engine.store.read("pages", vid), engine.store.read("documents", vid)
    with pytest.raises(ConstraintError, match="repeats"):
        engine.store.change({"documents": {vid: docs.limit(0)}, "pages": {vid: pages.unionByName(pages)}})
    with pytest.raises(ConstraintError, match="without a row"):
        engine.store.change({"pages": {vid: pages.limit(0)}, "documents": {vid: docs}})
    with pytest.raises(ConstraintError):
        engine.store.append("libraries", engine.store.read("libraries"))
    assert engine.store.read("pages").count() == 1 and engine.store.read("documents").count() == 1


def test_orphans_are_dropped(spark, engine):
    vid = engine.index("lib", "1", spark.createDataFrame([("u", "T", "alpha", 0)], "url string, title string, content string, depth int"))
    engine.store.replace("versions", engine.store.read("versions").limit(0))
    assert engine.store.drop_orphans() == [str(vid)] and engine.store.read("documents").count() == 0


def test_search_without_an_embedder(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/w", embedding.NoEmbedder())
    engine.index("lib", "", spark.createDataFrame([("u", "T", "alpha beta", 0), ("v", "V", "gamma", 0)], "url string, title string, content string, depth int"))
    assert [r["url"] for r in engine.search("lib", "beta").collect()] == ["u"]
    assert engine.store.read("documents").filter("embedding is not null").count() == 0


def test_api_and_tools(spark, engine):
    api = Api(engine, lambda url: spark.createDataFrame(SITE, "url string, html string"))
    job = api.create_job("Lib", "https://s.test/", max_depth=1)["data"]
    engine.manager.wait(job["id"], 300)
    assert api.get_library("lib")["data"]["versions"] == [{"name": "", "status": "completed", "page_count": 3}]
    assert engine.sql("SELECT progress_pages, progress_max_pages FROM versions").first()[:] == (3, 1000)
    assert [x["status"] for x in api.list_jobs()["data"]] == ["completed"] and api.clear_jobs() == {"success": True, "data": {"removed": 1}}
    assert api.search("lib", "start", 1)["data"][0]["title"] == "Home"
    assert api.search("other", "x") == {"success": False, "error": "library 'other' not found"}
    assert api.tool_scrape_docs("Lib", "https://s.test/", max_depth=10).startswith("Indexed 6 pages")
    assert api.tool_list_libraries() == "- lib: unversioned" and "## 1. Home" in api.tool_search_docs("lib", "start")
    assert api.delete_version("lib", "_default_") == {"success": True} and not api.delete_version("lib", "9")["success"]
    assert api.tool_remove_library("lib") == "Removed lib." and not api.delete_library("lib")["success"]


def test_config(spark, tmp_path):
    (tmp_path / "c.toml").write_text(f'[store]\npath = "file://{tmp_path}/w"\n[embedding]\nmodel = "hash:hash-16"\n[scraper]\nexclude = ["x"]\n')
    c = config.from_file(str(tmp_path / "c.toml"))
    assert (c.splitter.chunk_size, c.scraper.exclude, c.embedding.max_rpm) == (1500, ("x",), 1800)
    e = Engine.from_config(spark, c)
    assert e.embedder.dimension == 16 and e.crawl_options.exclude == ("x",) and e.split == {"limit": 1500, "overlap": 200}
    with pytest.raises(ValueError):
        config.merged(c, {"nothing": 1})


def test_fetch(spark):
    def get(url, timeout):
        if "down" in url:
            raise OSError("refused")
        return (404 if "missing" in url else 200), url + "#final", {"etag": "e1", "content-type": "text/html"}, "<p>x</p>"

    urls = spark.createDataFrame([(u,) for u in ("https://a.test/", "https://a.test/missing", "http://down.test/", "ftp://x")], "url string")
    got = {r["url"]: r for r in pages.fetch(urls, get, retries=1, sleep=lambda s: None).collect()}
    assert got["https://a.test/"]["html"] == "<p>x</p>" and got["https://a.test/"]["etag"] == "e1"
    assert got["https://a.test/missing"]["error"] == "status 404" and got["http://down.test/"]["error"] == "refused" and got["ftp://x"]["error"]
    ok = pages.fetch(urls, get, retries=0, sleep=lambda s: None).filter(pages.reachable(F.col("status")) & pages.is_web(F.col("url")))
    assert ok.count() == 1


def test_migrations_run_once(spark, tmp_path, engine):
    assert engine.store.version() == 2 and engine.store.migrate() == []


def test_cli(spark, tmp_path, capsys):
    spark.createDataFrame(SITE, "url string, html string").write.parquet(f"file://{tmp_path}/pages")
    base = ["-d", f"file://{tmp_path}/w"]
    assert cli.main([*base, "scrape", "Lib", "https://s.test/", "--pages", f"file://{tmp_path}/pages", "--max-depth", "1"]) == 0
    assert cli.main([*base, "list"]) == 0 and "lib (unversioned): completed, 3 pages" in capsys.readouterr().out
    assert cli.main([*base, "search", "lib", "start", "--limit", "1"]) == 0 and "## 1. Home" in capsys.readouterr().out
    assert cli.main([*base, "remove", "lib"]) == 0 and cli.main([*base, "remove", "lib"]) == 1


def test_jobs():
    seen, bus = [], Bus()
    a, b = bus.subscribe(), bus.subscribe()

    def work(job):
        if job.library == "bad":
            raise ValueError("no")
        if job.library == "slow":
            assert job.cancel.wait(10)

    m = Manager(work, 1, bus, lambda j: seen.append((j.library, j.status)))
    good, bad = m.enqueue("Good", "", "u"), m.enqueue("bad", "", "u")
    assert m.wait(good.id).status == "completed"
    with pytest.raises(RuntimeError, match="failed: no"):
        m.wait(bad.id)
    slow, waiting = m.enqueue("slow", "", "u"), m.enqueue("next", "", "u")
    while slow.status != "running":
        time.sleep(0.01)
    assert m.cancel(waiting.id) and m.cancel(slow.id)
    with pytest.raises(RuntimeError, match="cancelled"):
        m.wait(slow.id)
    assert [s for n, s in seen if n == "slow"] == ["running", "cancelling", "cancelled"] and waiting.status == "cancelled"
    assert len(m.by_status("cancelled")) == 2 and m.clear_completed() == 4 and list(a) == list(b)
    last = m.enqueue("good", "", "u")  # a finished job starts the next
    assert m.wait(last.id).status == "completed"
    m.stop()


def test_bus_keeps_the_last_events():
    bus = Bus(2)
    q = bus.subscribe()
    for i in range(3):
        bus.emit("X", {"i": i})
    assert list(q) == [{"type": "LAGGED", "payload": {"events": 2}}, {"type": "X", "payload": {"i": 2}}]
    bus.emit("X", {"i": 3})
    assert [e["payload"] for e in q] == [{"events": 3}, {"i": 3}]


def test_shown():
    assert events.shown([0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1, 0.12], 5, 0.05) == [True] * 5 + [False, True, False]


@pytest.fixture
def stream(spark, sf, tmp_path):
    load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).schema).parquet(f"file://{tmp_path}/in")


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return stream.sparkSession.table(name)


def test_streamed_windows_equal_batch(spark, sf, stream):
    got = run(events.tumbling(stream, "ts", "1 day", "event_type", late="40 days"), "tumbling", "complete").collect()
    want = events.tumbling(load(spark, sf, "events"), "ts", "1 day", "event_type").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_streamed_throttle_equals_batch(spark, sf, stream):
    seconds = lambda c: F.unix_micros(c) / 1e6
    got = run(events.throttle_stream(stream.withColumn("at", seconds(F.col("ts"))), "user_id", "at", 1, 3600.0), "throttled")
    assert 0 < got.count() < load(spark, sf, "events").count()


def test_streamed_job_states(spark, tmp_path):
    rows = [(1, "queued"), (1, "completed"), (1, "running"), (1, "running"), (1, "completed"), (2, "running"), (3, "queued"), (3, "cancelled"), (3, "running")]
    spark.createDataFrame(rows, "job long, status string").coalesce(1).write.parquet(f"file://{tmp_path}/jobs")
    source = spark.readStream.schema("job long, status string").parquet(f"file://{tmp_path}/jobs")
    got = run(events.job_states_stream(source, "job", "status"), "states").collect()
    assert [r["status"] for r in got if r["key"] == 1] == ["queued", "running", "completed"]
    assert [r["status"] for r in got if r["key"] != 1] == ["queued", "cancelled"]


def test_indexing_a_stream_twice(spark, tmp_path, engine):
    spark.createDataFrame(SITE, "url string, html string").write.parquet(f"file://{tmp_path}/pages")
    schema = "url string, html string"

    def index(batch):
        from siltstone.operators.crawl import process

        engine.index("s", "1", process(batch).select("url", "title", "content", F.lit(0).alias("depth")))

    for k in range(2):  # a batch may come twice
        pages = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/pages")
        assert events.index_stream(pages, index, f"file://{tmp_path}/check{k}").awaitTermination(300)
    assert engine.store.read("pages").count() == 6
    docs = engine.store.read("documents")
    assert docs.count() == docs.select("page_id", "sort_order").distinct().count()


def test_a_queue_embeds_in_one_task_behind_its_limiter(spark):
    queue = embedding.EmbeddingQueue(embedding.HashingEmbedder(8, batch=4), embedding.RateLimiter(rpm=1000, tpm=10**6, gap=0.01))
    rows = spark.range(20).select(F.concat(F.lit("text "), "id").alias("content")).repartition(4)
    began = time.monotonic()
    got = embedding.embed(rows, queue)
    assert got.rdd.getNumPartitions() == 1 and got.filter("size(embedding) = 8").count() == 20
    assert time.monotonic() - began > 0.04  # five requests
