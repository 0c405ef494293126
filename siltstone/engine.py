"""The engine: catalog, indexing and search over a warehouse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .config import Config
from .functions import analyzer, html, splitters
from .operators import catalog, crawl, embedding, index, retrieval
from .session import written
from .sources.warehouse import ALL, Warehouse
from .streaming.jobs import Job, Manager


def index_rows(pages: DataFrame, embedder: embedding.Embedder, keys: Sequence[str] = ("page_id",), markdown: str | None = None, split: dict | None = None) -> DataFrame:
    """Chunks of pages (keys, html or Markdown): content, sort_order, level, path, types, embedding."""
    text = F.col(markdown) if markdown else html.markdown_column(F.col("html"))["content"]
    chunks = pages.select(*keys, F.posexplode(splitters.chunks(text, splitters.split_markdown, **(split or {}))).alias("sort_order", "c"))
    return embedding.embed(chunks.select(*keys, "sort_order", "c.content", "c.level", "c.path", "c.types"), embedder)


class Engine:
    """Library → version → page → document, with search over the documents."""

    def __init__(self, spark: SparkSession, root: str, embedder: embedding.Embedder | None = None):
        self.spark, self.store = spark, Warehouse(spark, root)
        self.embedder = embedder or embedding.HashingEmbedder()
        self.manager = Manager(self._work, 1, on_status=self._follow)  # one writer
        self._sources: dict[str, tuple[DataFrame, crawl.CrawlOptions]] = {}
        self.split: dict[str, int] = {}
        self.search_options, self.crawl_options = retrieval.SearchOptions(), crawl.CrawlOptions()

    @classmethod
    def from_config(cls, spark: SparkSession, config: Config, send=None) -> Engine:
        """An engine whose splitter, search and crawl take the configuration's settings where a call gives none."""
        self = cls(spark, config.store.path, embedding.create(config.embedding.model, send))
        self.split = {"limit": config.splitter.chunk_size, "overlap": config.splitter.chunk_overlap}
        s, c = config.search, config.scraper
        self.search_options = retrieval.SearchOptions(s.limit, s.vector_weight, s.text_weight, s.rrf_k, s.overfetch)
        self.crawl_options = crawl.CrawlOptions(c.max_pages, c.max_depth, c.include, c.exclude)
        return self

    def sql(self, query: str) -> DataFrame:
        """Spark SQL over the catalog's tables."""
        for name in ("libraries", "versions", "pages", "documents"):
            self.store.read(name).createOrReplaceTempView(name)
        return self.spark.sql(query)

    # Catalog

    def ensure_version(self, library: str, version: str, url: str | None = None) -> int:
        """Find or create a library and a version; the version's id."""
        libraries = self.store.read("libraries")
        found = catalog.by_name(libraries, "name", library).select("id").first()
        lib = found[0] if found else self.store.next_id("libraries")
        versions = self.store.read("versions")
        there = catalog.by_name(versions, "name", version, library_id=lib).select("id").first()
        if there:
            return there[0]
        number = self.store.next_id("versions")
        row = self.spark.createDataFrame([(number, lib, version, "not_indexed", url)], "id long, library_id long, name string, status string, source_url string")
        empty = [F.lit(None).alias(c) for c in versions.columns if c not in row.columns and c != "created_at"]
        new = {"versions": {ALL: row.select("*", *empty, F.current_timestamp().alias("created_at"))}}
        if not found:
            new = {"libraries": {ALL: self.spark.createDataFrame([(lib, library.lower())], "id long, name string").withColumn("created_at", F.current_timestamp())}} | new
        self.store.change(new, append=True)
        return number

    def set_status(self, version_id: int, status: str, error: str | None = None) -> None:
        self.store.replace("versions", catalog.set_status(self.store.read("versions"), version_id, status, error))

    def list_libraries(self) -> DataFrame:
        """(library, version, status, page_count): one plan, not a query per library."""
        lib, ver, pages = (self.store.read(t) for t in ("libraries", "versions", "pages"))
        counts = pages.groupBy(F.col("version_id").alias("vid")).agg(F.count("*").alias("page_count"))
        v = ver.select("library_id", F.col("id").alias("vid"), F.col("name").alias("version"), "status", F.col("created_at").alias("made"))
        out = lib.select("id", F.col("name").alias("library")).join(v, F.col("id") == F.col("library_id"), "left").join(counts, "vid", "left")
        return out.orderBy("library", F.desc("made"), F.desc("vid")).select("library", "version", "status", F.coalesce("page_count", F.lit(0)).alias("page_count"))

    def remove(self, library: str, version: str | None = None) -> bool:
        """Delete a library, or one of its versions, with all that hangs on it; whether it was there."""
        lib, ver = self.store.read("libraries"), self.store.read("versions")
        row = catalog.by_name(lib, "name", library).select("id").first()
        if row is None:
            return False
        mine = F.col("library_id") == row[0]
        new = {}
        if version is not None:
            mine = mine & (F.lower("name") == ("" if version == "_default_" else version).lower())
        else:
            new["libraries"] = {ALL: lib.filter(F.col("id") != row[0])}
        gone = [r[0] for r in ver.filter(mine).select("id").collect()]  # a library's versions
        if version is not None and not gone:
            return False
        new["versions"] = {ALL: ver.filter(~mine)}
        self.store.change(new | {t: dict.fromkeys(gone) for t in ("pages", "documents", "postings", "text_stats")})
        self.manager.bus.emit("LIBRARY_CHANGE", {"library": library.lower()})
        return True

    def set_progress(self, version_id: int, pages: int, most: int) -> None:
        self.store.replace("versions", catalog.set_progress(self.store.read("versions"), version_id, pages, most))

    # Indexing

    def index(self, library: str, version: str, pages: DataFrame) -> int:
        """Store pages (url, title, content as Markdown, depth) and their chunks; the version's id.

        Pages with a known URL are replaced together with their documents, so
        indexing twice is the same as once.
        """
        vid = self.ensure_version(library, version)
        old, docs = self.store.read("pages", vid), self.store.read("documents", vid)
        head = {c: F.col(c) if c in pages.columns else F.lit(None).cast("string") for c in ("etag", "last_modified", "content_type")}
        came = pages.select("url", "title", "content", F.col("depth").cast("int").alias("depth"), *[v.alias(c) for c, v in head.items()])
        if failed := came.filter(F.col("content").isNull()).count():
            self.manager.bus.emit("JOB_PROGRESS", {"library": library.lower(), "version": version, "pages_failed": failed})
        # Of several contents of one URL the shallowest counts, then the first in order.
        row = F.min(F.struct("depth", "content", "title", *head)).alias("p")
        came = came.filter(F.col("content").isNotNull()).groupBy("url").agg(row).select("url", "p.*")
        known = old.select("id", "url")
        fresh = catalog.assign_ids(came.join(known, "url", "left_anti").select("url"), self.store.next_id("pages") - 1, "id", ["url"]).select("id", "url")
        ids = known.join(came.select("url"), "url", "left_semi").select("id", "url").unionByName(fresh)
        named = came.join(ids, "url")
        now = F.current_timestamp()
        new = named.select(
            "id", F.lit(vid).alias("version_id"), "url", "title", "etag", "last_modified", F.coalesce("content_type", F.lit("text/html")).alias("content_type"),
            "depth", now.alias("created_at"), now.alias("updated_at"),
        )
        chunks = index_rows(named.withColumnRenamed("id", "page_id"), self.embedder, ("page_id",), "content", self.split)
        kept = docs.join(ids.select(F.col("id").alias("page_id")), "page_id", "left_anti").select(*docs.columns)
        made = chunks.select(
            "page_id", "content", F.struct("level", "path", "types").alias("metadata"), F.col("sort_order").cast("int").alias("sort_order"),
            F.col("embedding").cast("array<float>").alias("embedding"), now.alias("created_at"),
        )
        made = catalog.assign_ids(made, self.store.next_id("documents") - 1, "id", ["page_id", "sort_order"]).select(*docs.columns)
        all_pages, all_docs = written(catalog.upsert(old, new, ["version_id", "url"], ["id", "created_at"]), "index-pages"), written(kept.unionByName(made), "index-documents")
        self.store.change({"pages": {vid: all_pages}, "documents": {vid: all_docs}} | self._postings(vid, library, version, all_pages, all_docs))
        return vid

    def _postings(self, vid: int, library: str, version: str, pages: DataFrame, docs: DataFrame) -> dict:
        """Terms of a version's documents with their page's title, URL and path, and what BM25 needs of their lengths."""
        page = pages.select(F.col("id").alias("page_id"), "title", "url")
        whole = F.concat_ws(" ", "content", "title", "url", F.lit(f"{library.lower()}/{version}"))
        tokens = docs.join(page, "page_id").select(F.col("id").alias("doc_id"), analyzer.stemmed_tokens(whole).alias("tokens"))
        rows = written(tokens.withColumn("dl", F.size("tokens").cast("long")), "index-tokens")
        terms = rows.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
        # Sorted by term, so a search skips what it does not ask for.
        ordered = terms.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        return {"postings": {vid: ordered}, "text_stats": {vid: rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))}}

    def scrape(self, library: str, version: str, source: DataFrame, start: str, options: crawl.CrawlOptions | None = None) -> Job:
        """Enqueue a crawl of a page source (url, html) and the indexing of what it finds."""
        self._sources[f"{library.lower()}\0{version}\0{start}"] = (source, options or self.crawl_options)
        return self.manager.enqueue(library, version, start)

    def _work(self, job: Job) -> None:
        source, options = self._sources.pop(f"{job.library}\0{job.version}\0{job.url}")
        vid = self.ensure_version(job.library, job.version, job.url)
        done = 0

        def seen(depth: int, n: int) -> None:
            nonlocal done
            done += n
            self.set_progress(vid, done, options.max_pages)
            self.manager.bus.emit("JOB_PROGRESS", {"id": job.id, "depth": depth, "pages_scraped": done, "total_pages": options.max_pages})

        pages = crawl.crawl(source, job.url, options, seen, job.cancel.is_set)
        if not job.cancel.is_set():
            self.index(job.library, job.version, pages)

    def _follow(self, job: Job) -> None:
        self.set_status(self.ensure_version(job.library, job.version, job.url), catalog.OF_JOB[job.status], job.error)

    # Search

    def _scope(self, library: str, version: str | None) -> tuple[DataFrame, list[int]]:
        """(documents of a library or version with page, version and library names, ids of its versions)."""
        lib, ver = self.store.read("libraries"), self.store.read("versions")
        lib = catalog.by_name(lib, "name", library).select(F.col("id").alias("library_id"), F.col("name").alias("library"))
        ver = ver.select(F.col("id").alias("version_id"), "library_id", F.col("name").alias("version")).join(lib, "library_id")
        if version is not None:
            ver = ver.filter(F.lower("version") == version.lower())
        parts = [r[0] for r in ver.select("version_id").collect()]  # a library's versions
        there = parts or [0]
        pages = self.store.read("pages", *there).select(F.col("id").alias("page_id"), "version_id", "url", "title")
        return self.store.read("documents", *there).join(pages, "page_id").join(ver, "version_id"), parts

    def _text_hits(self, query: str, parts: list[int]) -> DataFrame:
        """(doc_id, score) of documents of some versions, from the postings of the query's terms alone."""
        terms = analyzer.analyze(query)
        times = {t: terms.count(t) for t in terms}
        asked = F.col("term").isin(list(times)) if times else F.lit(False)
        sums = self.store.read("text_stats").agg(F.sum("documents").alias("n"), F.sum("length").alias("length")).first()
        counts = self.store.read("postings").filter(asked).groupBy("term").agg(F.count("*").alias("n")).collect()  # a row per term
        df = {r["term"]: r["n"] for r in counts}
        return index.scores(self.store.read("postings", *(parts or [0])).filter(asked), times, df, sums["n"] or 0, sums["length"] or 0)

    def search(self, library: str, query: str, version: str | None = None, options: retrieval.SearchOptions | None = None) -> DataFrame:
        """(rank, score, library, version, url, title, content): hybrid, or full text without an embedder.

        Full text is stemmed, over content, title, URL and path, and read from
        the postings that indexing maintains. Its statistics are of all
        documents; hits are of the library.
        The nearest vectors are sought within the library.
        """
        options = options or self.search_options
        scope, parts = self._scope(library, version)
        k = options.limit * options.overfetch
        words = retrieval.ranked(self._text_hits(query, parts), (F.desc("score"), "doc_id"), k)
        if self.embedder.is_available():
            vector = self.embedder.embed_batch([query])[0]
            near = retrieval.ranked(retrieval.knn(scope, vector, k, "id"), ("distance", "doc_id"), k)
            top = retrieval.fuse([(near, options.vector_weight), (words, options.text_weight)], options.k, options.limit)
        else:
            top = words.select("doc_id", "score").limit(options.limit)
        order = Window.orderBy(F.desc("score"), "doc_id")  # at most ``limit`` rows
        top = top.withColumn("rank", F.row_number().over(order).cast("long"))
        out = scope.withColumnRenamed("id", "doc_id").join(F.broadcast(top), "doc_id")
        return out.orderBy("rank").select("rank", "score", "library", "version", "url", "title", "content")

    def search_latest(self, library: str, query: str, **options) -> DataFrame:
        """Search in the newest version; an error for an unknown library."""
        lib = catalog.by_name(self.store.read("libraries"), "name", library).select("id").first()
        if lib is None:
            raise LookupError(f"library {library!r} not found")
        newest = self.store.read("versions").filter(F.col("library_id") == lib[0]).orderBy(F.desc("created_at"), F.desc("id")).select("name").first()
        return self.search(library, query, newest[0] if newest else None, **options)

    def search_text(self, library: str, query: str, **options) -> str:
        """Results as Markdown."""
        rows = self.search(library, query, **options)
        block = retrieval.formatted(F.col("rank"), F.col("title"), F.round("score", 3), F.col("content"))
        return "\n---\n".join(r[0] for r in rows.select(block).collect()) or "No results."
