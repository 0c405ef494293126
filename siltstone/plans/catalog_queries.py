"""Catalog queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import catalog
from ..session import load
from ..sources import warehouse

#: A small catalog of schema versions, applied and known.
APPLIED, KNOWN = (1, 2), (1, 2, 3, 4)


def lookup_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_key(load(spark, sf, "documents"), doc_id=42).limit(1)


def lookup_by_name_ci(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_name(load(spark, sf, "customer"), "c_name", "CUSTOMER#000000007").select("c_custkey", "c_name")


def version_by_name_ci(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_name(load(spark, sf, "documents"), "lang", "EN", source="src1").select("doc_id", "source", "lang")


def page_by_url(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages")
    url = pages.filter("page_id = 3").select("url").scalar()
    return pages.filter(F.col("url") == url).select("page_id", "url")


def exists_ci(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    row = (catalog.exists(n, "n_name", "Nation_3"), catalog.exists(n, "n_name", "Nowhere"))
    return spark.createDataFrame([row], "found boolean, missing boolean")


def children_ordered(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), F.desc("doc_id")))
    return load(spark, sf, "documents").select("source", "doc_id", place.cast("long").alias("place"))


def in_list_count(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").filter("c_nationkey in (1, 5, 9)").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf, "orders").join(c, "o_custkey", "left_semi").agg(F.count("*").alias("n"))


def embedded_count(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return load(spark, sf, "documents").join(e, "doc_id", "left").agg(F.count("*").alias("n"), F.count("embedding").alias("n_embedded"))


def page_count(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").filter("source = 'src2' and lang = 'en'").agg(F.count("*").alias("n"))


def doc_count_by_version(spark: SparkSession, sf: str) -> DataFrame:
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("n"))


def page_counts_left(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").select("n_nationkey", "n_name")
    return catalog.counts_per_parent(n, load(spark, sf, "customer"), "n_nationkey", "c_nationkey", "n", F.col("c_acctbal") > 9000)


def list_libraries(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.listing(load(spark, sf, "documents"), "source", "lang")


def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    chain = [
        ("region", load(spark, sf, "region"), "r_regionkey", None),
        ("nation", load(spark, sf, "nation"), "n_nationkey", "n_regionkey"),
        ("customer", load(spark, sf, "customer"), "c_custkey", "c_nationkey"),
        ("orders", load(spark, sf, "orders"), "o_orderkey", "o_custkey"),
    ]
    left = catalog.delete_cascade(chain, F.col("r_regionkey") == 2)
    parts = [left[name].select(F.lit(name).alias("entity"), F.col(key).cast("long").alias("id")) for name, _, key, _ in chain]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("entity").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


def delete_by_parent(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.delete_children(load(spark, sf, "documents").select("doc_id", "source"), "source", "src4")


def upsert_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Odd documents are there already; every third comes again, and others are new."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(":", "source", "doc_id").alias("url"), F.col("lang").alias("title"), "n_chars")
    old = d.filter("id % 2 = 1").withColumn("created", F.lit("old"))
    new = d.filter("id % 3 = 0").select((F.col("id") + 1000000).alias("id"), "url", F.upper("title").alias("title"), (F.col("n_chars") + 1).alias("n_chars"), F.lit("new").alias("created"))
    return catalog.upsert(old, new, ["url"], ["id", "created"])


def find_or_create(spark: SparkSession, sf: str) -> DataFrame:
    wanted = load(spark, sf, "documents").select(F.upper("source").alias("name"))
    there = load(spark, sf, "documents").filter("source < 'src15'").select("source").distinct()
    ids = there.select(F.row_number().over(Window.orderBy("source")).cast("long").alias("id"), F.col("source").alias("name"))  # one row per source
    return catalog.find_or_create(ids, wanted, "name", "id")


def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", "source")
    old = d.filter("doc_id < 100").select(F.col("doc_id").alias("id"))
    return catalog.assign_ids(d.filter("doc_id >= 100"), old, "id", ["source", "doc_id"]).select("id", "doc_id", "source")


def constraint_check(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of violations: repeated keys, repeated texts, nulls, rows without a parent."""
    d, o, c = load(spark, sf, "documents"), load(spark, sf, "orders"), load(spark, sf, "customer")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    return (
        n(catalog.duplicates(d, "doc_id"), "doc_id unique")
        .unionByName(n(catalog.duplicates(d, "source", "text"), "text unique in source"))
        .unionByName(n(d.filter("text is null"), "text not null"))
        .unionByName(n(catalog.orphans(o, c.filter("c_custkey % 10 != 0"), "o_custkey", "c_custkey"), "order has customer"))
    )


def migrations_pending(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(v, max(APPLIED)) for v in warehouse.pending(list(KNOWN), max(APPLIED))]
    return spark.createDataFrame(rows, "version long, after long")


def status_map(spark: SparkSession, sf: str) -> DataFrame:
    statuses = [(s,) for s in (*catalog.OF_JOB, "unknown")]
    return spark.createDataFrame(statuses, "job string").select("job", catalog.status_of_job(F.col("job")).alias("version"))


def sentinel_version(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("lang") == "en", "_default_").otherwise(F.col("lang"))
    return load(spark, sf, "documents").select("doc_id", catalog.unversioned(name).alias("version"))


def update_status(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running")
    last = e.groupBy(F.col("user_id").alias("id")).agg(F.max_by(status, F.struct("ts", "event_id")).alias("status"), F.max("ts").cast("timestamp").alias("updated_at"))
    changed = catalog.set_status(last.withColumn("error_message", F.lit(None).cast("string")), 7, "cancelled", "stopped")
    return changed.select(F.col("id").alias("user_id"), "status", "error_message")


def scan_pages(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", "url", F.lit("text/html").alias("content_type"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__}

SQL = {
    "lookup_by_id": "SELECT * FROM documents WHERE doc_id = 42 LIMIT 1",
    "lookup_by_name_ci": "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000007')",
    "version_by_name_ci": "SELECT doc_id, source, lang FROM documents WHERE source = 'src1' AND lower(lang) = lower('EN')",
    "page_by_url": "SELECT page_id, url FROM pages WHERE url = (SELECT url FROM pages WHERE page_id = 3)",
    "exists_ci": "SELECT EXISTS (SELECT 1 FROM nation WHERE lower(n_name) = 'nation_3') AS found, EXISTS (SELECT 1 FROM nation WHERE lower(n_name) = 'nowhere') AS missing",
    "children_ordered": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC)::BIGINT AS place FROM documents",
    "in_list_count": "SELECT count(*)::BIGINT AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 5, 9))",
    "embedded_count": "SELECT count(*)::BIGINT AS n, count(embedding)::BIGINT AS n_embedded FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
    "page_count": "SELECT count(*)::BIGINT AS n FROM documents WHERE source = 'src2' AND lang = 'en'",
    "doc_count_by_version": "SELECT c_nationkey, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey",
    "page_counts_left": "SELECT n_nationkey, n_name, count(c_custkey)::BIGINT AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY n_nationkey, n_name",
    "list_libraries": "SELECT source AS library, coalesce(string_agg(DISTINCT nullif(lang, ''), ', ' ORDER BY nullif(lang, '')), 'none') AS versions, count(DISTINCT lang)::BIGINT AS n_versions FROM documents GROUP BY source",
    "latest_version": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "cascade_delete": """WITH n AS (SELECT * FROM nation WHERE n_regionkey <> 2), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
      o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
      SELECT entity, count(*)::BIGINT AS n, sum(id)::BIGINT AS id_sum FROM (
        SELECT 'region' AS entity, r_regionkey::BIGINT AS id FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'nation', n_nationkey FROM n
        UNION ALL SELECT 'customer', c_custkey FROM c UNION ALL SELECT 'orders', o_orderkey FROM o) GROUP BY entity""",
    "delete_by_parent": "SELECT doc_id, source FROM documents WHERE source <> 'src4'",
    "upsert_pages": """WITH d AS (SELECT doc_id AS id, source || ':' || doc_id AS url, lang AS title, n_chars FROM documents),
      o AS (SELECT * FROM d WHERE id % 2 = 1), n AS (SELECT id + 1000000 AS id, url, upper(title) AS title, n_chars + 1 AS n_chars FROM d WHERE id % 3 = 0)
      SELECT coalesce(o.id, n.id) AS id, coalesce(o.url, n.url) AS url, coalesce(n.title, o.title) AS title, coalesce(n.n_chars, o.n_chars) AS n_chars,
        CASE WHEN o.id IS NULL THEN 'new' ELSE 'old' END AS created FROM o FULL JOIN n ON o.url = n.url""",
    "find_or_create": """WITH s AS (SELECT DISTINCT source AS name FROM documents), o AS (SELECT row_number() OVER (ORDER BY name) AS id, name FROM s WHERE name < 'src15')
      SELECT id::BIGINT AS id, name FROM o UNION ALL
      SELECT ((SELECT coalesce(max(id), 0) FROM o) + row_number() OVER (ORDER BY name))::BIGINT, name FROM s WHERE name NOT IN (SELECT name FROM o)""",
    "assign_ids": "SELECT ((SELECT coalesce(max(doc_id), 0) FROM documents WHERE doc_id < 100) + row_number() OVER (ORDER BY source, doc_id))::BIGINT AS id, doc_id, source FROM documents WHERE doc_id >= 100",
    "constraint_check": """SELECT 'doc_id unique' AS rule, count(*)::BIGINT AS n FROM (SELECT 1 FROM documents GROUP BY doc_id HAVING count(*) > 1)
      UNION ALL SELECT 'text unique in source', count(*) FROM (SELECT 1 FROM documents GROUP BY source, text HAVING count(*) > 1)
      UNION ALL SELECT 'text not null', count(*) FROM documents WHERE text IS NULL
      UNION ALL SELECT 'order has customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)""",
    "migrations_pending": "WITH a(v) AS (VALUES (1), (2)), k(v) AS (VALUES (1), (2), (3), (4)) SELECT v::BIGINT AS version, (SELECT coalesce(max(v), 0) FROM a)::BIGINT AS after FROM k WHERE v > (SELECT coalesce(max(v), 0) FROM a)",
    "status_map": "SELECT * FROM (VALUES ('queued', 'queued'), ('running', 'running'), ('cancelling', 'running'), ('completed', 'completed'), ('failed', 'failed'), ('cancelled', 'cancelled'), ('unknown', 'not_indexed')) t(job, version)",
    "sentinel_version": "SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE lang END AS version FROM documents",
    "update_status": """SELECT user_id, CASE WHEN user_id = 7 THEN 'cancelled' ELSE arg_max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END, struct_pack(ts := ts, id := event_id)) END AS status,
        CASE WHEN user_id = 7 THEN 'stopped' END AS error_message
      FROM events GROUP BY user_id""",
    "scan_pages": "SELECT page_id, url, 'text/html' AS content_type FROM pages",
}
