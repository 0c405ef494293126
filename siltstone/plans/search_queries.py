"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, vectors
from ..operators import catalog, retrieval
from ..session import load, spread

TERMS = ("the", "time", "de", "the")
QUERY = " ".join(TERMS)
LIMIT = 10


def _texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of long texts, on all cores."""
    return spread(load(spark, sf, name))


def query_vector(spark: SparkSession, sf: str, vec_id: int = 7) -> list[float]:
    """The query: one stored vector, a row of the driver's."""
    row = load(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


def _knn(spark: SparkSession, sf: str, metric: str) -> DataFrame:
    return _shown(retrieval.knn(load(spark, sf, "embeddings"), query_vector(spark, sf), 30, metric=metric))


def _shown(hits: DataFrame) -> DataFrame:
    """Hits are ordered by exact values; only what is shown is rounded."""
    places = {"distance": 6, "score": 9}
    return hits.select(*[F.round(c, places[c]).alias(c) if c in places else c for c in hits.columns])


def knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, "l2")


def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, "cosine")


def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(retrieval.full_text(_texts(spark, sf, "documents"), QUERY, 3 * LIMIT))


def fts_only_search(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(retrieval.full_text(_texts(spark, sf, "documents"), QUERY, LIMIT, F.col("source") == "src1", also=("source",)))


def fts_store_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = _texts(spark, sf, "documents")
    hits = retrieval.full_text(docs, QUERY, LIMIT, (F.col("source") == "src1") & (F.col("lang") == "en"), also=("source", "lang"))
    return docs.join(F.broadcast(hits), "doc_id").select("doc_id", "source", "lang")  # ten hits


def search_all_versions(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(retrieval.full_text(_texts(spark, sf, "documents"), QUERY, LIMIT, F.col("source") == "src3", also=("source",)))


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings")
    legs = [
        retrieval.ranked(retrieval.knn(e, query_vector(spark, sf, i), 30), ("distance", "doc_id"), 30) for i in (7, 11)
    ]
    return _shown(retrieval.fuse([(legs[0], 0.5), (legs[1], 0.5)], 60, LIMIT))


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(retrieval.hybrid(_texts(spark, sf, "documents"), load(spark, sf, "embeddings"), QUERY, query_vector(spark, sf)))


def hybrid_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Both legs within one source."""
    docs, e = _texts(spark, sf, "documents"), load(spark, sf, "embeddings")
    return _shown(retrieval.hybrid(docs, e, QUERY, query_vector(spark, sf), where=F.col("source") == "src1", also=("source",)))


def hydrate_chain(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer, nation, region = (load(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice")
    )


def search_hydrated(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer, nation, region = (load(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    hits = retrieval.ranked(orders.select("o_orderkey", "o_custkey", "o_totalprice"), (F.desc("o_totalprice"), "o_orderkey"), LIMIT)
    out = retrieval.hydrate(hits, (customer, "c_custkey", "o_custkey"), (nation, "n_nationkey", "c_nationkey"), (region, "r_regionkey", "n_regionkey"))
    return out.select("rank", "o_orderkey", "c_name", "n_name", "r_name")


def format_results(spark: SparkSession, sf: str) -> DataFrame:
    return _formatted(spark, sf, retrieval.formatted)


def _formatted(spark: SparkSession, sf: str, form) -> DataFrame:
    docs = _texts(spark, sf, "documents")
    hits = retrieval.full_text(docs, QUERY, LIMIT)
    rows = docs.select("doc_id", "source", "text").join(F.broadcast(hits), "doc_id")  # ten hits
    return rows.select("rank", form(F.col("rank"), F.col("source"), F.round("score", 3), F.col("text")).alias("block"))


def format_json(spark: SparkSession, sf: str) -> DataFrame:
    return _formatted(spark, sf, retrieval.as_json)


def format_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _formatted(spark, sf, retrieval.as_line)


def search_latest_version(spark: SparkSession, sf: str) -> DataFrame:
    """Search within the newest version of each source: the language of its last document."""
    docs = _texts(spark, sf, "documents")
    newest = catalog.latest(docs.select("source", "lang", "doc_id"), "source", "doc_id", "lang").select("source", "lang")
    hits = retrieval.bm25(docs, TERMS, also=("source", "lang"))
    return _shown(retrieval.ranked(hits.join(newest, ["source", "lang"], "left_semi").select("doc_id", "score"), (F.desc("score"), "doc_id"), LIMIT))


def fts_query_clean(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").select("item_id", text.clean_query(F.col("text")).alias("match"))


def fts_source_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What the index holds of a document: its text with its page's title and address."""
    d, p = _texts(spark, sf, "documents"), _texts(spark, sf, "pages")
    return d.join(p, d["doc_id"] == p["page_id"]).select("doc_id", F.col("text").alias("content"), "url", F.concat_ws("/", "source", "lang").alias("path"))


def vector_pad(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform(vectors.pad(F.col("embedding"), 96), lambda x: x.cast("double"))
    return load(spark, sf, "embeddings").select(
        "vec_id", F.size(v).cast("long").alias("dim"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.element_at(v, 96).alias("last")
    )


def f16_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").withColumn("blob", vectors.encode_f16(F.col("embedding")))
    back = e.withColumn("back", vectors.decode(F.col("blob"), 64))
    error = F.array_max(F.zip_with("embedding", "back", lambda a, b: F.abs(a - b)))
    return back.select("vec_id", F.length("blob").cast("long").alias("bytes"), (error < 1e-3).alias("close"))


def blob_len_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings")
    return e.filter(F.col("embedding").isNotNull() & (F.size("embedding") * 4 == 256)).orderBy("vec_id").limit(100).select("vec_id")


def zip_positional(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks and vectors of one parent paired by position, as far as both reach: places in a sort, no list of a parent."""
    place = lambda key: (F.row_number().over(Window.partitionBy("source").orderBy(key)) - 1).cast("long").alias("pos")
    d = load(spark, sf, "documents").select("source", "doc_id", place("doc_id"))
    e = load(spark, sf, "embeddings").select(F.concat(F.lit("src"), F.pmod("label", F.lit(20))).alias("source"), "vec_id")
    return d.join(e.select("source", "vec_id", place("vec_id")), ["source", "pos"]).select("source", "pos", "doc_id", "vec_id")


def _names() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k != "query_vector"}


QUERIES = _names()

_BM25 = r"""
t AS (SELECT doc_id, source, lang, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS tokens FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, sum(len(tokens)) / count(*) AS avgdl FROM t),
q(term, times) AS (VALUES ('the', 2), ('time', 1), ('de', 1)),
tf AS (SELECT doc_id, term, times, len(tokens) AS dl, len(list_filter(tokens, lambda x: x = term))::DOUBLE AS tf FROM t, q),
df AS (SELECT term, count(*) FILTER (tf > 0)::DOUBLE AS df FROM tf GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, s),
hits AS (
  SELECT doc_id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM tf JOIN idf USING (term), s GROUP BY doc_id HAVING sum(tf) > 0)"""

_DIST = "list_distance(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = {i})::DOUBLE[])"
_COSINE = "1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[])"
_NEAR = "SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {d}, vec_id) AS rank FROM embeddings QUALIFY rank <= 30"
_TOP = "SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS rank FROM hits JOIN t USING (doc_id) WHERE {w} QUALIFY rank <= {k}"

SQL = {
    "knn_l2": f"SELECT vec_id AS doc_id, round({_DIST.format(i=7)}, 6) AS distance FROM embeddings ORDER BY {_DIST.format(i=7)}, doc_id LIMIT 30",
    "knn_cosine": f"SELECT vec_id AS doc_id, round({_COSINE}, 6) AS distance FROM embeddings ORDER BY {_COSINE}, doc_id LIMIT 30",
    "bm25_search": f"WITH {_BM25} {_TOP.format(w='true', k=30)}",
    "fts_only_search": f"WITH {_BM25} " + _TOP.format(w="source = 'src1'", k=10),
    "fts_store_search": f"WITH {_BM25}, r AS (" + _TOP.format(w="source = 'src1' AND lang = 'en'", k=10) + ") SELECT doc_id, source, lang FROM r JOIN t USING (doc_id)",
    "search_all_versions": f"WITH {_BM25} " + _TOP.format(w="source = 'src3'", k=10),
    "rrf_fusion": f"""WITH a AS ({_NEAR.format(d=_DIST.format(i=7))}), b AS ({_NEAR.format(d=_DIST.format(i=11))})
      SELECT doc_id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id
      ORDER BY score DESC, doc_id LIMIT 10""",
    "hybrid_search": f"""WITH {_BM25}, a AS ({_NEAR.format(d=_DIST.format(i=7))}), b AS ({_TOP.format(w='true', k=30)})
      SELECT doc_id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT doc_id, rank FROM a UNION ALL SELECT doc_id, rank FROM b) GROUP BY doc_id
      ORDER BY score DESC, doc_id LIMIT 10""",
    "hybrid_scoped": f"""WITH {_BM25}, a AS ({_NEAR.format(d=_DIST.format(i=7)).replace("FROM embeddings QUALIFY", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE source = 'src1') QUALIFY")}),
      b AS ({_TOP.format(w="source = 'src1'", k=30)})
      SELECT doc_id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT doc_id, rank FROM a UNION ALL SELECT doc_id, rank FROM b) GROUP BY doc_id
      ORDER BY score DESC, doc_id LIMIT 10""",
    "hydrate_chain": """SELECT o_orderkey, c_name, n_name, r_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "search_hydrated": """WITH h AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS rank FROM orders QUALIFY rank <= 10)
      SELECT rank, o_orderkey, c_name, n_name, r_name FROM h JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "format_results": f"""WITH {_BM25}, r AS ({_TOP.format(w='true', k=10)})
      SELECT rank, '## ' || rank || '. ' || coalesce(source, 'N/A') || chr(10) || 'score: ' || printf('%.3f', round(score, 3)) || chr(10) || chr(10) ||
        CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS block FROM r JOIN t USING (doc_id)""",
    "format_json": f"""WITH {_BM25}, r AS ({_TOP.format(w='true', k=10)})
      SELECT rank, to_json({{rank: rank, title: coalesce(source, ''), score: printf('%.1f%%', round(score, 3) * 100), content: CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END}})::VARCHAR AS block
      FROM r JOIN t USING (doc_id)""",
    "format_lines": f"""WITH {_BM25}, r AS ({_TOP.format(w='true', k=10)})
      SELECT rank, rank || '. [' || printf('%.3f', round(score, 3)) || '] ' || coalesce(source, 'N/A') || chr(10) || '   ' ||
        replace(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END, chr(10), ' ') AS block FROM r JOIN t USING (doc_id)""",
    "search_latest_version": f"""WITH {_BM25}, v AS (SELECT source, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source)
      SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS rank
      FROM hits JOIN t USING (doc_id) JOIN v USING (source, lang) QUALIFY rank <= 10""",
    "fts_query_clean": r"""SELECT item_id, array_to_string(list_filter(string_split_regex(translate(text, '"''()*^', '      '), '\s+'), lambda x: x <> ''), ' OR ') AS match FROM benchmark""",
    "fts_source_rows": "SELECT doc_id, text AS content, url, source || '/' || lang AS path FROM documents JOIN pages ON doc_id = page_id",
    "vector_pad": """SELECT vec_id, len(v)::BIGINT AS dim, round(list_sum(v), 4) AS total, v[96] AS last
      FROM (SELECT vec_id, list_resize(embedding::DOUBLE[], 96, 0.0::DOUBLE) AS v FROM embeddings)""",
    "blob_len_filter": "SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) * 4 = 256 ORDER BY vec_id LIMIT 100",
    # Half precision keeps eleven bits of a number: the nearest multiple of 2^(exponent - 10).
    "f16_roundtrip": """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
      s AS (SELECT vec_id, x, CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE pow(2.0::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10) END AS step FROM x)
      SELECT vec_id, (2 * count(*))::BIGINT AS bytes, max(abs(x - round(x / step) * step)) < 1e-3 AS close FROM s GROUP BY vec_id""",
    "zip_positional": """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents),
      e AS (SELECT 'src' || (label % 20) AS source, vec_id, row_number() OVER (PARTITION BY label % 20 ORDER BY vec_id) - 1 AS pos FROM embeddings)
      SELECT source, pos::BIGINT AS pos, doc_id, vec_id FROM d JOIN e USING (source, pos)""",
}
