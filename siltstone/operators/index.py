"""A materialized inverted index: postings and lengths, for searches that need not read texts again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analyzer, text
from .retrieval import B, K1, LEAST_IDF

#: Folders that postings are partitioned into by their term; a search reads those of its terms.
BUCKETS = 64


def bucket(term):
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", stemmed: bool = False) -> None:
    """Write postings (bucket, term, doc_id, tf, dl), sorted by term, and the sum of lengths under ``path``."""
    tokens = analyzer.stemmed_tokens(F.col(text_col)) if stemmed else text.tokens(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens.alias("tokens"))
    rows = rows.withColumn("dl", F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0)).cast("long"))
    rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).write.mode("overwrite").parquet(f"{path}/lengths")
    postings = (
        rows.select("doc_id", "dl", F.explode("tokens").alias("term"))
        .groupBy("doc_id", "term", "dl")
        .agg(F.count("*").alias("tf"))
        .withColumn("bucket", bucket(F.col("term")))
    )
    # Terms are dealt by range within buckets, so a frequent term spreads over tasks and files.
    (
        postings.repartitionByRange("bucket", "term", "doc_id")
        .sortWithinPartitions("bucket", "term", "doc_id")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{path}/postings")
    )


def search(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """(doc_id, score) of documents with one of ``terms``, from the index alone."""
    import zlib

    times = {t: list(terms).count(t) for t in terms}
    buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in times})
    hits = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(times)))
    n, length = spark.read.parquet(f"{path}/lengths").agg(F.sum("documents"), F.sum("length")).first()
    df = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row per query term
    return scores(hits, times, df, n or 0, length or 0)


def scores(hits: DataFrame, times: dict[str, int], df: dict[str, int], n: int, length: int) -> DataFrame:
    """(doc_id, score) from postings (term, doc_id, tf, dl) of a query's terms; nothing but hits is shuffled."""
    import math

    weight = F.lit(0.0)
    for t, m in times.items():
        idf = math.log((n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))
        weight = F.when(F.col("term") == t, F.lit(m * (idf if idf > 0 else LEAST_IDF))).otherwise(weight)
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(length / n if n and length else 1.0)))
    return hits.groupBy("doc_id").agg(F.sum(part).alias("score"))
