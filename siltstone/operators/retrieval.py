"""Retrieval: exact k-NN, BM25, reciprocal rank fusion, hybrid search, hydration, formatting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, vectors

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class SearchOptions:
    """Hits wanted, weights of the two legs, the fusion's constant, and hits of a leg per hit wanted."""

    limit: int = 10
    vector_weight: float = 0.5
    text_weight: float = 0.5
    k: int = 60
    overfetch: int = 3


def query_terms(query: str) -> list[str]:
    """Terms of a query, by the rule of the documents; a repeated term counts twice."""
    import re

    return re.findall(r"[^\W_]+", query.lower())


def knn(embeddings: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """(doc_id, distance), the k nearest, ties by id. The query is a constant, so nothing but the top-k is exchanged.

    Filter ``embeddings`` by library before, so that a small library gets k hits.
    """
    q = vectors.literal(list(query))
    v = F.col(vector_col)
    d = vectors.l2_distance(v, q) if metric == "l2" else 1 - vectors.cosine(v, q)
    return (
        embeddings.select(F.col(id_col).cast("long").alias("doc_id"), d.alias("distance"))
        .filter(F.col("distance").isNotNull())
        .orderBy("distance", "doc_id")
        .limit(k)
    )


def _equals(term: str):
    return lambda t: t == F.lit(term)


def _has(terms: Sequence[str]) -> str:
    """A pattern for texts that have one of ``terms`` as a token."""
    return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(terms)})(?:[^\p{{L}}\p{{N}}]|$)"


def bm25(docs: DataFrame, terms: Sequence[str], id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, score, ``also``) of every document that has one of ``terms``.

    Term counts are taken from the document's own token array, so no token is
    exploded or shuffled; the corpus statistics are one aggregated row, joined
    as a scalar subquery. Statistics are of the whole of ``docs``: filter the
    result, not the input.
    """
    wanted = list(dict.fromkeys(terms))
    of = tokens if tokens is not None else text.tokens(F.col(text_col))
    counts = [F.size(F.filter("tokens", _equals(w))).alias(f"tf{i}") for i, w in enumerate(wanted)]

    def counted(df: DataFrame) -> DataFrame:
        tokenized = df.select(F.col(id_col).cast("long").alias("doc_id"), *also, of.alias("tokens"))
        return tokenized.select("doc_id", *also, F.coalesce(F.greatest(F.size("tokens"), F.lit(0)), F.lit(0)).alias("dl"), *counts)

    rows = counted(docs)
    stats = rows.agg(
        F.struct(
            F.count("*").cast("double").alias("n"),
            (F.sum("dl") / F.count("*")).alias("avgdl"),
            F.array(*[F.count(F.when(F.col(f"tf{i}") > 0, 1)).cast("double") for i in range(len(wanted))] or [F.lit(0.0)]).alias("df"),
        )
    ).scalar()
    if tokens is None and wanted:  # a test of the text itself: one of the counts would bring the tokens into the filter again
        scored = counted(docs.filter(F.lower(text_col).rlike(_has(wanted))))
    else:
        scored = rows.filter(F.greatest(F.lit(0), *[F.col(f"tf{i}") for i in range(len(wanted))], F.lit(0)) > 0)
    scored = scored.withColumn("s", stats)
    score = F.lit(0.0)
    for term in terms:
        i = wanted.index(term)
        tf, df = F.col(f"tf{i}").cast("double"), F.col("s")["df"][i]
        raw = F.log((F.col("s")["n"] - df + 0.5) / (df + 0.5))
        idf = F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("s")["avgdl"]))
    return scored.select("doc_id", *also, score.alias("score"))


def ranked(hits: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k by ``order``, with ``rank`` from 1; the window sees k rows only."""
    top = hits.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def fuse(legs: Sequence[tuple[DataFrame, float]], k: int = 60, limit: int | None = None) -> DataFrame:
    """(doc_id, score): weight / (k + rank) summed over ranked legs; ties by id."""
    union = None
    for leg, weight in legs:
        part = leg.select("doc_id", (F.lit(float(weight)) / (F.lit(float(k)) + F.col("rank"))).alias("part"))
        union = part if union is None else union.unionByName(part)
    out = union.groupBy("doc_id").agg(F.sum("part").alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "doc_id").limit(limit)


def full_text(docs: DataFrame, query: str, k: int, where: Column | None = None, **columns) -> DataFrame:
    """Ranked BM25 hits (doc_id, score, rank) among rows that ``where`` keeps; none for an empty query."""
    also = columns.pop("also", ())
    hits = bm25(docs, query_terms(query), also=also, **columns)
    if where is not None:
        hits = hits.filter(where)
    return ranked(hits.select("doc_id", "score"), (F.desc("score"), "doc_id"), k)


def hybrid(docs: DataFrame, embeddings: DataFrame, query: str, query_vector: Sequence[float] | None, options: SearchOptions = SearchOptions(), where: Column | None = None, also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, score): both legs fused; the text leg alone if there is no query vector.

    ``where``, over ``also`` columns of ``docs``, holds for both legs: vectors
    are sought among those of the documents it keeps, before the top-k.
    """
    k = options.limit * options.overfetch
    words = full_text(docs, query, k, where, also=also)
    if query_vector is None:
        return words.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(options.limit)
    if where is not None:
        mine = docs.filter(where).select(F.col("doc_id").alias("vec_id"))
        embeddings = embeddings.join(mine, "vec_id", "left_semi")
    near = ranked(knn(embeddings, query_vector, k), ("distance", "doc_id"), k)
    return fuse([(near, options.vector_weight), (words, options.text_weight)], options.k, options.limit)


def hydrate(hits: DataFrame, *parents: tuple[DataFrame, str, str]) -> DataFrame:
    """Hits joined up a chain of (table, its key, the column so far that refers to it).

    Hits without a row are dropped; their ``rank`` stays. Hits are at most
    ``limit`` rows (a top-k), which bounds what is broadcast.
    """
    out = hits
    for table, key, ref in parents:
        out = table.join(F.broadcast(out), F.col(key) == F.col(ref))
    return out


def as_json(rank: Column, title: Column, score: Column, body: Column) -> Column:
    """A result as a JSON object."""
    return F.to_json(F.struct(rank.alias("rank"), F.coalesce(title, F.lit("")).alias("title"), text.percent(score).alias("score"), text.preview(body, 300).alias("content")))


def as_line(rank: Column, title: Column, score: Column, body: Column) -> Column:
    """A result as lines for a terminal: its place, score and title, then the beginning of its text, line feeds as spaces."""
    start = F.regexp_replace(text.preview(body, 200), "\n", " ")
    return F.concat(rank.cast("string"), F.lit(". ["), F.format_string("%.3f", score), F.lit("] "), F.coalesce(title, F.lit("N/A")), F.lit("\n   "), start)


def formatted(rank: Column, title: Column, score: Column, body: Column) -> Column:
    """A result as a Markdown block."""
    return F.concat(
        F.lit("## "), rank.cast("string"), F.lit(". "), F.coalesce(title, F.lit("N/A")),
        F.lit("\nscore: "), F.format_string("%.3f", score), F.lit("\n\n"), text.preview(body, 200),
    )
