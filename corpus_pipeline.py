"""A pipeline over documents: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's ``docs``. A stage carries the
documents' own columns in a struct, so that names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import lines, mixing, packing, repetition, similar
from siltstone.llm.common import Written
from siltstone.session import load, spread

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def document() -> Column:
    return F.struct(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null and empty texts have no words and go; texts of any length are judged
    whole, each on its own, so repeated rows stay or go together; limits are
    strict, so a document at one passes; an empty table stays empty. Columns
    other than the documents' are dropped, whatever their names.
    """
    return repetition.quality(docs, keep=document()).filter("kept").select("keep.*")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kept) of groups of near copies, written: it is read more than once."""
    return Written(similar.similar_documents(docs).select("doc_id", "text_hash", "kept"), "pipeline-labels").df


def one_of_each(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``first_of_groups`` keeps; of rows with the same id and text, one."""
    gone = labels.filter(~F.col("kept")).select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")).distinct()
    rows = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    rest = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_hash") == F.col("g_hash")), "left_anti")
    twice = labels.filter("kept").groupBy("doc_id", "text_hash").count().filter("count > 1")
    if twice.limit(1).count():
        least = F.min(F.struct("source", "lang", "n_chars", "text")).alias("r")
        rest = rest.groupBy("doc_id", "text_hash").agg(least).select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars")
    return rest.select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; ``n_chars`` follows the text.

    A line's share is that of different documents: a group of near copies
    counts once, so that copies do not take their own lines for boilerplate;
    all of them lose what is boilerplate, and the next stage removes them. A
    null text stays null; an empty one has no lines; texts and lines of any
    length are read whole; a null source is a source of its own; a line at the
    ratio stays; rows that repeat are near copies; an empty table stays empty.
    Columns other than the documents' are dropped, whatever their names.
    """
    counted = one_of_each(docs, first_of_groups(docs)).select(F.col("source").alias("site"), "text")
    out = lines.drop_boilerplate(docs, F.col("source"), F.col("text"), document(), counted=counted)
    text = F.col("text")
    return out.select(
        "keep.doc_id", text, "keep.lang", "keep.source", F.when(F.col("n_dropped") > 0, F.length(text).cast("long")).otherwise(F.col("keep.n_chars")).alias("n_chars")
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The smallest id of a group stays, of rows that repeat it the smallest hash
    of the text; of rows that repeat both, one, with the smallest source, then
    lang, then n_chars. Null ids rank last; null and empty texts are one group;
    texts of any length are compared whole; an empty table stays empty. Columns
    other than the documents' are dropped, whatever their names.
    """
    return one_of_each(docs, first_of_groups(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken.

    Null and empty texts have no words and come as often as their place in the
    drawing says; a text of any length counts by its words; a null source is a
    source of its own; rows that repeat an id share its place; an empty table
    stays empty. Columns other than the documents' are dropped, whatever their
    names.
    """
    mixed = mixing.mix(docs, keep=document())
    return mixed.filter("copies > 0").select(F.explode(F.array_repeat("keep", F.col("copies"))).alias("keep")).select("keep.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens: a row for each piece of a document.

    Null and empty texts have the end id alone; a very long text gives as many
    full windows as it fills; of equally long rests the earlier row goes first;
    rows that repeat are packed as often as they come; an empty table gives no
    rows. Columns other than id and text are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: SQL expresses neither suffix arrays nor fingerprints; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents")).select(*COLUMNS)
    before = None
    for name, stage in STAGES[:-1]:
        after = Written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.drop()
        before, docs = after, after.df
    return STAGES[-1][1](spark, docs, sf_dir)
