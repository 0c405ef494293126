"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Written, n_words, small

#: Sources up to which the table of targets is broadcast (one short row each).
BROADCAST_SOURCES = 50_000
SEED = 7
#: Digits of the drawing (128 bits) that each step toward a source's stop looks at.
DIGITS = (3, 6, 32)


def draw(doc_id: Column, seed: int) -> Column:
    """The seeded order of documents: hexadecimal digits that depend on the id alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(totals: DataFrame, share: float, weights: tuple[float, ...], epochs: int) -> DataFrame:
    """Water-filling over (source, source_size): adds ``target``.

    Sources in code point order, null last, take the weights in turn. A source
    that would get over ``epochs`` times its size stops there and the excess
    goes to the others by weight, until none is above. In the order of
    cap/weight the clamped sources are a prefix, so running sums find the level
    at once. One row per source is read; the windows have no partition because
    a level is a number of the whole mix.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.array(*[F.lit(float(x)) for x in weights])
    base = totals.withColumn("place", order).withColumns(
        {
            "weight": F.element_at(w, ((F.col("place") - 1) % len(weights) + 1).cast("int")),
            "cap": (F.col("source_size") * epochs).cast("double"),
        }
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    up = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = base.withColumns(
        {
            "words_left": F.sum("source_size").over(everything) * F.lit(float(share))
            - F.coalesce(F.sum("cap").over(up), F.lit(0.0)),
            "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)),
            "turn": F.row_number().over(by_ratio),
        }
    )
    free = F.col("cap") * F.col("weight_left") > F.col("weight") * F.col("words_left")
    # The level is that of the first source in this order that stays below its cap.
    level = F.min_by(F.when(free, F.col("words_left") / F.col("weight_left")), F.when(free, F.col("turn"))).over(everything)
    return left.withColumn("level", level).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("level").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("weight") * F.col("level")))
        .alias("target"),
    )


def plan(
    docs: DataFrame,
    share: float = 1.5,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    epochs: int = 2,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per source: how much of it the mix takes, and where its drawing stops.

    Every document of a source is taken ``whole`` times. One more repetition
    goes to the documents before ``cut`` in the seeded order; those at ``cut``
    (one id) give ``cut_part`` of their ``cut_size`` words. The stop is found by
    digits of the drawing: sums over its 4,096 ranges, then over the 4,096
    parts of the range in which it falls, then in that part. So a window sees
    at most 4,096 rows of a source, then 1/16,777,216 of its documents.
    """
    sizes = Written(
        docs.select(
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            draw(F.col(id_col), seed).alias("drawn"),
        ),
        "mix-sizes",
    ).df
    ranges = Written(sizes.groupBy("source", F.substring("drawn", 1, DIGITS[0]).alias("part")).agg(F.sum("size").alias("size")), "mix-ranges").df
    goal = Written(
        targets(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("extra", F.round("target").cast("long") - F.col("whole") * F.col("source_size")),
        "mix-goal",
    ).df
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    def stop(parts: DataFrame) -> DataFrame:
        """The part (source, part, size, left) in which ``left`` words are reached."""
        before = F.sum("size").over(Window.partitionBy("source").orderBy("part")) - F.col("size")
        return (
            parts.withColumn("before", before)
            .filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("size") > F.col("left")))
            .select("source", "part", "size", (F.col("left") - F.col("before")).alias("left"))
        )

    g = small(goal, BROADCAST_SOURCES)
    at = stop(ranges.join(g.filter("extra > 0"), same(ranges, g)).select(ranges["source"], "part", "size", F.col("extra").alias("left")))
    for known, digits in zip(DIGITS, DIGITS[1:]):
        k = small(Written(at.select("source", "part", "left"), "mix-stop").df, BROADCAST_SOURCES)
        inside = sizes.join(k, same(sizes, k) & (F.substring(sizes["drawn"], 1, known) == k["part"]))
        at = stop(inside.groupBy(sizes["source"], "left", F.substring("drawn", 1, digits).alias("part")).agg(F.sum(sizes["size"]).alias("size")))
    cut = at.select("source", F.col("part").alias("cut"), F.col("left").alias("cut_part"), F.col("size").alias("cut_size"))
    return Written(
        goal.join(cut, same(goal, cut), "left").select(goal["*"], "cut", "cut_part", "cut_size"), "mix-plan"
    ).df


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
    keep: Column | None = None,
    **settings,
) -> DataFrame:
    """(id, size, source_size, target, taken, copies, ``keep``) for every row of ``docs``.

    ``taken`` is the number of words that the mix takes from the row, repeats
    counted; over a source it sums to the rounded target. ``copies`` is that in
    whole documents, the one at the stop rounded to the nearer. Null and empty
    texts have no words and take none; a text of any length counts whole;
    sources of equal cap/weight are taken in code point order; rows that repeat an id share its drawing and, at
    the stop, divide it in proportion; a null source is a source of its own;
    an empty table gives an empty mix. Only the named columns are read, so
    others may have any name; ``keep`` carries what the caller needs.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        draw(F.col(id_col), seed).alias("drawn"),
        *([keep.alias("keep")] if keep is not None else []),
    )
    by = small(plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **settings), BROADCAST_SOURCES)
    c = F.col
    part = (
        F.when(c("extra") <= 0, 0)
        .when(c("cut").isNull() | (c("drawn") < c("cut")), c("size"))
        .when(c("drawn") == c("cut"), F.floor(c("size") * (c("cut_part") / c("cut_size"))))
        .otherwise(0)
    )
    return rows.join(by, rows["source"].eqNullSafe(by["source"])).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (c("whole") * c("size") + part).cast("long").alias("taken"),
        (c("whole") + F.when(c("extra") <= 0, 0).when(c("size") == 0, (c("cut").isNull() | (c("drawn") < c("cut"))).cast("int")).otherwise((part * 2 >= c("size")).cast("int"))).cast("int").alias("copies"),
        *(["keep"] if keep is not None else []),
    )
